"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing places pieces from long to short, each into the open sequence with the least room
that still holds it; a segment tree over remaining capacities finds that sequence in logarithmic time.
Pieces of one length are interchangeable, so the tree runs over the histogram of lengths (at most
`capacity` entries whatever the corpus) and places equal pieces in runs. The plan then says, for the
k-th piece of each length, its sequence and offset; Spark numbers the pieces and looks them up.
"""

from __future__ import annotations

import sys
import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import Scratch, map_batches, parts, ranked, utf8
from keelson.llm.tokens import encoder, word_vocabulary

CAPACITY = 2048
END_ID = 0


class RoomTree:
    """Counts of open sequences by remaining room; finds the least room of at least a length."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._sums = [0] * (2 * self._leaves)

    def add(self, room: int, count: int) -> None:
        at = room + self._leaves
        while at:
            self._sums[at] += count
            at >>= 1

    def tightest(self, length: int) -> int | None:
        at = length + self._leaves
        if self._sums[at]:
            return length
        while at > 1:
            if not at & 1 and self._sums[at + 1]:  # the subtree to the right has an open sequence
                at += 1
                while at < self._leaves:
                    at *= 2
                    if not self._sums[at]:
                        at += 1
                return at - self._leaves
            at >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing over a histogram of lengths.

    Returns parallel arrays of runs, sorted by (length, rank): from the rank-th piece of that length
    on, `per` pieces go into each sequence from `first` on, starting at `offset`.
    """
    tree, open_runs = RoomTree(capacity), defaultdict(deque)

    def release(room: int, first: int, count: int, front: bool = False) -> None:
        if room and count:
            (open_runs[room].appendleft if front else open_runs[room].append)((first, count))
            tree.add(room, count)

    runs, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit into {capacity}")
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, sequences, -(-left // (capacity // length))
                sequences += count
            else:
                first, count = open_runs[room].popleft()
                tree.add(room, -count)
            per = room // length
            placed = min(left, per * count)
            full, rest = divmod(placed, per)
            runs.append((length, rank, per, first, capacity - room))
            release(room - per * length, first, full)
            release(room - rest * length, first + full, int(rest > 0))
            release(room, first + full + (rest > 0), count - full - (rest > 0), front=True)
            rank += placed
            left -= placed
    runs.sort()
    columns = np.array(runs, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "per", "first", "offset"), columns)) | {"sequences": sequences}


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise and cut documents: doc_id, piece, start, length, ids_crc32 and, if wanted, ids."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([end_id], "<u4").tobytes()
        owner, piece, start, length, crc, ids = [], [], [], [], [], []
        for row, packed in enumerate(encoder(tokenizer).encode(utf8(batch.column(1)))):
            packed += end
            for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                own = packed[at : at + 4 * capacity]
                owner.append(row)
                piece.append(k)
                start.append(at // 4)
                length.append(len(own) // 4)
                crc.append(zlib.crc32(own))
                if with_ids:
                    ids.append(np.frombuffer(own, "<u4").astype(np.int32))
        made = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            made, names = [*made, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(made, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return map_batches(docs.select("doc_id", "text"), each, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack documents into as few sequences of at most `capacity` tokens as best-fit decreasing finds.

    docs needs doc_id and text; other columns are ignored. Returns a row per piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset, and ids where with_ids. A null or empty text is the
    end token alone; repeated rows and null ids are packed as rows of their own; a longer document
    is cut into pieces of `capacity`, the last one shorter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.save(cut(docs, tokenizer or word_vocabulary(), capacity, end_id, with_ids), "pieces")
    # at most `capacity` rows, whatever the corpus
    histogram = {x["length"]: x["n"] for x in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = plan(histogram, capacity)
    if sum(sys.getsizeof(x) for x in made.values()) > 64 * capacity * capacity:
        raise AssertionError("the plan outgrew its bound")
    sent = spark.sparkContext.broadcast(made)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = sent.value
        length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
        rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
        # runs of a length follow each other by rank; ranks stay below 2**50
        at = np.searchsorted((runs["length"] << 50) | runs["rank"], (length << 50) | rank, side="right") - 1
        inside = rank - runs["rank"][at]
        sequence = runs["first"][at] + inside // runs["per"][at]
        offset = runs["offset"][at] + inside % runs["per"][at] * length
        kept = [c for c in batch.schema.names if c != "rank"]
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    numbered = ranked(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], parts(spark))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.drop("rank").schema)
    return map_batches(numbered, place, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pack(..., with_ids=True): sequence_id, ids, doc_ids."""
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", F.flatten(F.col("own.ids")).alias("ids"), F.col("own.doc_id").alias("doc_ids"))
