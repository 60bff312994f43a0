"""Passages that repeat across documents, by a sparse suffix array.

A text is a sequence of words. Of its suffixes only those are retained that begin at a minimiser: of
each 26 consecutive runs of 25 words, the run with the least hash. The choice depends on content alone,
so equal passages of 50 words retain a suffix at the same word. Suffixes whose first 25 words have a
hash that occurs once repeat nowhere and are dropped.

The retained suffixes are sorted by the words that follow (50 at most, as text), then by the words before
them, nearest first. Rows are dealt by range over the whole order, ids and places included, so that equal
suffixes are split by position. Neighbours are compared word by word: their match extends right by the
common words that follow and left by those before. Between the last row of a part and the first of the next,
the same is done afterwards.

A neighbour may agree for longer to the right and yet less to the left than a suffix farther off. So wherever
neighbours agree on what follows within a passage but not on what precedes, both passages are noted by a
128-bit hash, and notes that meet are repeats too. Within a stretch of suffixes that agree on what follows,
each chain of suffixes that agree on the whole passage ends at such a place or is the whole stretch, so every
passage that occurs twice is found, and a passage is noted a few times rather than for each copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import Scratch, parts, utf8


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of few documents: each makes hundreds of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Words of the shortest passage reported, and of a suffix's first part.
LEAST, PREFIX = 50, 25
#: Bytes of suffixes in one Arrow batch.
BATCH_BYTES = 8 << 20
#: Bits of the filter of neighboured suffixes (32 MB), and up to how many suffixes it serves.
FILTER_BITS, MOST_FILTERED = 28, 100_000_000

_FACTORS = (0x9E3779B97F4A7C15, 0xA24BAED4963EE407)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse, modulo 2**64."""
    if factor not in _powers or len(_powers[factor][0]) < size:
        full = max(2 * size, 1 << 16)
        up = np.full(full, factor, np.uint64)
        down = np.full(full, pow(factor, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[factor] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    up, down = _powers[factor]
    return up[:size], down[:size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    return x


def _word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text. They choose suffixes and decide nothing: equal words have equal hashes."""
    data = np.frombuffer(text, np.uint8)
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(_FACTORS[1], len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts])


def _rolled(words: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    up, down = _power(factor, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * down[: len(words) - size + 1])


def _sliding(x: np.ndarray, size: int, of=np.minimum) -> np.ndarray:
    """Least (or greatest) of each `size` neighbours, by doubling."""
    made, covered = x, 1
    while 2 * covered <= size:
        made = of(made[:-covered], made[covered:])
        covered *= 2
    if covered < size:
        left = len(x) - size + 1
        made = of(made[:left], made[size - covered : size - covered + left])
    return made


def _minimisers(text: bytes, least: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Word hashes, hashes of the runs of `prefix` words, and for each passage its minimiser's; None if too short."""
    hashed = _word_hashes(text)
    if len(hashed) < least:
        return None
    runs = _rolled(hashed, prefix, _FACTORS[0])
    return hashed, runs, _sliding(runs, least - prefix + 1)


def _is_retained(runs: np.ndarray, chosen: np.ndarray, span: int) -> np.ndarray:
    """Which runs are the minimiser of a passage: those that equal the greatest minimum of the passages around them."""
    around = np.zeros(len(chosen) + 2 * (span - 1), np.uint64)
    around[span - 1 : len(around) - span + 1] = chosen
    return runs == _sliding(around, span, np.maximum)


def _retained(runs: np.ndarray, chosen: np.ndarray, span: int) -> np.ndarray:
    """The hashes of retained runs, once for each place."""
    return runs[_is_retained(runs, chosen, span)]


def _suffixes(docs: DataFrame, least: int, prefix: int) -> DataFrame:
    """suffix, n: the retained suffixes, by the hash of their first words, with a task's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = (_minimisers(t, least, prefix) for t in utf8(batch.column(0)))
            found = [_retained(x[1], x[2], least - prefix + 1) for x in made if x]
            if found:
                each, counts = np.unique(np.concatenate(found).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(counts.astype(np.int64))], ["suffix", "n"])

    return docs.select("text").mapInArrow(run, "suffix bigint, n bigint")


def _contexts(docs: DataFrame, kept, least: int, prefix: int) -> DataFrame:
    """The retained suffixes whose hash `kept(batch, row, hashes)` lets through, a row for each place.

    after: the words from the place on, `least` at most; before: those before it, the nearest first; low and
    high: of the passages that begin so many words before the place, which ones have it as their minimiser.
    Each word of after and before ends with a space, so that byte order keeps equal words together.
    """
    kind, span = docs.schema["doc_id"].dataType.simpleString(), least - prefix + 1
    names = ["after", "before", "doc_id", "key", "place", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after, before, row, numbers, size = [], [], [], [], 0

            def made() -> pa.RecordBatch:
                rows = pa.array(row, pa.int64())
                own = np.array(numbers, np.int32).reshape(-1, 3)
                return pa.RecordBatch.from_arrays([pa.array(after, pa.binary()), pa.array(before, pa.binary()), batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(own[:, k]) for k in range(3))], names)

            for k, text in enumerate(utf8(batch.column(2))):
                if not (x := _minimisers(text, least, prefix)):
                    continue
                _, runs, chosen = x
                at = np.flatnonzero(_is_retained(runs, chosen, span))
                at = at[np.asarray(kept(batch, k, runs[at]), bool)]
                if not len(at):
                    continue
                firsts = at[:, None] - np.arange(span)
                own = (firsts >= 0) & (firsts < len(chosen))
                own &= chosen[np.clip(firsts, 0, len(chosen) - 1)] == runs[at][:, None]
                words = text.split()
                for p, low, high in zip(at.tolist(), own.argmax(axis=1).tolist(), (span - 1 - own[:, ::-1].argmax(axis=1)).tolist()):
                    after.append(b" ".join(words[p : p + least]) + b" ")
                    before.append(b" ".join(words[max(0, p - span + 1) : p][::-1]) + b" " if p else b"")
                    row.append(k)
                    numbers.append((p, low, high))
                    size += len(after[-1]) + len(before[-1])
                    if size >= BATCH_BYTES:
                        yield made()
                        after, before, row, numbers, size = [], [], [], [], 0
            if row:
                yield made()

    return docs.mapInArrow(run, f"after binary, before binary, doc_id {kind}, key bigint, place int, low int, high int")


def _common(a: bytes, b: bytes) -> int:
    """Words that two contexts have in common at their beginning."""
    if a == b:
        return a.count(b" ")
    n = 0
    for x, y in zip(a.split(b" "), b.split(b" ")):
        if x != y or not x:
            break
        n += 1
    return n


def _least_first(x: tuple) -> tuple:
    """Order of places by document; null ids come last."""
    return (x[2] is None, 0 if x[2] is None else x[2], x[3], x[4])


class _Neighbours:
    """Compares neighbours of the suffix order and gathers what they show."""

    def __init__(self, least: int, prefix: int, kind: pa.DataType):
        self.least, self.most, self.kind = least, least - prefix, kind
        self.spans: dict[tuple, list] = {}  # of the last two places: first, end, and the part of it that a lesser document shares
        self._new()

    def _new(self) -> None:
        self.found: list[tuple] = []  # doc_id, key, first, end, first and end of the part that a lesser document shares
        self.notes: list[tuple] = []  # two halves of the hash, doc_id, key, first

    def _covered(self, x: tuple, left: int, right: int, lesser: bool) -> tuple:
        return (x[2], x[3], x[4] - left, x[4] + right, *((x[4] - left, x[4] + right) if lesser else (None, None)))

    def compare(self, x: tuple, y: tuple) -> None:
        right, left = _common(x[0], y[0]), _common(x[1], y[1])
        if left + right >= self.least:
            order = (_least_first(x) > _least_first(y)) - (_least_first(x) < _least_first(y))
            self.found.append(self._covered(x, left, right, order > 0))
            self.found.append(self._covered(y, left, right, order < 0))
        for a in range(max(left + 1, self.least - right), self.most + 1):
            for z in (x, y):
                if z[5] <= a <= z[6]:
                    words = z[1].split(b" ")[:a][::-1] + z[0].split(b" ")[: self.least - a]
                    digest = xxhash.xxh3_128_digest(b" ".join(words))
                    self.notes.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), z[2], z[3], z[4] - a))

    def batch(self, border: list[tuple]) -> pa.RecordBatch:
        """What was found so far, and (part, is_last, row) of border rows, as one batch; begins anew."""
        merged: list[tuple] = []
        for x in self.found:  # a place is found twice in a row, with either neighbour
            if merged and merged[-1][:2] == x[:2] and merged[-1][2] <= x[3] and x[2] <= merged[-1][3] and (merged[-1][4] is None) == (x[4] is None):
                y = merged[-1]
                merged[-1] = (*x[:2], min(x[2], y[2]), max(x[3], y[3]), *((None, None) if x[4] is None else (min(x[4], y[4]), max(x[5], y[5]))))
            else:
                merged.append(x)
        notes, n, m, b = self.notes, len(merged), len(self.notes), len(border)
        self._new()
        rows = [x for _, _, x in border]
        column = lambda spans, own, edges, kind: pa.array([*spans, *own, *edges], kind)
        return pa.RecordBatch.from_arrays([
            column([0] * n, [1] * m, [2] * b, pa.int32()),
            column([x[0] for x in merged], [x[2] for x in notes], [x[2] for x in rows], self.kind),
            column([x[1] for x in merged], [x[3] for x in notes], [x[3] for x in rows], pa.int64()),
            column([x[2] for x in merged], [x[4] for x in notes], [x[4] for x in rows], pa.int32()),
            *(column([x[k] for x in merged], [None] * m, [None] * b, pa.int32()) for k in (3, 4, 5)),
            *(column([None] * n, [x[k] for x in notes], [None] * b, pa.int64()) for k in (0, 1)),
            *(column([None] * (n + m), [], [x[k] for x in border], t) for k, t in ((0, pa.int32()), (1, pa.bool_()))),
            *(column([None] * (n + m), [], [x[k] for x in rows], t) for k, t in ((0, pa.binary()), (1, pa.binary()), (5, pa.int32()), (6, pa.int32()))),
        ], ["what", "doc_id", "key", "first", "end", "lesser_first", "lesser_end", "a", "b", "part", "last", "after", "before", "low", "high"])


def _compared(suffixes: DataFrame, least: int, prefix: int, scratch: Scratch) -> DataFrame:
    """Spans (what = 0) and notes (what = 1) of all neighbours in the order of the suffixes."""
    kind = suffixes.schema["doc_id"].dataType.simpleString()
    schema = f"what int, doc_id {kind}, key bigint, first int, end int, lesser_first int, lesser_end int, a bigint, b bigint, part int, last boolean, after binary, before binary, low int, high int"
    order = ["after", "before", "doc_id", "key", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, made = TaskContext.get().partitionId(), None, None
        for batch in batches:
            border = []
            made = made or _Neighbours(least, prefix, batch.schema.field(2).type)
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if last is None:
                    border.append((part, False, x))
                else:
                    made.compare(last, x)
                last = x
            yield made.batch(border)
        if last is not None:
            yield made.batch([(part, True, last)])

    # a total order: rows with equal words are split, too
    dealt = suffixes.repartitionByRange(parts(suffixes.sparkSession), *order).sortWithinPartitions(*order)
    found = scratch.save(dealt.mapInArrow(run, schema), "neighbours")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = made = None
        for batch in batches:
            made = made or _Neighbours(least, prefix, batch.schema.field(4).type)
            for _, is_last, *x in zip(*(c.to_pylist() for c in batch.columns)):
                if not is_last and last is not None:
                    made.compare(last, tuple(x))
                last = tuple(x)
        if made:
            yield made.batch([])

    # two rows a part
    edges = found.where("what = 2").select("part", "last", "after", "before", "doc_id", "key", F.col("first").alias("place"), "low", "high").repartition(1).sortWithinPartitions("part", "last")
    return found.where("what < 2").unionByName(scratch.save(edges.mapInArrow(across, schema), "borders"))


def _key(docs: DataFrame) -> F.Column:
    """What tells rows of one doc_id apart: nothing where ids are unique, else a hash of id and text."""
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    return F.lit(0).cast("bigint") if seen["n"] == seen["ids"] else F.xxhash64("doc_id", "text")


def _spans(keyed: DataFrame, least: int, prefix: int, most_filtered: int, scratch: Scratch, lesser: bool) -> DataFrame:
    """doc_id, key, first, end: words that repeat; with `lesser`, only those that a lesser document was seen to share."""
    shared = scratch.save(_suffixes(keyed, least, prefix).groupBy("suffix").agg(F.sum("n").alias("n")).where("n > 1").select("suffix"), "suffixes")
    if shared.count() <= most_filtered:
        kept = _contexts(keyed, _filtered(shared), least, prefix)
    else:
        kept = _joined(keyed, shared, least, prefix)
    suffixes = scratch.save(kept, "contexts")
    found = _compared(suffixes, least, prefix, scratch)
    scratch.drop(suffixes)
    spans = found.where("what = 0")
    spans = spans.where("lesser_first IS NOT NULL").select("doc_id", "key", F.col("lesser_first").alias("first"), F.col("lesser_end").alias("end")) if lesser else spans.select("doc_id", "key", "first", "end")
    notes = found.where("what = 1").select("a", "b", "doc_id", "key", "first")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "first")
    # what is met is written, so that the join reads two plain shuffles, whose hot keys Spark can split
    met = scratch.save(notes.groupBy("a", "b").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("a", "b", "low"), "met")
    more = notes.join(met, ["a", "b"])
    if lesser:
        more = more.where(place != F.col("low"))
    return spans.unionByName(more.select("doc_id", "key", "first", (F.col("first") + least).alias("end")))


def find_repeats(docs: DataFrame, least: int = LEAST, prefix: int = PREFIX, most_filtered: int = MOST_FILTERED) -> DataFrame:
    """Maximal runs of words covered by passages of `least` words that occur twice or more in the corpus.

    Returns a row per run: doc_id, key (see _key()), first_word, end_word (exclusive) and n_words. Words
    are parted by ASCII white space and compared as they are. Documents without repeats, null and empty
    texts and texts of fewer words give no rows; a repeat within one document counts; rows equal in id
    and text repeat each other and are reported once; null ids are reported; other columns are ignored,
    whatever their names; an empty table gives no rows. A very long text is held by one task, with arrays
    of about 50 times its size in words; suffixes leave it in batches of BATCH_BYTES.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    keyed = docs.select("doc_id", _key(docs).alias("key"), "text")
    spans = _spans(keyed, least, prefix, most_filtered, scratch, False)
    return _runs(spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("own")))


def _filtered(shared: DataFrame):
    """Membership in a bitmap of the neighboured suffixes. What it lets through by chance has no equal passage and falls out later."""
    bit = F.shiftrightunsigned("suffix", 64 - FILTER_BITS)
    piece = 1 << 15  # bits in a row of bitmap_construct_agg
    made = shared.groupBy(F.floor(bit / piece).alias("k")).agg(F.bitmap_construct_agg(bit % piece).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in made.toLocalIterator():  # at most 2**FILTER_BITS bits, whatever the corpus
        bits[r["k"] * piece // 8 : (r["k"] + 1) * piece // 8] = np.frombuffer(r["bits"], np.uint8)
    sent = shared.sparkSession.sparkContext.broadcast(bits)

    def kept(batch: pa.RecordBatch, row: int, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    return kept


def _joined(keyed: DataFrame, shared: DataFrame, least: int, prefix: int) -> DataFrame:
    """The same for more suffixes than the bitmap serves: documents get their neighboured suffixes by joins."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, found = [], []
            for k, text in enumerate(utf8(batch.column(2))):
                if x := _minimisers(text, least, prefix):
                    found.append(np.unique(x[2]).view(np.int64))  # minimisers alone are retained
                    row.append(np.full(len(found[-1]), k))
            if found:
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(found))], ["id", "own", "suffix"])

    each = keyed.mapInArrow(run, f"id {kind}, own bigint, suffix bigint")
    held = each.join(shared, "suffix").groupBy("id", "own").agg(F.collect_set("suffix").alias("suffixes"))
    docs = keyed.join(held, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("own"))).select("doc_id", "key", "text", "suffixes")

    def kept(batch: pa.RecordBatch, row: int, hashes: np.ndarray) -> np.ndarray:
        return np.isin(hashes.view(np.int64), batch.column(3)[row].values.to_numpy())

    return _contexts(docs, kept, least, prefix)


def _runs(found: DataFrame) -> DataFrame:
    """Spans of a document, sorted by place, as runs of words."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2)
            each = own.flatten()
            first, end = (each.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "end"))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(own).to_numpy(zero_copy_only=False))
            # a run ends before a span that begins behind all before it; rows are told apart by an offset
            far = row * (int(end.max()) + 2 if len(end) else 1)
            reached = np.maximum.accumulate(end + far)
            begins = np.flatnonzero(np.r_[True, (first + far)[1:] > reached[:-1]])
            rows, lasts = pa.array(row[begins]), np.r_[begins[1:] - 1, len(first) - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first[begins].astype(np.int32)), pa.array((reached - far)[lasts].astype(np.int32))], ["doc_id", "key", "first_word", "end_word"])

    made = found.mapInArrow(run, f"doc_id {kind}, key bigint, first_word int, end_word int")
    return made.withColumn("n_words", F.col("end_word") - F.col("first_word"))


def cut_repeats(docs: DataFrame, least: int = LEAST, prefix: int = PREFIX, most_filtered: int = MOST_FILTERED) -> DataFrame:
    """docs without repeated runs, which stay in one document, the one of least id among those that hold it; other columns as they are.

    The text around a cut is joined by a newline; a text without cuts is unchanged. A pass cuts what a neighbour
    in suffix order with a lesser id (or place) holds as well, at least every other copy; passes follow until nothing is
    left to cut, each written. Null ids count as the greatest; rows equal in id and text stay; null and empty
    texts stay as they are; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "cut")
    names, at = docs.columns, docs.columns.index("text")
    while True:
        keyed = docs.select("doc_id", _key(docs).alias("key"), "text")
        spans = _spans(keyed, least, prefix, most_filtered, scratch, True)
        cuts = spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("own"))
        cuts = _runs(cuts).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.sort_array(F.collect_set(F.struct("first_word", "end_word"))).alias("_cuts"))
        cuts = scratch.save(cuts, "cuts")
        if cuts.isEmpty():
            return docs
        held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").alias("_own"), _key(docs).alias("_own_key"))
        joined = held.join(cuts, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_key") == F.col("_key")), "left").select("_row", "_cuts")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(0).flatten()
                texts = rows[at].to_pylist()
                for k, cuts in enumerate(batch.column(1).to_pylist()):
                    if cuts:
                        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[k])]
                        left, last = [], 0
                        for x in cuts:
                            left.append(texts[k][last : places[x["first_word"]][0]].strip())
                            last = places[x["end_word"] - 1][1]
                        texts[k] = "\n".join(x for x in [*left, texts[k][last:].strip()] if x)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == at else x for c, x in enumerate(rows)], names)

        docs = scratch.save(joined.mapInArrow(run, docs.schema), "docs")


def oracle() -> str:
    """find_repeats() without key for DuckDB: every passage counted as it is."""
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM documents),
    p AS (SELECT rid, pos, array_to_string(ws[pos + 1 : pos + {LEAST}], ' ') AS passage FROM (SELECT rid, ws, unnest(range(len(ws) - {LEAST} + 1)) AS pos FROM d WHERE len(ws) >= {LEAST})),
    r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY passage) AS n FROM p) WHERE n > 1),
    n AS (SELECT rid, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY rid ORDER BY pos) + {LEAST} THEN 0 ELSE 1 END AS opens FROM r),
    g AS (SELECT rid, pos, sum(opens) OVER (PARTITION BY rid ORDER BY pos) AS run FROM n),
    s AS (SELECT rid, min(pos) AS first_word, max(pos) + {LEAST} AS end_word FROM g GROUP BY rid, run)
    SELECT doc_id, first_word, end_word, end_word - first_word AS n_words FROM (SELECT DISTINCT doc_id, text, first_word, end_word FROM s JOIN d USING (rid))
    """
