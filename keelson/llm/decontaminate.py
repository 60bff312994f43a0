"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows.

Texts are normalised to lower-case words; words of the benchmark are numbered, and every window of
consecutive item words is a pattern over those numbers, ten nodes at most. A document's words are scanned once,
and matches are mapped back to places in the text.

The automaton of 2 MB of random words (BLOCK_BYTES) took 0.26 GB of a process. A larger benchmark is dealt
into blocks; the documents are scanned for one block after the other, by one Python stage each, and what each
finds is written and merged by row at the end. So neither driver nor workers hold more than a block.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import Scratch, map_batches, utf8

WINDOW = 10
#: UTF-8 bytes of benchmark text in one automaton, some 3 million nodes; a larger benchmark is scanned in several.
BLOCK_BYTES = 2 << 20
#: Rows with hits broadcast at most; beyond it, the join is shuffled.
MOST_BROADCAST = 200_000

_WORD = rb"[0-9A-Za-z\x80-\xff]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(_FOLD).split()


class Matcher:
    """The automaton of a block of items: [(item_id, UTF-8 text)]."""

    def __init__(self, items: list[tuple], window: int):
        import ahocorasick

        self._ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            numbers = [self._ids.setdefault(w, len(self._ids) + 1) for w in words_of(text)]
            for at in range(max(1, len(numbers) - window + 1) if numbers else 0):
                own = owners.setdefault(tuple(numbers[at : at + window]), set())
                if item is not None:
                    own.add(item)
        self._automaton = None
        if owners:
            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for numbers, own in owners.items():
                self._automaton.add_word(numbers, (len(numbers), own))
            self._automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans [first, end) that windows cover, and the items that own the windows."""
        spans, items = [], set()
        if self._automaton is None or not words:
            return spans, items
        known = self._ids.get
        for last, (count, own) in self._automaton.iter(tuple([known(w, 0) for w in words])):
            spans.append((last - count + 1, last + 1))
            items |= own
        return spans, items


_matchers: dict[str, Matcher] = {}


def _matcher(name: str, items: list[tuple], window: int) -> Matcher:
    """This process's automaton of a block; one is kept, as blocks are scanned one after the other."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(items, window)
    return _matchers[name]


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks of items of bounded size, and the blocks, each collected when it is asked for."""
    known = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-total // block_bytes))
    dealt = known.withColumn("_block", F.pmod(F.xxhash64("text"), F.lit(count)))
    if count > 1:  # read once for all blocks
        dealt = Scratch(benchmark.sparkSession, "benchmark").save(dealt.repartition(min(count, 64), "_block"), "blocks")
    return count, ([(r["item_id"], r["text"].encode()) for r in dealt.where(F.col("_block") == k).select("item_id", "text").collect()] for k in range(count))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
_FOUND = "word_spans array<struct<first:int,end:int>>, items array<string>"


def _scanned(docs: DataFrame, block: list[tuple], window: int, hits_only: bool):
    """docs(text, ...) with word_spans and items found of one block, and the broadcast block."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    at = docs.columns.index("text")
    names = [*docs.columns, "word_spans", "items"]

    def each(batch: pa.RecordBatch, name=uuid.uuid4().hex) -> pa.RecordBatch:
        matcher = _matcher(name, sent.value, window)
        found = [matcher.scan(words_of(x)) for x in utf8(batch.column(at))]
        spans = pa.array([[{"first": a, "end": b} for a, b in _merged(own)] for own, _ in found], _SPANS)
        items = pa.array([sorted({str(x) for x in ids}) for _, ids in found], pa.list_(pa.string()))
        made = pa.RecordBatch.from_arrays([*batch.columns, spans, items], names)
        return made.filter(pa.array([bool(own) for own, _ in found], pa.bool_())) if hits_only else made

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, each, f"{kinds}, {_FOUND}"), sent


def _hits(keyed: DataFrame, blocks: Iterator[list[tuple]], window: int, scratch: Scratch) -> DataFrame:
    """rid, word_spans and items of the rows of keyed(rid, text) with hits, block after block: each is written before the next begins."""
    hits = None
    for block in blocks:
        found, sent = _scanned(keyed, block, window, True)
        own = scratch.save(found.drop("text"), "hits")
        sent.destroy()
        hits = own if hits is None else hits.unionByName(own)
    # a row meets its hits once a block
    return hits.groupBy("rid").agg(F.flatten(F.collect_list("word_spans")).alias("word_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of each document that lie in a window of benchmark words.

    Returns per row of docs: doc_id, n_words, n_hit, n_items, items (ids sorted as strings),
    items_sha256, contaminated, spans (places in the text, in code points, end exclusive). A null or
    wordless text has no words and no hits; an item shorter than the window is one window, a null or
    wordless one none; windows of an item with a null id hit, but name no item; a window of several items
    names them all; repeated rows stay; texts are scanned whole, however long; an empty benchmark hits
    nothing, and an empty table gives no rows. Other columns are ignored.
    """
    count, blocks = _blocks(benchmark, block_bytes)
    if count == 1:
        found, _ = _scanned(docs.select("doc_id", "text"), next(blocks), window, False)
    else:
        scratch = Scratch(docs.sparkSession, "decontaminate")
        keyed = scratch.save(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")), "keyed")
        hits = scratch.save(_hits(keyed.select("rid", "text"), blocks, window, scratch), "merged")
        joined = keyed.join(_small(hits), "rid", "left")
        found = joined.select("doc_id", "text", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("word_spans", "array<struct<first:int,end:int>>"), ("items", "array<string>"))])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def report(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "items_sha256", "spans")}
        items = batch.column(3).to_pylist()
        for text, own, ids in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), items):
            own = _merged([(x["first"], x["end"]) for x in own])
            columns["n_words"].append(len(words_of(text)))
            columns["n_hit"].append(sum(b - a for a, b in own))
            columns["items_sha256"].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            places = []
            if own:  # offsets in the original, only where there are hits
                at = [m.span() for m in re.finditer(_WORD, text)]
                for a, b in own:
                    start, end = at[a][0], at[b - 1][1]
                    before = len(text[:start].decode())
                    places.append({"start": before, "end": before + len(text[start:end].decode())})
            columns["spans"].append(places)
        made = {
            "doc_id": batch.column(0), "n_words": pa.array(columns["n_words"], pa.int64()), "n_hit": pa.array(columns["n_hit"], pa.int64()),
            "n_items": pa.array([len(x) for x in items], pa.int64()), "items": batch.column(3), "items_sha256": pa.array(columns["items_sha256"], pa.string()),
            "contaminated": pa.array([n > 0 for n in columns["n_hit"]], pa.bool_()), "spans": pa.array(columns["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }
        return pa.RecordBatch.from_arrays(list(made.values()), list(made))

    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, contaminated boolean, spans array<struct<start:bigint,end:bigint>>"
    return map_batches(found, report, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold a window of benchmark words; columns are kept as they are, whatever their names.

    Null, empty and wordless texts stay, as do repeated rows without hits; null ids are ids like others; an
    empty benchmark removes nothing; an empty table stays empty. Texts are scanned whole, however long.
    """
    count, blocks = _blocks(benchmark, block_bytes)
    if count == 1:
        sent, at = docs.sparkSession.sparkContext.broadcast(next(blocks)), docs.columns.index("text")

        def each(batch: pa.RecordBatch, name=uuid.uuid4().hex) -> pa.RecordBatch:
            matcher = _matcher(name, sent.value, window)
            return batch.filter(pa.array([not matcher.scan(words_of(x))[0] for x in utf8(batch.column(at))], pa.bool_()))

        return map_batches(docs, each, docs.schema)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    keyed = scratch.save(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("rid")), "keyed")
    hits = scratch.save(_hits(keyed.select("rid", "text"), blocks, window, scratch).select("rid"), "merged")
    return keyed.join(_small(hits), "rid", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def oracle() -> str:
    """The query's columns for DuckDB: windows joined by their words."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
    b AS (SELECT item_id, {words} AS ws FROM benchmark),
    w AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[pos + 1 : pos + least(len(ws), {WINDOW})], ' ') AS line
          FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - {WINDOW} + 1, 1))) AS pos FROM b WHERE len(ws) > 0)),
    sizes AS (SELECT DISTINCT n FROM w),
    p AS (SELECT rid, n, unnest(range(len(ws) - n + 1)) AS pos, ws FROM d, sizes WHERE len(ws) >= n),
    h AS (SELECT rid, p.n, pos, item_id FROM p JOIN w ON p.n = w.n AND array_to_string(ws[pos + 1 : pos + p.n], ' ') = line),
    c AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS word FROM h) GROUP BY rid),
    i AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (WHERE item_id IS NOT NULL)), ',') AS items FROM h GROUP BY rid)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
    """
