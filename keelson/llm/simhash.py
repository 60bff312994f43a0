"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Fingerprints that differ in at most two bits
either differ in at most one bit of the first segment, or agree on the second. So each fingerprint is
indexed under the 32 variants of its first segment with one bit struck out, and under its second
segment; an equality join on these keys finds every pair, which is then verified.

A key with two fingerprints gives one pair. The fingerprints of keys with more are compared by their
own one-bit variants of full width instead: two of them differ in at most two bits if and only if
they share such a variant, and a variant is shared by 65 at most. So the work is linear in a group
of near copies, however large, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import Scratch, map_batches, utf8
from keelson.llm.near import keep_one  # noqa: F401  (its callers know it by this module)
from keelson.operators.components import connected_components

WORDS = 3
SEED = 42
#: Keys broadcast at most (16 MB); beyond it, the join is shuffled.
MOST_BROADCAST = 1_000_000


def fingerprint(text: bytes, width: int = WORDS) -> int:
    """SimHash of the word shingles of a UTF-8 text, repeats included, as a signed integer; no words: 0."""
    words = text.lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in shingles], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounds the unpacked bits of a very long text
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed 64 bits) of each document."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fingerprint(x) for x in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), each, f"doc_id {kind}, fp bigint")


def _keys(prints: DataFrame) -> DataFrame:
    first = F.shiftrightunsigned("fp", 32)
    struck = [first.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << j))).bitwiseOR(F.lit(j << 32)) for j in range(32)]
    second = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(32 << 32))
    return prints.select("fp", F.explode(F.array(*struck, second)).alias("key"))


def _near(a: str, b: str, most: int = 2) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fp at most two bits apart, enough to connect all of them."""
    buckets = _keys(prints).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    shared = scratch.save(buckets, "buckets")
    pairs = shared.where("n = 2").where(_near("u", "v")).select("u", "v").distinct()
    crowded = shared.where("n > 2").select("key")
    if crowded.count() <= MOST_BROADCAST:
        crowded = F.broadcast(crowded)
    members = _keys(prints).join(crowded, "key", "left_semi").select("fp").distinct()
    flips = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << j if j < 63 else -(1 << 63))) for j in range(64))]
    balls = members.select("fp", F.explode(F.array(*flips)).alias("key")).groupBy("key").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("own"))
    stars = balls.where(F.size("own") > 1).select("u", F.explode("own").alias("v")).where("u <> v").where(_near("u", "v"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs.

    Rows link where their fingerprints differ in at most two bits; component_id is the least doc_id
    that links reach, the row's own included. A null, empty or wordless text has fingerprint zero and
    links like any other; repeated rows stay; a null doc_id takes part but is never the least, so a
    component of null ids alone has a null component_id. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs), "prints")
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = connected_components(links(distinct, scratch).toDF("a", "b")).toDF("fp", "root")
    joined = scratch.save(distinct.join(roots, "fp").select("fp", "low", "root"), "joined")
    least = joined.groupBy("root").agg(F.min("low").alias("least"))
    linked = joined.join(least, "root").select("fp", "least")
    alone = distinct.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("low").alias("least"))
    found = linked.unionByName(alone)
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))
