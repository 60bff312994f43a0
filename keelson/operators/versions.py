"""Latest-version-wins views of a record log, and batched lookups against them.

A log row is key, version, flags, payload, segment_id, offset, size. Of a key's rows the greatest
(version, segment_id, offset) wins; tombstones take part, stay in the index, and are hidden only when
a value is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.scalars import is_tombstone
from keelson.session import saved

ORDER = ("version", "segment_id", "offset")


def latest(log: DataFrame, by: tuple[str, ...] = ("key",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row per key. Partial maxima are taken before the shuffle, so a hot key sends one row a task."""
    rest = [c for c in log.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return log.groupBy(*by).agg(best).select(*by, "_best.*").select(*log.columns)


def index(log: DataFrame) -> DataFrame:
    """Where each key's latest record is; payloads are never read. Tombstones included."""
    return latest(log.select("key", "segment_id", "offset", "version", "flags", "size"))


def live(log: DataFrame) -> DataFrame:
    """Latest records that are not tombstones."""
    return latest(log).where(~is_tombstone())


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).where(is_tombstone())


def replay_report(log: DataFrame) -> DataFrame:
    """Records seen, keys, live keys and tombstones: one row."""
    keys = latest(log.select("key", *ORDER, "flags")).agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(is_tombstone()).alias("tombstones"), F.count_if(~is_tombstone()).alias("live_keys")
    )
    return keys.join(log.agg(F.count(F.lit(1)).alias("records_verified"))).select("records_verified", "keys", "live_keys", "tombstones")


def get(log: DataFrame, key: int) -> DataFrame:
    """The live record of one key, or no row. The key is a filter that reaches the scan."""
    return live(log.where(F.col("key") == key))


def wanted(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The part of the log that a set of keys can touch; a small set filters the scan's rows before any shuffle.

    The set is written, so that a larger one meets the log in a join of two plain shuffles: Spark can split a
    key with many records there.
    """
    return log.join(saved(keys.select("key").distinct(), "keys"), "key", "left_semi")


def get_many(batches: DataFrame, log: DataFrame) -> DataFrame:
    """batch_id, pos, key, found, version, payload for each requested place, misses and duplicates included.

    A tombstone is found (it was read) but has no version or payload. Order by batch_id and pos for the
    order of the request. The records are written before the join, which lets Spark split a key that many ask for.
    """
    rows = saved(latest(wanted(log, batches).select("key", "version", "flags", "payload", "segment_id", "offset")), "records")
    seen = rows.select("key", F.lit(True).alias("found"), is_tombstone().alias("_dead"), "version", "payload")
    shown = lambda c: F.when(~F.col("_dead"), F.col(c)).alias(c)
    return batches.join(seen, "key", "left").select("batch_id", "pos", "key", F.coalesce("found", F.lit(False)).alias("found"), shown("version"), shown("payload"))


def locate(batches: DataFrame, idx: DataFrame) -> DataFrame:
    """Requested places that have a record: batch columns with its segment_id, offset and size. Misses cost nothing.

    Write idx first if it is an aggregate, as index() is: Spark splits hot keys only between plain shuffles.
    """
    return batches.join(idx.select("key", "segment_id", "offset", "size"), "key")


def select_for_rewrite(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Latest records of distinct keys, tombstones included; absent keys are skipped."""
    return latest(wanted(log, keys))


def source_segments(idx: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct segments that hold the keys, ascending."""
    return wanted(idx, keys).select("segment_id").distinct().orderBy("segment_id")


def references_segment(idx: DataFrame, segment_id: int) -> bool:
    return not idx.where(F.col("segment_id") == segment_id).isEmpty()


def stale_segments(segments: DataFrame, idx: DataFrame, active: int | None = None) -> DataFrame:
    """Segments that no key refers to, less the one being written."""
    free = segments.join(idx.select("segment_id").distinct(), "segment_id", "left_anti")
    return free if active is None else free.where(F.col("segment_id") != active)


def fingerprint(idx: DataFrame) -> DataFrame:
    """A hash of the whole index that doesn't depend on row order: sums of row hashes, so nothing is gathered."""
    row = F.xxhash64("key", "version", "segment_id", "offset")
    other = F.xxhash64(F.lit(1), "key", "version", "segment_id", "offset")
    part = lambda h, at: F.coalesce(F.sum(F.shiftrightunsigned(h, at).bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0))
    return idx.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)), part(row, 0), part(row, 32), part(other, 0), part(other, 32)), 256).alias("fingerprint"))


