"""Moving records: planned groups are rewritten into segments of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.errors import InternalError
from keelson.operators.layout import offsets
from keelson.operators.versions import select_for_rewrite, wanted


def relocate_group(log: DataFrame, keys: DataFrame, segment_id: int) -> DataFrame:
    """The rows that rewriting a group appends: its latest records, tombstones too, in ascending key order."""
    if keys.isEmpty():
        raise InternalError("no keys to relocate")
    moved = select_for_rewrite(log, keys).withColumn("segment_id", F.lit(segment_id).cast("bigint")).drop("offset")
    return offsets(moved, ["key"]).select(*log.columns)


def relocate_plan(log: DataFrame, groups: DataFrame, first_segment: int) -> DataFrame:
    """The rows that rewriting whole groups appends, group k (by group_id) going to segment first_segment + k.

    One pass for all groups: each record finds its group by its key and its place by a running sum in
    that group, which is bounded by the plan's limits.
    """
    target = groups.select((F.lit(first_segment) + F.col("group_id")).cast("bigint").alias("segment_id"), F.explode("keys").alias("key"))
    moved = select_for_rewrite(log, target).drop("segment_id", "offset").join(target, "key")
    return offsets(moved, ["key"]).select(*log.columns)


def apply_moves(log: DataFrame, moved: DataFrame) -> DataFrame:
    """The log with moved rows appended; equal versions in later segments win, so the index follows."""
    return log.unionByName(moved)


def relocation_facts(groups: DataFrame, idx: DataFrame, first_segment: int) -> DataFrame:
    """group_id, segment_id, keys, source_segments, bytes_written of relocate_plan()."""
    keys = groups.select("group_id", F.explode("keys").alias("key"))
    held = keys.join(wanted(idx, keys), "key")
    sums = held.groupBy("group_id").agg(F.sort_array(F.collect_set("segment_id")).alias("source_segments"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_written"))
    return groups.join(sums, "group_id", "left").select("group_id", (F.lit(first_segment) + F.col("group_id")).cast("bigint").alias("segment_id"), "keys", "source_segments", F.coalesce("bytes_written", F.lit(0)).alias("bytes_written"))
