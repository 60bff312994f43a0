"""Where records lie: segments by rotation, offsets by running sums, and checks of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.schemas import SEGMENT_HEADER


def offsets(rows: DataFrame, order: list[str], start: int = SEGMENT_HEADER) -> DataFrame:
    """Adds offset: `start` plus the sizes before a row in its segment_id. A segment is bounded by its rotation."""
    before = Window.partitionBy("segment_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", (F.lit(start) + F.coalesce(F.sum("size").over(before), F.lit(0))).cast("bigint"))


def rotate(rows: DataFrame, seq: str, every: int, first: int = 1) -> DataFrame:
    """Adds segment_id: a new segment after each `every` rows by seq (dense from 0); 0 never rotates."""
    step = F.floor(F.col(seq) / every) if every > 0 else F.lit(0)
    return rows.withColumn("segment_id", (F.lit(first) + step).cast("bigint"))


def append(rows: DataFrame, seq: str, every: int, first: int = 1) -> DataFrame:
    """segment_id and offset of rows (with size) written in the order of seq."""
    return offsets(rotate(rows, seq, every, first), [seq])


def contiguity(rows: DataFrame, start: int = SEGMENT_HEADER) -> DataFrame:
    """segment_id, contiguous, valid_prefix, end: whether offsets follow each other from `start` on.

    valid_prefix counts the records before the first break (or before a row whose `ok` is false, where
    rows have that column); end is where the last of them ends.
    """
    order = Window.partitionBy("segment_id").orderBy("offset")
    after = F.coalesce(F.lag(F.col("offset") + F.col("size")).over(order), F.lit(start))
    good = (F.col("offset") == after) & (F.col("ok") if "ok" in rows.columns else F.lit(True))
    broken = F.sum(F.when(good, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("_valid", broken == 0)
    end = F.coalesce(F.max(F.when(F.col("_valid"), F.col("offset") + F.col("size"))), F.lit(start))
    return marked.groupBy("segment_id").agg(F.bool_and("_valid").alias("contiguous"), F.count_if("_valid").alias("valid_prefix"), end.alias("end"))
