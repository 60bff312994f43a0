"""The cost of reading: neighbouring records of a batch are merged into ranges.

Within a batch and segment, by offset, a record joins the open range if the gap to its end is at most
max_read_gap_bytes and the whole stays within max_range_bytes; else it opens the next. Whether a record
joins depends on the range so far, so counting is a fold; it runs over one array per batch, in the JVM, after
a single shuffle by batch. A batch is bounded (a request), so its array is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.config import ReadMergePolicy
from keelson.functions.scalars import ratio
from keelson.operators.versions import locate

COUNTERS = (
    "records_found", "bytes_read", "segments_touched", "file_opens", "segment_groups", "offsets_span_total", "range_read_ops", "physical_read_ops",
    "range_bytes_read", "physical_bytes_read", "records_in_ranges", "range_merges", "gap_bytes_merged",
)


def _joins(acc: Column, x: Column, policy: ReadMergePolicy) -> Column:
    gap = F.greatest(F.lit(0), x["offset"] - acc["end"])
    reach = F.greatest(acc["end"], x["offset"] + x["size"]) - acc["start"]
    return (acc["segment"] == x["segment_id"]) & (gap <= policy.max_read_gap_bytes) & (reach <= policy.max_range_bytes)


def _fold(rows: str, policy: ReadMergePolicy) -> Column:
    """All counters of one batch from its sorted (segment_id, offset, size) array."""
    zero = F.lit(0).cast("bigint")
    names = ("records", "bytes", "opens", "span", "ranges", "covered", "merges", "gaps", "pairs", "in_segment", "first", "start", "end")
    begin = F.struct(*[zero.alias(n) for n in names], F.lit(None).cast("bigint").alias("segment"))

    def step(acc: Column, x: Column) -> Column:
        same = F.coalesce(acc["segment"] == x["segment_id"], F.lit(False))
        joins = F.coalesce(_joins(acc, x, policy), F.lit(False))
        end = x["offset"] + x["size"]
        gap = F.greatest(zero, x["offset"] - acc["end"])
        reach = F.greatest(acc["end"], end)
        made = {
            "records": acc["records"] + 1,
            "bytes": acc["bytes"] + x["size"],
            "opens": acc["opens"] + F.when(same, 0).otherwise(1),
            # offsets ascend, so a segment's span grows by the step from the record before
            "span": acc["span"] + F.when(same, x["offset"] - acc["first"]).otherwise(0),
            "ranges": acc["ranges"] + F.when(joins, 0).otherwise(1),
            "covered": acc["covered"] + F.when(joins, reach - acc["end"]).otherwise(x["size"]),
            "merges": acc["merges"] + F.when(joins, 1).otherwise(0),
            "gaps": acc["gaps"] + F.when(joins, gap).otherwise(0),
            "pairs": acc["pairs"] + F.when(same, acc["in_segment"]).otherwise(0),
            "in_segment": F.when(same, acc["in_segment"] + 1).otherwise(1),
            "first": x["offset"],
            "start": F.when(joins, acc["start"]).otherwise(x["offset"]),
            "end": F.when(joins, reach).otherwise(end),
        }
        return F.struct(*[made[n].cast("bigint").alias(n) for n in names], x["segment_id"].alias("segment"))

    return F.aggregate(rows, begin, step)


def batch_counters(located: DataFrame, by: list[str], policy: ReadMergePolicy = ReadMergePolicy()) -> DataFrame:
    """Read counters of each batch from located rows (by.., segment_id, offset, size): COUNTERS and colocated_pair_ratio."""
    own = F.sort_array(F.collect_list(F.struct("segment_id", "offset", "size"))).alias("_rows")
    folded = located.groupBy(*by).agg(own).withColumn("_f", _fold("_rows", policy))
    f = lambda n: F.col(f"_f.{n}")
    columns = {
        "records_found": f("records"), "bytes_read": f("bytes"), "segments_touched": f("opens"), "file_opens": f("opens"), "segment_groups": f("opens"),
        "offsets_span_total": f("span"), "range_read_ops": f("ranges"), "physical_read_ops": f("ranges"), "range_bytes_read": f("covered"),
        "physical_bytes_read": f("covered"), "records_in_ranges": f("records"), "range_merges": f("merges"), "gap_bytes_merged": f("gaps"),
    }
    n = f("records")
    coloc = F.when(n < 2, F.lit(0.0)).otherwise(f("pairs") / (n * (n - 1) / 2))
    return folded.select(*by, *[c.alias(k) for k, c in columns.items()], coloc.alias("colocated_pair_ratio"))


def io_counters(batches: DataFrame, idx: DataFrame, policy: ReadMergePolicy = ReadMergePolicy(), by: list[str] | None = None) -> DataFrame:
    """batch_counters() of batches against an index; a batch whose keys are all misses has zeros."""
    by = by or ["batch_id"]
    asked = batches.groupBy(*by).agg(F.count(F.lit(1)).alias("reads"))
    found = batch_counters(locate(batches, idx), by, policy)
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS]
    return asked.join(found, by, "left").select(*by, "reads", *filled, F.coalesce("colocated_pair_ratio", F.lit(0.0)).alias("colocated_pair_ratio"))


def merged_ranges(located: DataFrame, by: list[str], policy: ReadMergePolicy = ReadMergePolicy()) -> DataFrame:
    """The ranges themselves: by.., segment_id, start, end, records.

    A record too far from all before it opens a range whatever those before are. Between such gaps, a run that
    stays within max_range_bytes is one range. Only a longer run is folded; its closed ranges are few, as one
    and the record that follows it exceed the limit together.
    """
    ordered = Window.partitionBy(*by, "segment_id").orderBy("offset", "size")
    end = F.col("offset") + F.col("size")
    before = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("offset") - before > policy.max_read_gap_bytes, F.lit(False)).cast("int")
    marked = located.select(*by, "segment_id", "offset", "size", apart.alias("_apart"))
    runs = marked.withColumn("_run", F.sum("_apart").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.sort_array(F.collect_list(F.struct("offset", "size"))).alias("_rows")
    whole = F.struct(F.min("offset").alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("records")).alias("_whole")
    held = runs.groupBy(*by, "segment_id", "_run").agg(whole, own)

    one = lambda start, end, n: F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), n.cast("bigint").alias("records"))
    zero = F.lit(0).cast("bigint")
    begin = F.struct(F.array().cast("array<struct<start:bigint,end:bigint,records:bigint>>").alias("done"), one(zero, zero, zero).alias("open"))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"]["records"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def step(acc: Column, x: Column) -> Column:
        now, own_end = acc["open"], x["offset"] + x["size"]
        reach = F.greatest(now["end"], own_end)
        joins = (now["records"] > 0) & (x["offset"] - now["end"] <= policy.max_read_gap_bytes) & (reach - now["start"] <= policy.max_range_bytes)
        opened = F.when(joins, one(now["start"], reach, now["records"] + 1)).otherwise(one(x["offset"], own_end, F.lit(1)))
        return F.struct(F.when(joins, acc["done"]).otherwise(closed(acc)).alias("done"), opened.alias("open"))

    short = F.col("_whole.end") - F.col("_whole.start") <= policy.max_range_bytes
    found = F.when(short, F.array(one(F.col("_whole.start"), F.col("_whole.end"), F.col("_whole.records")))).otherwise(F.aggregate("_rows", begin, step, closed))
    return held.select(*by, "segment_id", F.explode(found).alias("r")).select(*by, F.col("segment_id").cast("bigint").alias("segment_id"), "r.start", "r.end", "r.records")


def predict_reads(groups: DataFrame, idx: DataFrame, policy: ReadMergePolicy = ReadMergePolicy()) -> DataFrame:
    """group_id, ranges, bytes, opens that reading a group's keys (group_id, key) would take; no payload is read."""
    found = batch_counters(locate(groups, idx), ["group_id"], policy)
    every = groups.select("group_id").distinct().join(found, "group_id", "left")
    return every.select("group_id", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("range_read_ops", "ranges"), ("range_bytes_read", "bytes"), ("file_opens", "opens"))])


def colocated_pair_ratio(located: DataFrame, by: list[str]) -> DataFrame:
    """Part of a batch's record pairs that share a segment; 0 for fewer than two records."""
    counts = located.groupBy(*by, "segment_id").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    return counts.groupBy(*by).agg(F.when(n < 2, F.lit(0.0)).otherwise(F.sum(F.col("c") * (F.col("c") - 1) / 2) / (n * (n - 1) / 2)).alias("colocated_pair_ratio"))


def already_colocated(groups: DataFrame, idx: DataFrame, least: float = 1.0) -> DataFrame:
    """group_id, share, colocated: whether one segment holds at least `least` of a group's indexed keys; none indexed: no."""
    found = locate(groups, idx).groupBy("group_id", "segment_id").agg(F.count(F.lit(1)).alias("c"))
    share = found.groupBy("group_id").agg((F.max("c") / F.sum("c")).alias("share"))
    every = groups.select("group_id").distinct().join(share, "group_id", "left")
    return every.select("group_id", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce(F.col("share") >= least, F.lit(False)).alias("colocated"))


def offset_spans(located: DataFrame, by: list[str]) -> DataFrame:
    """Greatest less least start offset of each batch and segment."""
    return located.groupBy(*by, "segment_id").agg((F.max("offset") - F.min("offset")).alias("span"))


MEANS = ("segments_touched", "bytes_read", "colocated_pair_ratio", "file_opens", "physical_read_ops", "physical_bytes_read", "segment_groups", "offsets_span_total", "range_read_ops", "range_bytes_read")


def phase_metrics(samples: DataFrame, by: list[str]) -> DataFrame:
    """Means over batches; ratios are means of each batch's ratio, 0 where its denominator is."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in MEANS]
    ratios = {
        "mean_records_per_range_read": ("records_in_ranges", "range_read_ops"),
        "mean_range_merge_ratio": ("range_merges", "records_in_ranges"),
        "mean_gap_bytes_merged": ("gap_bytes_merged", "range_merges"),
    }
    means += [F.coalesce(F.avg(ratio(a, b)), F.lit(0.0)).alias(n) for n, (a, b) in ratios.items()]
    return (samples.groupBy(*by) if by else samples.groupBy()).agg(F.count(F.lit(1)).alias("query_count"), *means)
