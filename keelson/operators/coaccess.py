"""The co-access graph: which keys are read together, and how often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.config import ReadTracking
from keelson.functions.scalars import high, low
from keelson.session import numbered

#: Decayed edges at or below this are dropped.
FLOOR = 1e-12


def bounded_queries(batches: DataFrame, tracking: ReadTracking = ReadTracking(), by: list[str] | None = None) -> DataFrame:
    """batch, keys: a batch's distinct keys, sorted, cut to the tracked number; only batches with two or more."""
    by = by or ["batch_id"]
    if not tracking.enabled:
        batches = batches.where("false")
    # cut before keys are gathered, on the batch's own shuffle; Spark cuts each task's rows ahead of it, too
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy("key"))
    first = batches.select(*by, "key").withColumn("_place", place).where(F.col("_place") <= tracking.max_keys_per_session)
    return first.groupBy(*by).agg(F.array_sort(F.collect_set("key")).alias("keys")).where(F.size("keys") >= 2)


def session_queries(events: DataFrame, tracking: ReadTracking = ReadTracking(), by: list[str] | None = None, order: str = "pos") -> DataFrame:
    """The same for sessions, whose first keys count, repeats included, before they are made distinct."""
    by = by or ["session_id"]
    first = events.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_rank") <= tracking.max_keys_per_session)
    return bounded_queries(first, tracking, by)


def _pairs(keys: Column, most: int) -> Column:
    """Pairs i < j of an array in order, the first `most`."""
    with_later = lambda a, i: F.transform(F.slice(keys, i + 2, F.size(keys)), lambda b: F.struct(a.alias("a"), b.alias("b")))
    return F.slice(F.flatten(F.transform(keys, with_later)), 1, most)


def query_pairs(queries: DataFrame, tracking: ReadTracking = ReadTracking()) -> DataFrame:
    """a, b of each pair of a query (.., keys), at most max_pair_inserts_per_query of each."""
    rest = [c for c in queries.columns if c != "keys"]
    paired = queries.select(*rest, F.explode(_pairs(F.col("keys"), tracking.max_pair_inserts_per_query)).alias("p"))
    return paired.select(*rest, F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def add_weights(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of weights by undirected pair; self-pairs and zero weights don't count."""
    clean = pairs.where("a <> b AND weight <> 0").select(*(by or []), low("a", "b").alias("a"), high("a", "b").alias("b"), "weight")
    return clean.groupBy(*(by or []), "a", "b").agg(F.sum("weight").alias("weight"))


def edges(queries: DataFrame, tracking: ReadTracking = ReadTracking(), by: list[str] | None = None) -> DataFrame:
    """The graph of queries. Sums are partial before the shuffle, so a hot pair sends one row a task."""
    return add_weights(query_pairs(queries, tracking).withColumn("weight", F.lit(float(tracking.pair_weight))), by)


def track(batches: DataFrame, tracking: ReadTracking = ReadTracking(), by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The graph of read batches; keys without a record count too. `keep` columns part several graphs."""
    return edges(bounded_queries(batches, tracking, by), tracking, keep)


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edge-wise sum of two graphs; no cap is enforced."""
    return add_weights(first.select("a", "b", "weight").unionByName(second.select("a", "b", "weight")))


def decay(graph: DataFrame, factor: float) -> DataFrame:
    return graph.withColumn("weight", F.col("weight") * F.lit(factor)).where(F.col("weight") > FLOOR)


def prune_weakest(graph: DataFrame, share: float = 0.1) -> DataFrame:
    """graph without its weakest `share` of edges (rounded up); equal weights go in order of (a, b)."""
    ranked = numbered(graph, ["weight", "a", "b"], "_rank")
    total = ranked.count()
    dropped = -(-int(round(total * share * 1e9)) // 10**9)
    return ranked.where(F.col("_rank") >= dropped).drop("_rank")


def keep_strongest(graph: DataFrame, most: int) -> DataFrame:
    """The `most` strongest edges: what a capped graph holds if the cap is applied once, at the end."""
    if graph.count() <= most:
        return graph
    ranked = numbered(graph.withColumn("_down", -F.col("weight")), ["_down", "a", "b"], "_rank")
    return ranked.where(F.col("_rank") < most).drop("_rank", "_down")


def snapshot(graph: DataFrame) -> DataFrame:
    return graph.orderBy("a", "b")


def statistics(graph: DataFrame) -> DataFrame:
    """edge_count, max_weight (0 at least) and total_weight."""
    return graph.agg(F.count(F.lit(1)).alias("edge_count"), F.greatest(F.coalesce(F.max("weight"), F.lit(0.0)), F.lit(0.0)).alias("max_weight"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))


def weights_of(pairs: DataFrame, graph: DataFrame) -> DataFrame:
    """pairs (a, b) with their weight in the graph, 0 where they have none."""
    own = pairs.withColumns({"_low": low("a", "b"), "_high": high("a", "b")})
    known = graph.select(F.col("a").alias("_low"), F.col("b").alias("_high"), "weight")
    return own.join(known, ["_low", "_high"], "left").select(*pairs.columns, F.coalesce("weight", F.lit(0.0)).alias("weight"))
