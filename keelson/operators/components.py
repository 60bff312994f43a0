"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import Scratch


def _large(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join reads two plain shuffles, whose hot keys Spark can split
    least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = scratch.save(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    lower = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least


def _settled(pairs: DataFrame) -> bool:
    """Whether pairs are stars: each u has one v, and no v is a u."""
    ends = pairs.select(F.col("u").alias("k"), F.lit(1).alias("lower"), F.lit(0).alias("root")).unionByName(pairs.select(F.col("v").alias("k"), F.lit(0).alias("lower"), F.lit(1).alias("root")))
    return ends.groupBy("k").agg(F.sum("lower").alias("lower"), F.max("root").alias("root")).where("lower + root > 1").isEmpty()


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(key, component): the least key of each key's component, for the keys of edges(a, b).

    Each step is written to the shared folder, and deleted once the next one is there. A hub's neighbours
    are never gathered: minima are partial, and the joins are of the kind whose hot keys Spark can split.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most):
        if _settled(now):
            roots = now.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("key"), F.col("v").alias("component")).unionByName(roots)
        for step in (_large, _small):
            made, least = step(now, scratch)
            made = scratch.save(made, "stars")
            scratch.drop(now, least)
            now = made
    raise RuntimeError(f"components did not settle in {most} rounds")
