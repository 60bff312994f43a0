"""Layout planning: strongly connected keys are packed into groups that are worth moving together."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.config import PlannerConfig
from keelson.operators.components import connected_components
from keelson.session import Scratch, numbered, saved

#: A heaviest edge up to this normalises nothing.
NO_WEIGHT = 1e-15
#: Edges of a component that one task walks.
MOST_WALKED = 500_000
CHUNKS = "component bigint, chunk int, keys array<bigint>"


def normalization(graph: DataFrame) -> float:
    """The heaviest edge, or 1 where there is none to speak of. One number."""
    heaviest = graph.agg(F.max("weight")).first()[0]
    return float(heaviest) if heaviest is not None and heaviest > NO_WEIGHT else 1.0


def affinities(graph: DataFrame, norm: float | None = None) -> DataFrame:
    """Edges with affinity: weight by the heaviest weight."""
    return graph.withColumn("affinity", F.col("weight") / F.lit(normalization(graph) if norm is None else norm))


def strong(graph: DataFrame, threshold: float, norm: float | None = None) -> DataFrame:
    return affinities(graph, norm).where(F.col("affinity") >= threshold)


def adjacency(strong_edges: DataFrame) -> DataFrame:
    """key, neighbours (ascending)."""
    both = strong_edges.select("a", "b").unionByName(strong_edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("key")).agg(F.array_sort(F.collect_set("b")).alias("neighbours"))


def visit(edges: list[tuple[int, int]]) -> list[list[int]]:
    """Components in breadth-first order: from the least unseen key, neighbours ascending."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    seen, found = set(), []
    for start in sorted(near):
        if start in seen:
            continue
        seen.add(start)
        order, waiting = [], deque([start])
        while waiting:
            key = waiting.popleft()
            order.append(key)
            for other in sorted(set(near[key])):
                if other not in seen:
                    seen.add(other)
                    waiting.append(other)
        found.append(order)
    return found


def chunk(order: list[int], sizes: dict[int, int], most_keys: int, most_bytes: int) -> list[list[int]]:
    """Cut a visit order into runs within both limits; a run's first key is always taken."""
    chunks: list[list[int]] = []
    held = 0
    for key in order:
        size = sizes.get(key, 0)
        if chunks and len(chunks[-1]) < most_keys and held + size <= most_bytes:
            chunks[-1].append(key)
            held += size
        else:
            chunks.append([key])
            held = size
    return chunks


def _walked(edges: DataFrame, members: DataFrame, cfg: PlannerConfig) -> DataFrame:
    """component, chunk, keys of components that one task each walks. edges: component, a, b."""
    gathered = edges.groupBy("component").agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    sizes = members.groupBy("component").agg(F.collect_list(F.struct("key", "bytes")).alias("sizes"))

    def pack(frames):
        for frame in frames:
            out = []
            for component, edges, sizes in zip(frame["component"], frame["edges"], frame["sizes"]):
                known = {x["key"]: int(x["bytes"]) for x in sizes}
                for order in visit([(x["a"], x["b"]) for x in edges]):
                    for k, keys in enumerate(chunk(order, known, cfg.max_keys_per_group, cfg.max_bytes_per_group)):
                        if len(keys) > 1:
                            out.append((component, k, keys))
            yield pd.DataFrame(out, columns=["component", "chunk", "keys"])

    return gathered.join(sizes, "component").mapInPandas(pack, CHUNKS)


def visited(edges: DataFrame) -> DataFrame:
    """component, key, level, place: visit() of components of any size, a join a level. edges: component, a, b.

    Keys of a level go by the first of the level before that knows them, then by themselves. Their neighbours
    are in the levels before and after or in their own, so two levels tell which keys are new.
    """
    scratch = Scratch(edges.sparkSession, "visit")
    both = edges.select("component", "a", "b").unionByName(edges.select("component", F.col("b").alias("a"), F.col("a").alias("b")))
    near = scratch.save(both, "near")
    level = lambda df, n: df.select("component", "key", F.lit(n).alias("level"), "place")
    roots = edges.select("component", F.col("component").alias("key")).distinct().withColumn("place", F.lit(0).cast("bigint"))
    levels = [scratch.save(level(roots, 0), "level")]
    while True:
        known = levels[-1].select("component", F.col("key").alias("a"), "place").join(near, ["component", "a"])
        first = known.groupBy("component", F.col("b").alias("key")).agg(F.min("place").alias("parent"))
        for earlier in levels[-2:]:
            first = first.join(earlier.select("key"), "key", "left_anti")
        now = scratch.save(level(numbered(first, ["component", "parent", "key"], "place"), len(levels)), "level")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(now)


def _streamed(edges: DataFrame, members: DataFrame, cfg: PlannerConfig) -> DataFrame:
    """The same for components too large for a task's memory: their visit order is sorted, and cut as it passes by."""

    def cut(frames):
        component, number, held, keys = None, 0, 0, []
        named = ["component", "chunk", "keys"]
        for frame in frames:
            out = []
            for c, key, size in zip(frame["component"].tolist(), frame["key"].tolist(), frame["bytes"].tolist()):
                if c == component and len(keys) < cfg.max_keys_per_group and held + size <= cfg.max_bytes_per_group:
                    keys.append(key)
                    held += size
                    continue
                if len(keys) > 1:
                    out.append((component, number, keys))
                number = number + 1 if c == component else 0
                component, held, keys = c, size, [key]
            yield pd.DataFrame(out, columns=named)
        if len(keys) > 1:
            yield pd.DataFrame([(component, number, keys)], columns=named)

    order = visited(edges).join(members.select("key", F.col("bytes").cast("bigint").alias("bytes")), "key")
    dealt = order.repartition("component").sortWithinPartitions("component", "level", "place")
    return dealt.select("component", "key", "bytes").mapInPandas(cut, CHUNKS)


def _packed(strong_edges: DataFrame, members: DataFrame, cfg: PlannerConfig, most: int | None = None) -> DataFrame:
    """component, chunk, keys (in visit order) of every chunk of two keys or more.

    Components of up to `most` edges are each walked by the task that holds them; the order of larger ones
    is found by joins. Both give the same chunks.
    """
    most = MOST_WALKED if most is None else most
    members = saved(members, "members")
    edges = saved(strong_edges.join(members.select(F.col("key").alias("a"), "component"), "a"), "labelled")
    large = saved(edges.groupBy("component").agg(F.count(F.lit(1)).alias("_edges")).where(F.col("_edges") > most).select("component"), "large")
    if large.isEmpty():
        return _walked(edges, members, cfg)
    part = lambda df, how: df.join(large, "component", how)
    small = _walked(part(edges, "left_anti"), part(members, "left_anti"), cfg)
    return small.unionByName(_streamed(saved(part(edges, "left_semi"), "edges"), part(members, "left_semi"), cfg))


def group_gains(groups: DataFrame, graph: DataFrame, norm: float, hysteresis: float, by: list[str] | None = None) -> DataFrame:
    """Adds gain: the affinities of all edges inside a group, weak ones too, less hysteresis a key. groups: by.., keys."""
    by = by or ["group_id"]
    member = groups.select(*by, F.explode("keys").alias("key"))
    first = member.select(*by, F.col("key").alias("a"))
    second = member.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("key").alias("b"))
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    inside = graph.where("weight > 0").join(first, "a").join(second, "b").where(same)
    sums = inside.groupBy(*by).agg(F.sum(F.col("weight") / F.lit(norm)).alias("_inner"))
    return groups.join(sums, by, "left").withColumn("gain", F.coalesce("_inner", F.lit(0.0)) - F.lit(float(hysteresis)) * F.size("keys")).drop("_inner")


def plan(graph: DataFrame, key_sizes: DataFrame, cfg: PlannerConfig = PlannerConfig()) -> DataFrame:
    """group_id, keys, target_segment_class, expected_gain. Missing sizes count 0; an empty graph gives no groups."""
    graph = saved(graph, "graph")
    norm = normalization(graph)
    edges = saved(strong(graph, cfg.affinity_threshold, norm).select("a", "b"), "strong")
    if edges.isEmpty():
        return graph.sparkSession.createDataFrame([], "group_id int, keys array<bigint>, target_segment_class int, expected_gain double")
    members = connected_components(edges).join(key_sizes.select("key", "bytes"), "key", "left").fillna(0, ["bytes"])
    packed = saved(_packed(edges, members, cfg), "packed")
    good = group_gains(packed, graph, norm, cfg.hysteresis_per_key, ["component", "chunk"]).where(F.col("gain") >= cfg.min_expected_gain)
    ids = numbered(good, ["component", "chunk"], "group_id").withColumn("group_id", F.col("group_id").cast("int"))
    return ids.select("group_id", "keys", (F.col("group_id") % max(cfg.segment_classes, 1)).alias("target_segment_class"), F.col("gain").alias("expected_gain"))


def summary(groups: DataFrame) -> DataFrame:
    """groups, total_keys, total_gain, overlapping (a key in two groups)."""
    keys = groups.select(F.explode("keys").alias("key")).agg(F.count(F.lit(1)).alias("total_keys"), F.count_distinct("key").alias("_distinct"))
    sums = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("expected_gain"), F.lit(0.0)).alias("total_gain"))
    return sums.join(keys).select("groups", "total_keys", "total_gain", (F.col("total_keys") > F.col("_distinct")).alias("overlapping"))


def assigned_keys(groups: DataFrame) -> DataFrame:
    return groups.select("group_id", F.explode("keys").alias("key"))
