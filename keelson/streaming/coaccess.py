"""The co-access graph of a stream of queries.

Three forms: a streaming aggregation (edge sums in update mode), a sink that keeps the whole graph as a
table with decay between micro-batches, and the capped graph whose insertions prune it, which depends on
their order and so lives in the state of one key.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keelson.config import ReadTracking
from keelson.operators import coaccess


def bounded(queries: DataFrame, tracking: ReadTracking = ReadTracking()) -> DataFrame:
    """Queries (.., keys) with their keys distinct, sorted and cut; row by row, so it streams."""
    keys = F.slice(F.array_sort(F.array_distinct("keys")), 1, tracking.max_keys_per_session)
    made = queries.withColumn("keys", keys).where(F.size("keys") >= 2)
    return made if tracking.enabled else made.where("false")


def streaming_edges(queries: DataFrame, tracking: ReadTracking = ReadTracking()) -> DataFrame:
    """Edge sums of a stream; write in update or complete mode. Stateful by pair, as event time plays no part."""
    pairs = coaccess.query_pairs(bounded(queries, tracking).select("keys"), tracking)
    return pairs.groupBy("a", "b").agg(F.sum(F.lit(float(tracking.pair_weight))).alias("weight"))


class GraphSink:
    """foreachBatch sink: merges each micro-batch into a graph table, decaying it before if asked.

    A batch writes a new version and then moves the pointer; a batch that is replayed is recognised by its
    id and skipped, so that every query counts once.
    """

    def __init__(self, spark: SparkSession, folder: str, tracking: ReadTracking = ReadTracking(), decay: float | None = None):
        self._spark, self._folder, self._tracking, self._decay = spark, folder, tracking, decay
        os.makedirs(folder, exist_ok=True)

    def _pointer(self) -> dict:
        path = os.path.join(self._folder, "CURRENT.json")
        if not os.path.exists(path):
            return {"version": None, "batch": -1}
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def graph(self) -> DataFrame:
        version = self._pointer()["version"]
        if version is None:
            return self._spark.createDataFrame([], "a bigint, b bigint, weight double")
        return self._spark.read.schema("a bigint, b bigint, weight double").parquet(os.path.join(self._folder, version))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        now = self._pointer()
        if batch_id <= now["batch"]:
            return
        before = self.graph()
        if self._decay is not None:
            before = coaccess.decay(before, self._decay)
        made = coaccess.merge(before, coaccess.edges(bounded(batch, self._tracking).select("keys"), self._tracking))
        version = f"graph-{batch_id}"
        path = os.path.join(self._folder, version)
        made.write.mode("overwrite").parquet(path)
        pointer = os.path.join(self._folder, "CURRENT.json")
        with open(f"{pointer}.tmp", "w", encoding="utf-8") as f:
            json.dump({"version": version, "batch": batch_id}, f)
        os.replace(f"{pointer}.tmp", pointer)
        if now["version"] and now["version"] != version:
            shutil.rmtree(os.path.join(self._folder, now["version"]), ignore_errors=True)


class CappedGraph:
    """Edges up to a cap. A new edge at the cap first drops the weakest tenth (ties by a, b), and is itself dropped if that made no room."""

    def __init__(self, most: int, edges: dict[tuple[int, int], float] | None = None):
        self.most, self.edges = most, edges or {}

    def add(self, a: int, b: int, weight: float) -> None:
        if a == b or weight == 0:
            return
        pair = (min(a, b), max(a, b))
        if pair in self.edges:
            self.edges[pair] += weight
            return
        if len(self.edges) >= self.most:
            self.prune()
        if len(self.edges) < self.most:
            self.edges[pair] = weight

    def prune(self) -> None:
        for pair in sorted(self.edges, key=lambda p: (self.edges[p], p))[: -(-len(self.edges) // 10)]:
            del self.edges[pair]

    def decay(self, factor: float) -> None:
        self.edges = {p: w * factor for p, w in self.edges.items() if w * factor > coaccess.FLOOR}


def _rows(graph: CappedGraph, graph_id: int) -> pd.DataFrame:
    return pd.DataFrame([(graph_id, a, b, w) for (a, b), w in sorted(graph.edges.items())], columns=["graph_id", "a", "b", "weight"])


CAPPED_SCHEMA = "graph_id bigint, a bigint, b bigint, weight double"


def capped_edges(pairs: DataFrame, most: int) -> DataFrame:
    """The capped graphs of weighted pairs (graph_id, seq, a, b, weight), inserted by seq. A graph is bounded by its cap."""

    def insert(frame: pd.DataFrame) -> pd.DataFrame:
        graph = CappedGraph(most)
        for r in frame.sort_values("seq").itertuples():
            graph.add(int(r.a), int(r.b), float(r.weight))
        return _rows(graph, int(frame["graph_id"].iloc[0]))

    return pairs.groupBy("graph_id").applyInPandas(insert, CAPPED_SCHEMA)


def streaming_capped_edges(pairs: DataFrame, most: int) -> DataFrame:
    """The same over a stream; every micro-batch returns the whole graphs that it changed (update mode)."""

    def insert(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        graph = CappedGraph(most)
        if state.exists:
            graph.edges = {(a, b): w for a, b, w in json.loads(state.get[0])}
        held = pd.concat(list(frames)).sort_values("seq")
        for r in held.itertuples():
            graph.add(int(r.a), int(r.b), float(r.weight))
        state.update((json.dumps([(a, b, w) for (a, b), w in graph.edges.items()]),))
        yield _rows(graph, int(key[0]))

    return pairs.groupBy("graph_id").applyInPandasWithState(insert, CAPPED_SCHEMA, "edges string", "update", GroupStateTimeout.NoTimeout)
