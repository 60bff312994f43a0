import dataclasses

import pytest

from keelson.config import ReadTracking
from keelson.operators import coaccess
from keelson.streaming.coaccess import CappedGraph, capped_edges

T = ReadTracking()


def batches(spark, *queries):
    return spark.createDataFrame([(b, i, k) for b, q in enumerate(queries) for i, k in enumerate(q)], "batch_id bigint, pos int, key bigint")


def edges(df):
    return {(r["a"], r["b"]): r["weight"] for r in df.collect()}


def test_bounded_keys(spark):
    cut = dataclasses.replace(T, max_keys_per_session=3)
    assert coaccess.bounded_queries(batches(spark, range(9, -1, -1)), cut).first()["keys"] == [0, 1, 2]
    assert coaccess.bounded_queries(batches(spark, [5, 5]), T).count() == 0
    assert coaccess.bounded_queries(batches(spark, [1, 2]), dataclasses.replace(T, enabled=False)).count() == 0


def test_pairs_in_order_and_capped(spark):
    q = coaccess.bounded_queries(batches(spark, [3, 1, 2]), T)
    assert [(r["a"], r["b"]) for r in coaccess.query_pairs(q, T).collect()] == [(1, 2), (1, 3), (2, 3)]
    three = dataclasses.replace(T, max_pair_inserts_per_query=3)
    assert edges(coaccess.track(batches(spark, [1, 2, 3, 4, 5]), three)) == {(1, 2): 1.0, (1, 3): 1.0, (1, 4): 1.0}


def test_weights_accumulate_merge_and_decay(spark):
    assert edges(coaccess.track(batches(spark, *[[10, 11]] * 5), T)) == {(10, 11): 5.0}
    raw = spark.createDataFrame([(3, 7, 1.0), (7, 3, 2.0), (4, 4, 9.0), (1, 2, 0.0)], "a bigint, b bigint, weight double")
    graph = coaccess.add_weights(raw)
    assert edges(graph) == {(3, 7): 3.0}
    assert edges(coaccess.merge(graph, graph)) == {(3, 7): 6.0}
    assert edges(coaccess.decay(graph, 0.5)) == {(3, 7): 1.5}
    assert edges(coaccess.decay(graph, 1e-13)) == {}


def test_session_caps_before_it_makes_keys_distinct(spark):
    events = spark.createDataFrame([(1, i, k) for i, k in enumerate([9, 9, 5, 7])], "session_id bigint, pos int, key bigint")
    cut = dataclasses.replace(T, max_keys_per_session=3)
    assert coaccess.session_queries(events, cut).first()["keys"] == [5, 9]


def test_prune_and_cap(spark):
    graph = spark.createDataFrame([(1, k, float(k % 3)) for k in range(2, 27)], "a bigint, b bigint, weight double")
    left = edges(coaccess.prune_weakest(graph))
    assert len(left) == 22 and not {(1, 3), (1, 6), (1, 9)} & set(left)
    assert edges(coaccess.keep_strongest(graph, 2)) == {(1, 2): 2.0, (1, 5): 2.0}
    assert len(edges(coaccess.keep_strongest(graph, 100))) == 25


def test_statistics_and_lookup(spark):
    graph = spark.createDataFrame([(1, 2, 4.0), (2, 3, 1.0)], "a bigint, b bigint, weight double")
    assert tuple(coaccess.statistics(graph).first()) == (2, 4.0, 5.0)
    assert tuple(coaccess.statistics(graph.where("false")).first()) == (0, 0.0, 0.0)
    pairs = spark.createDataFrame([(2, 1), (1, 3)], "a bigint, b bigint")
    assert edges(coaccess.weights_of(pairs, graph)) == {(2, 1): 4.0, (1, 3): 0.0}


def test_capped_insertion(spark):
    pairs = []
    for r in range(100):
        keys = sorted({(r * 7 + i) % 200 for i in range(30)})
        pairs += [(0, len(pairs) + n, a, b, 1.0) for n, (a, b) in enumerate((a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])]
    pairs = [(g, n, a, b, w) for n, (g, _, a, b, w) in enumerate(pairs[:6000])]
    plain = CappedGraph(50)
    for _, _, a, b, w in pairs:
        plain.add(a, b, w)
    assert len(plain.edges) <= 50
    found = capped_edges(spark.createDataFrame(pairs, "graph_id bigint, seq bigint, a bigint, b bigint, weight double"), 50)
    assert edges(found) == plain.edges


@pytest.mark.parametrize("most, expected", [(2, {(1, 2): 5.0, (3, 4): 1.0}), (1, {(3, 4): 1.0})])
def test_a_new_edge_at_the_cap_drops_the_weakest(most, expected):
    graph = CappedGraph(most)
    for a, b, w in ((1, 2, 5.0), (2, 1, 0.0), (7, 7, 1.0), (5, 6, 1.0), (3, 4, 1.0)):
        graph.add(a, b, w)
    assert graph.edges == expected
