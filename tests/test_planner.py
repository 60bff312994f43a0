import dataclasses
import random

import pytest

from keelson.config import PlannerConfig
from keelson.operators import planner
from keelson.operators.components import connected_components
from keelson.plans.harness import plan_in_memory

LOOSE = PlannerConfig(max_keys_per_group=64, affinity_threshold=0.5, min_expected_gain=0.0, hysteresis_per_key=0.0)


def graph(spark, rows):
    return spark.createDataFrame([(min(a, b), max(a, b), float(w)) for a, b, w in rows], "a bigint, b bigint, weight double")


def sizes(spark, keys, each=1):
    return spark.createDataFrame([(k, each) for k in keys], "key bigint, bytes bigint")


def made(df):
    return [(r["group_id"], r["keys"], r["target_segment_class"], round(r["expected_gain"], 9)) for r in df.orderBy("group_id").collect()]


FORK = [(1, 9, 5), (1, 2, 5), (2, 5, 5), (5, 9, 1), (20, 21, 4)]


def test_affinity(spark):
    found = {(r["a"], r["b"]): r["affinity"] for r in planner.affinities(graph(spark, [(1, 2, 10), (3, 4, 5)])).collect()}
    assert found == {(1, 2): 1.0, (3, 4): 0.5}
    assert planner.normalization(graph(spark, [])) == 1.0 and planner.normalization(graph(spark, [(1, 2, 1e-16)])) == 1.0


def test_groups_follow_the_visit_order(spark):
    cfg = dataclasses.replace(LOOSE, max_keys_per_group=3)
    assert made(planner.plan(graph(spark, FORK), sizes(spark, range(30)), cfg)) == [(0, [1, 2, 9], 0, 2.0), (1, [20, 21], 1, 0.8)]
    wide = made(planner.plan(graph(spark, FORK), sizes(spark, range(30)), dataclasses.replace(LOOSE, max_keys_per_group=4)))
    assert wide[0] == (0, [1, 2, 9, 5], 0, 3.2)
    assert planner.visit([(1, 9), (1, 2), (3, 9), (2, 7)]) == [[1, 2, 9, 7, 3]]


def test_byte_cap_and_missing_sizes(spark):
    g = graph(spark, [(1, 2, 5), (2, 3, 5), (3, 4, 5)])
    cfg = dataclasses.replace(LOOSE, max_bytes_per_group=20)
    assert [x[1] for x in made(planner.plan(g, sizes(spark, range(9), 10), cfg))] == [[1, 2], [3, 4]]
    assert [x[1] for x in made(planner.plan(g, sizes(spark, []), cfg))] == [[1, 2, 3, 4]]
    assert planner.chunk([1, 2, 3], {1: 99, 2: 1, 3: 1}, 64, 20) == [[1], [2, 3]]


def test_thresholds_can_leave_nothing(spark):
    chain = graph(spark, [(1, 2, 1), (2, 3, 1)])
    for cfg in (dataclasses.replace(LOOSE, affinity_threshold=1.01), dataclasses.replace(LOOSE, hysteresis_per_key=100.0, min_expected_gain=1e9)):
        found = planner.plan(chain, sizes(spark, range(4)), cfg)
        assert made(found) == [] and tuple(planner.summary(found).first()) == (0, 0, 0.0, False)
    assert made(planner.plan(graph(spark, []), sizes(spark, []), LOOSE)) == []


def test_clique_and_pairs_do_not_overlap(spark):
    clique = [(a, b, 50) for a in range(10, 20) for b in range(a + 1, 20)]
    found = made(planner.plan(graph(spark, clique), sizes(spark, range(30)), dataclasses.replace(LOOSE, max_keys_per_group=8)))
    keys = [k for _, ks, *_ in found for k in ks]
    assert [len(ks) for _, ks, *_ in found] == [8, 2] and len(set(keys)) == len(keys)
    pairs = made(planner.plan(graph(spark, [(1, 2, 100), (10, 11, 100), (20, 21, 100)]), sizes(spark, range(30)), dataclasses.replace(LOOSE, max_keys_per_group=2)))
    assert [ks for _, ks, *_ in pairs] == [[1, 2], [10, 11], [20, 21]]


@pytest.mark.parametrize("seed", [1, 2])
def test_distributed_plan_equals_the_plan_in_memory(spark, seed):
    rng = random.Random(seed)
    known = {}
    for _ in range(120):
        a, b = sorted(rng.sample(range(80), 2))
        known[a, b] = rng.randrange(1, 9)
    cfg = PlannerConfig(max_keys_per_group=5, affinity_threshold=0.6, min_expected_gain=0.4, hysteresis_per_key=0.02, max_bytes_per_group=300)
    each = {k: rng.randrange(20, 120) for k in range(80)}
    rows = [(a, b, w) for (a, b), w in known.items()]
    found = planner.plan(graph(spark, rows), spark.createDataFrame(list(each.items()), "key bigint, bytes bigint"), cfg)
    assert made(found) == [(g, k, c, round(x, 9)) for g, k, c, x in plan_in_memory(rows, each, cfg)]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(k, k + 1) for k in range(0, 60)]
    hub = [(1000, k) for k in range(1001, 1400)]
    found = {r["key"]: r["component"] for r in connected_components(spark.createDataFrame(chain + hub, "a bigint, b bigint")).collect()}
    assert found == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1400)}


@pytest.mark.parametrize("most", [0, 6, 10**6])
def test_large_components_are_cut_like_small_ones(spark, most):
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(base, base + n), 2))) for base, n, m in ((0, 60, 90), (100, 30, 29), (200, 4, 3), (300, 12, 20)) for _ in range(m)})
    edges += [(400 + k, 401 + k) for k in range(9)]
    each = {k: rng.randrange(1, 50) for k in range(500) if k % 7}
    strong = spark.createDataFrame(edges, "a bigint, b bigint")
    members = connected_components(strong).join(spark.createDataFrame(list(each.items()), "key bigint, bytes bigint"), "key", "left").fillna(0, ["bytes"])
    cfg = PlannerConfig(max_keys_per_group=4, max_bytes_per_group=90)
    expected = {(min(o), k, tuple(c)) for o in planner.visit(edges) for k, c in enumerate(planner.chunk(o, each, 4, 90)) if len(c) > 1}
    assert {(r["component"], r["chunk"], tuple(r["keys"])) for r in planner._packed(strong, members, cfg, most).collect()} == expected
