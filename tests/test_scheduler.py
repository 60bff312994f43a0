import pytest

from keelson.config import SchedulerConfig
from keelson.errors import InternalError
from keelson.operators import relocation, scheduler, versions
from keelson.schemas import RECORDS


def test_budget():
    cfg = SchedulerConfig(max_bytes_rewritten_per_cycle=1000, max_groups_relocated_per_cycle=5, cpu_budget_share=0.5)
    b = scheduler.effective_budget(cfg)
    assert (b.max_bytes, b.max_groups) == (500, 2)
    assert b.allows(0, 0, 400) and not b.allows(400, 0, 200) and not b.allows(0, 2, 1)


def test_triggers(spark):
    cfg = SchedulerConfig()
    df = spark.createDataFrame([(400_000, 500_000, 50, 10.0), (0, 0, 1, 3.0), (0, 10, 1, 0.0)], "edge_count bigint, max_graph_edges bigint, segment_count bigint, plan_total_gain double")
    found = scheduler.triggers_fired(df, cfg).orderBy("segment_count", "plan_total_gain").collect()
    assert [r["fired"] for r in found] == [[], ["LocalityGain"], list(scheduler.TRIGGERS)]
    assert [r["primary"] for r in found] == [None, "LocalityGain", "Fragmentation"]
    assert scheduler.primary_trigger(400_000, 500_000, 50, 10.0, cfg) == "Fragmentation"
    assert scheduler.primary_trigger(0, 0, 0, 0.0, cfg) is None


def group(gid, keys, gain, size=10, colocated=False):
    return {"group_id": gid, "keys": keys, "expected_gain": gain, "estimated_bytes": size, "colocated": colocated}


def test_walk_guards_budget_and_cooldown():
    cfg = SchedulerConfig(max_bytes_rewritten_per_cycle=100, max_groups_relocated_per_cycle=2, cpu_budget_share=1.0, minimum_improvement_delta=0.5, cooldown_cycles_per_key=3, cooldown_cycles_per_group=2)
    groups = [group(0, [1, 2], 5.0), group(1, [3, 4], 4.0, colocated=True), group(2, [5, 6], 3.0), group(3, [7, 8], 2.0), group(4, [9, 10], 0.1)]
    state = scheduler.Cooldowns()
    first = scheduler.walk(groups, state, cfg, "LocalityGain", lambda g: 12)
    assert (first.relocated, first.skipped_low_gain, first.budget_cutoff, first.bytes_rewritten, first.logical_bytes_estimated) == ([0, 2], 1, True, 24, 20)
    second = scheduler.walk(groups, state, cfg, "LocalityGain", lambda g: 0)
    assert (second.relocated, second.skipped_cooldown, second.skipped_low_gain, second.bytes_rewritten) == ([3], 2, 2, 10)
    assert scheduler.walk(groups, state, cfg, None, lambda g: 1).ran is False
    none = scheduler.walk(groups, state, SchedulerConfig(cpu_budget_share=0.0), "LocalityGain", lambda g: 1)
    assert none.ran and none.groups_relocated == 0 and state.cycle == 4 and state.groups_relocated == 3


def test_a_group_that_exceeds_the_budget_stops_the_cycle():
    cfg = SchedulerConfig(max_bytes_rewritten_per_cycle=25, max_groups_relocated_per_cycle=9, cpu_budget_share=1.0)
    r = scheduler.walk([group(0, [1], 9.0, 20), group(1, [2], 8.0, 20), group(2, [3], 7.0, 1)], scheduler.Cooldowns(), cfg, "LocalityGain", lambda g: g["estimated_bytes"])
    assert r.relocated == [0] and r.budget_cutoff


def test_budget_fold_equals_a_first_cycle(spark):
    rows = [(k, float(40 - k), 10 + k) for k in range(30)]
    df = spark.createDataFrame(rows, "group_id int, expected_gain double, estimated_bytes bigint")
    taken = sorted(r["group_id"] for r in scheduler.select_within_budget(df, scheduler.Budget(100, 12)).collect())
    cfg = SchedulerConfig(max_bytes_rewritten_per_cycle=100, max_groups_relocated_per_cycle=12, cpu_budget_share=1.0)
    walked = scheduler.walk([group(k, [k], g, b) for k, g, b in rows], scheduler.Cooldowns(), cfg, "LocalityGain", lambda g: g["estimated_bytes"])
    assert taken == walked.relocated


def test_relocation_keeps_values_and_moves_tombstones(spark):
    rows = [(10, 1, 0, b"a", 1, 64), (11, 2, 0, b"bb", 1, 101), (12, 1, 1, b"", 2, 64), (13, 1, 0, b"d", 2, 100), (10, 3, 0, b"new", 2, 137)]
    log = spark.createDataFrame([(k, v, f, bytearray(p), s, o, 36 + len(p)) for k, v, f, p, s, o in rows], RECORDS)
    keys = spark.createDataFrame([(12,), (10,), (11,), (99,)], "key bigint")
    moved = relocation.relocate_group(log, keys, 7)
    assert [(r["key"], r["version"], r["flags"], r["segment_id"], r["offset"]) for r in moved.orderBy("offset").collect()] == [(10, 3, 0, 7, 64), (11, 2, 0, 7, 103), (12, 1, 1, 7, 141)]
    after = relocation.apply_moves(log, moved)
    live = lambda d: {r["key"]: (r["version"], bytes(r["payload"])) for r in versions.live(d).collect()}
    assert live(after) == live(log)
    assert {r["key"]: r["segment_id"] for r in versions.index(after).collect()} == {10: 7, 11: 7, 12: 7, 13: 2}
    with pytest.raises(InternalError):
        relocation.relocate_group(log, keys.where("false"), 8)


def test_plan_relocation_places_groups_side_by_side(spark):
    log = spark.createDataFrame([(k, 1, 0, bytearray(b"x" * k), 1, 0, 36 + k) for k in range(6)], RECORDS)
    groups = spark.createDataFrame([(0, [4, 1]), (1, [2, 3])], "group_id int, keys array<bigint>")
    moved = {r["key"]: (r["segment_id"], r["offset"]) for r in relocation.relocate_plan(log, groups, 5).collect()}
    assert moved == {1: (5, 64), 4: (5, 101), 2: (6, 64), 3: (6, 102)}
    facts = {r["group_id"]: (r["segment_id"], r["source_segments"], r["bytes_written"]) for r in relocation.relocation_facts(groups, versions.index(log), 5).collect()}
    assert facts == {0: (5, [1], 77), 1: (6, [1], 77)}
