import dataclasses
import os

import pytest

from keelson import faults
from keelson.config import PlannerConfig, SchedulerConfig, StoreConfig
from keelson.errors import InjectedFault, InternalError, InvalidDataDir
from keelson.operators.scheduler import Cooldowns
from keelson.plans.store import Store
from keelson.sources.segments import segment_name


@pytest.fixture
def config(tmp_path):
    return StoreConfig(str(tmp_path / "data"), planner=PlannerConfig(affinity_threshold=0.1, min_expected_gain=0.0, hysteresis_per_key=0.0), scheduler=SchedulerConfig(fragmentation_segments=1, cpu_budget_share=1.0, cooldown_cycles_per_key=100))


def test_put_get_delete_reopen(spark, config):
    with Store.open(spark, config) as s:
        s.put(5, 1, b"live")
        s.put(6, 1, b"other")
        assert s.get(5)[2] == b"live" and s.get(404) is None
        s.delete(5, 2)
        assert s.get(5) is None
        s.rotate_segment()
        s.put(5, 3, b"again")
    s = Store.open(spark, config)
    assert s.get_many([6, 5, 404, 6]) == [(6, 1, b"other"), (5, 3, b"again"), None, (6, 1, b"other")]
    assert (s.recovery.segments_replayed, s.recovery.checksum_records_verified, s.recovery.orphan_files) == (2, 4, [])
    assert s.counters["reads"] == 4 and s.counters["file_opens"] == 2 and s.snapshot()["keys"] == 2


def test_adaptation_keeps_every_value(spark, config):
    rows = spark.createDataFrame([(k, 1, 0, bytearray(f"v{k}".encode())) for k in range(40)], "key bigint, version bigint, flags int, payload binary")
    s = Store.open(spark, config)
    assert s.append(rows, ["key"], 10) == 4
    golden = [s.get_many(list(range(40)))]
    for _ in range(3):
        s.get_many_tracked([1, 15, 30])
    session = s.session()
    for k in (1, 15):
        session.touch(k)
    s.finish_session(session)
    s.record_event([7, 8])
    assert {(r["a"], r["b"]): r["weight"] for r in s.graph().collect()} == {(1, 15): 4.0, (1, 30): 3.0, (15, 30): 3.0, (7, 8): 1.0}
    state = Cooldowns()
    first = s.run_cycle(state)
    assert (first.ran, first.primary_trigger, first.groups_relocated, first.skipped_low_gain) == (True, "Fragmentation", 1, 1)
    assert s.already_colocated([1, 15, 30]) and not s.already_colocated([1, 2]) and not s.already_colocated([])
    second = s.run_cycle(state)
    assert (second.groups_relocated, second.skipped_cooldown) == (0, 1)
    assert [s.get_many(list(range(40)))] == golden
    s.decay(0.5)
    assert s.graph().where("a = 7").first()["weight"] == 0.5
    before = s.fingerprint()
    s.close()
    t = Store.open(spark, config)
    assert t.fingerprint() == before and [t.get_many(list(range(40)))] == golden


def test_relocation_retires_emptied_segments(spark, config):
    s = Store.open(spark, config)
    s.put(1, 10, b"a")
    s.rotate_segment()
    s.put(2, 1, b"b")
    s.rotate_segment()
    for _ in range(2):
        moved = s.relocate([1])
    assert moved.source_segments == (3,) and moved.bytes_written == 37 and s.get(1) == (1, 10, b"a")
    assert s.segment_count() == 2
    with pytest.raises(InternalError):
        s.relocate([])


def test_faults_and_recovery(spark, config):
    s = Store.open(spark, config)
    s.put(1, 1, b"a")
    s.rotate_segment()
    faults.arm("before_record_append")
    with pytest.raises(InjectedFault):
        s.put(2, 1, b"b")
    s.put(2, 1, b"b")
    s.rotate_segment()
    faults.arm("after_relocation_write")
    with pytest.raises(InjectedFault):
        s.relocate([1, 2])
    t = Store.open(spark, config)  # the unlisted segment is replayed, and reported
    assert t.recovery.orphan_files == [segment_name(3)] and t.get_many([1, 2]) == [(1, 1, b"a"), (2, 1, b"b")]
    assert {r["segment_id"] for r in t.index().collect()} == {3}


def test_manifest_loss_and_empty_orphans(spark, config):
    with Store.open(spark, config) as s:
        s.put(1, 1, b"a")
    before = Store.open(spark, config).fingerprint()
    os.remove(os.path.join(config.data_dir, "MANIFEST.json"))
    os.remove(os.path.join(config.data_dir, "MANIFEST.json.bak"))
    os.makedirs(os.path.join(config.data_dir, segment_name(9)))
    s = Store.open(spark, config)
    assert s.fingerprint() == before and s.recovery.empty_orphan_segments_removed == 1
    assert not os.path.exists(os.path.join(config.data_dir, segment_name(9)))
    (open(config.data_dir + ".x", "w")).close()
    with pytest.raises(InvalidDataDir):
        Store.open(spark, dataclasses.replace(config, data_dir=config.data_dir + ".x"))


def test_binary_segments_in_and_out(spark, config, tmp_path):
    s = Store.open(spark, config)
    rows = spark.createDataFrame([(k, 1, 0, bytearray(b"x" * k)) for k in range(9)], "key bigint, version bigint, flags int, payload binary")
    s.append(rows, ["key"], 4)
    os.makedirs(tmp_path / "out")
    s.export_segments(str(tmp_path / "out")).collect()
    t = Store.open(spark, dataclasses.replace(config, data_dir=str(tmp_path / "other")))
    assert t.import_segments(str(tmp_path / "out")) == 3
    assert t.fingerprint() == s.fingerprint() and t.get_many([8, 0]) == s.get_many([8, 0])
    assert t.verify().where("status <> 'ok'").count() == 0


def test_users_orders_payments_through_adaptation_and_reopening(spark, config):
    golden, puts = {}, []
    for u in range(6):
        for base, version, tag in ((1_000_000, 3, "user"), (4_000_000, 1, "pref"), (5_000_000, 1, "sess")):
            puts.append((base + u, version, f"{tag}:{u}".encode(), 0))
        for o in range(2):
            puts.append((2_000_000 + 2 * u + o, 2, f"order:{2 * u + o}".encode(), 0))
    puts.append((1_000_005, 4, b"", 1))
    s = Store.open(spark, config)
    for k, (key, version, payload, flags) in enumerate(puts):
        s.put(key, version, payload, flags)
        golden[key] = None if flags else (key, version, payload)
        if k % 7 == 6:
            s.rotate_segment()
    keys = sorted(golden)
    for u in range(6):
        s.record_query([1_000_000 + u, 2_000_000 + 2 * u, 2_000_001 + 2 * u, 4_000_000 + u, 5_000_000 + u])
    state = Cooldowns()
    assert s.run_cycle(state).groups_relocated > 0
    assert s.get_many(keys) == [golden[k] for k in keys]
    s.close()
    assert Store.open(spark, config).get_many(keys) == [golden[k] for k in keys]
