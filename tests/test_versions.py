import random

from keelson.operators import versions
from keelson.schemas import BATCHES, RECORDS


def log(spark, rows):
    return spark.createDataFrame([(k, v, f, bytearray(p), s, o, 36 + len(p)) for k, v, f, p, s, o in rows], RECORDS)


def shown(df):
    return {r["key"]: bytes(r["payload"]) for r in df.collect()}


def test_latest_version_wins(spark):
    rows = [(99, 1, 0, b"a", 1, 64), (99, 2, 0, b"b", 1, 101), (99, 3, 0, b"c", 1, 138)]
    assert shown(versions.live(log(spark, rows))) == {99: b"c"}


def test_lower_version_in_a_later_segment_loses_and_ties_go_to_later_places(spark):
    rows = [(1, 5, 0, b"x", 1, 200), (1, 3, 0, b"y", 2, 64), (2, 5, 0, b"a", 1, 64), (2, 5, 0, b"b", 1, 200), (77, 5, 0, b"one", 1, 64), (77, 5, 0, b"two", 2, 64)]
    assert shown(versions.live(log(spark, rows))) == {1: b"x", 2: b"b", 77: b"two"}


def test_tombstone_hides_until_a_later_version(spark):
    rows = [(5, 1, 0, b"live", 1, 64), (5, 2, 1, b"", 1, 104)]
    assert shown(versions.live(log(spark, rows))) == {}
    assert versions.tombstones(log(spark, rows)).count() == 1
    assert versions.index(log(spark, rows)).first()["version"] == 2
    assert shown(versions.live(log(spark, [*rows, (5, 3, 0, b"again", 1, 140)]))) == {5: b"again"}


def test_many_passes_against_a_golden_map(spark):
    rng, rows, golden, end = random.Random(3), [], {}, 64
    for version in range(400):
        key, dead = rng.randrange(25), rng.random() < 0.2
        payload = b"" if dead else f"v{version}".encode()
        rows.append((key, version, int(dead), payload, 1 + version // 90, end))
        end += 36 + len(payload)
        golden[key] = None if dead else payload
    assert shown(versions.live(log(spark, rows))) == {k: v for k, v in golden.items() if v is not None}


def test_get_many_keeps_order_misses_and_duplicates(spark):
    rows = [(k, 1, 0, f"v{k}".encode(), 1 + k // 8, 64 + 40 * (k % 8)) for k in range(16)] + [(3, 2, 1, b"", 3, 64)]
    request = [15, 0, 8, 3, 999, 7, 15, 9]
    batch = spark.createDataFrame([(0, i, k) for i, k in enumerate(request)], BATCHES)
    found = versions.get_many(batch, log(spark, rows)).orderBy("pos").collect()
    assert [r["key"] for r in found] == request
    assert [r["payload"] and bytes(r["payload"]) for r in found] == [b"v15", b"v0", b"v8", None, None, b"v7", b"v15", b"v9"]
    assert [r["found"] for r in found] == [True, True, True, True, False, True, True, True]


def test_a_permuted_request_of_a_thousand(spark):
    rows = [(k, 1, 0, f"v{k}".encode(), 1, 64 + 40 * k) for k in range(1000)]
    request = [(i * 7919 + 13) % 1000 for i in range(1000)]
    batch = spark.createDataFrame([(0, i, k) for i, k in enumerate(request)], BATCHES)
    found = versions.get_many(batch, log(spark, rows)).orderBy("pos").collect()
    assert [bytes(r["payload"]) for r in found] == [f"v{k}".encode() for k in request]


def test_key_filter_reaches_the_scan(spark, tmp_path):
    log(spark, [(1, 1, 0, b"a", 1, 64)]).write.parquet(str(tmp_path / "log"))
    plan = versions.get(spark.read.parquet(str(tmp_path / "log")), 1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,1)" in plan


def test_stale_and_source_segments(spark):
    rows = log(spark, [(1, 1, 0, b"a", 1, 64), (2, 1, 0, b"b", 2, 64), (1, 2, 0, b"c", 3, 64)])
    idx = versions.index(rows)
    all_segments = rows.select("segment_id").distinct()
    assert [r[0] for r in versions.stale_segments(all_segments, idx).collect()] == [1]
    assert versions.stale_segments(all_segments, idx, active=1).count() == 0
    keys = spark.createDataFrame([(1,), (2,), (9,)], "key bigint")
    assert [r[0] for r in versions.source_segments(idx, keys).collect()] == [2, 3]
    assert versions.references_segment(idx, 2) and not versions.references_segment(idx, 1)
    assert [r["key"] for r in versions.select_for_rewrite(rows, keys.union(keys)).orderBy("key").collect()] == [1, 2]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(k, 1, 0, b"x", 1, 64 + 37 * k) for k in range(50)]
    first = versions.fingerprint(versions.index(log(spark, rows))).first()[0]
    assert first == versions.fingerprint(versions.index(log(spark, rows[::-1]).repartition(3))).first()[0]
    assert first != versions.fingerprint(versions.index(log(spark, rows[1:]))).first()[0]
    assert versions.fingerprint(versions.index(log(spark, []))).first()[0]


def test_replay_report(spark):
    r = versions.replay_report(log(spark, [(1, 1, 0, b"", 1, 64), (1, 2, 1, b"", 1, 100), (2, 1, 0, b"", 1, 136)])).first()
    assert (r["records_verified"], r["keys"], r["live_keys"], r["tombstones"]) == (3, 2, 1, 1)
