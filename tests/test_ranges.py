import random

import pytest

from keelson.config import ReadMergePolicy
from keelson.operators import layout, ranges

DEFAULT = ReadMergePolicy()


def packed(spark, payloads, per_segment):
    rows = [(k, 36 + n, 1 + k // per_segment) for k, n in enumerate(payloads)]
    return layout.offsets(spark.createDataFrame(rows, "key bigint, size bigint, segment_id bigint"), ["key"])


def ask(spark, keys, idx, policy):
    batch = spark.createDataFrame([(0, i, k) for i, k in enumerate(keys)], "batch_id bigint, pos int, key bigint")
    return ranges.io_counters(batch, idx, policy).first()


@pytest.mark.parametrize(
    "payloads, per_segment, keys, policy, expected",
    [
        ([13] * 16, 16, list(range(16)), DEFAULT, (1, 15, 0, 784, 1)),
        ([1] * 16, 16, list(range(0, 16, 2)), ReadMergePolicy(256, 1 << 20), (1, 7, 259, 555, 1)),
        ([35] * 8, 8, [0, 4, 7], ReadMergePolicy(8, 1 << 20), (3, 0, 0, 213, 1)),
        ([1] * 48, 16, [0, 5, 16, 20, 32, 40, 7], DEFAULT, (3, 4, 555, 814, 3)),
    ],
)
def test_exact_counters(spark, payloads, per_segment, keys, policy, expected):
    r = ask(spark, keys, packed(spark, payloads, per_segment), policy)
    assert (r["range_read_ops"], r["range_merges"], r["gap_bytes_merged"], r["range_bytes_read"], r["file_opens"]) == expected


def test_misses_cost_nothing_and_duplicates_one_open(spark):
    idx = packed(spark, [1] * 20, 10)
    r = ask(spark, [0, 999, 1, 123456], idx, DEFAULT)
    assert (r["reads"], r["range_read_ops"], r["file_opens"], r["records_found"]) == (4, 1, 1, 2)
    assert ask(spark, [0, 0, 1, 11, 11, 19], idx, DEFAULT)["segments_touched"] == 2
    none = ask(spark, [777], idx, DEFAULT)
    assert (none["reads"], none["file_opens"], none["bytes_read"], none["colocated_pair_ratio"]) == (1, 0, 0, 0.0)


def plain(rows, policy):
    """Ranges of (segment, offset, size) rows by a loop."""
    out = []
    for segment, offset, size in sorted(rows):
        last = out[-1] if out else None
        if last and last[0] == segment and max(0, offset - last[2]) <= policy.max_read_gap_bytes and max(last[2], offset + size) - last[1] <= policy.max_range_bytes:
            last[2], last[3] = max(last[2], offset + size), last[3] + 1
        else:
            out.append([segment, offset, offset + size, 1])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("policy", [ReadMergePolicy(50, 200), ReadMergePolicy(0, 1 << 20), ReadMergePolicy(1000, 90)])
def test_fold_matches_a_loop_on_random_batches(spark, policy):
    rng = random.Random(5)
    rows = [(b, rng.randrange(3), rng.randrange(600), rng.randrange(1, 80)) for b in range(20) for _ in range(rng.randrange(1, 12))]
    located = spark.createDataFrame(rows, "batch_id bigint, segment_id bigint, offset bigint, size bigint")
    made, counted = {}, {r["batch_id"]: r for r in ranges.batch_counters(located, ["batch_id"], policy).collect()}
    for r in ranges.merged_ranges(located, ["batch_id"], policy).collect():
        made.setdefault(r["batch_id"], []).append((r["segment_id"], r["start"], r["end"], r["records"]))
    for b in range(20):
        own = [x[1:] for x in rows if x[0] == b]
        expected = plain(own, policy)
        assert sorted(made[b]) == expected
        c = counted[b]
        assert (c["range_read_ops"], c["range_bytes_read"], c["records_in_ranges"]) == (len(expected), sum(e - s for _, s, e, _ in expected), len(own))
        spans = {}
        for s, o, _ in own:
            spans.setdefault(s, []).append(o)
        assert c["offsets_span_total"] == sum(max(v) - min(v) for v in spans.values())


def test_colocated_pairs(spark):
    rows = [(0, s, 0, 1) for s in (1, 1, 2, 2, 2)] + [(1, 1, 0, 1)]
    located = spark.createDataFrame(rows, "batch_id bigint, segment_id bigint, offset bigint, size bigint")
    ratio = {r[0]: r[1] for r in ranges.colocated_pair_ratio(located, ["batch_id"]).collect()}
    assert ratio == {0: 0.4, 1: 0.0}
    assert {r["batch_id"]: r["colocated_pair_ratio"] for r in ranges.batch_counters(located, ["batch_id"]).collect()} == ratio


def test_already_colocated(spark):
    idx = packed(spark, [1] * 20, 10)
    groups = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 15), (2, 999)], "group_id int, key bigint")
    found = {r["group_id"]: (r["share"], r["colocated"]) for r in ranges.already_colocated(groups, idx).collect()}
    assert found == {0: (1.0, True), 1: (0.5, False), 2: (0.0, False)}
    assert {r["group_id"]: (r["ranges"], r["opens"]) for r in ranges.predict_reads(groups, idx).collect()} == {0: (1, 1), 1: (2, 2), 2: (0, 0)}


def test_contiguity(spark):
    good = packed(spark, [5] * 4, 4)
    assert layout.contiguity(good).first()[1:] == (True, 4, 64 + 4 * 41)
    holed = layout.contiguity(good.where("key <> 2")).first()
    assert (holed["contiguous"], holed["valid_prefix"], holed["end"]) == (False, 2, 64 + 82)


def test_means_of_ratios(spark):
    rows = [(4, 2, 2, 10), (1, 1, 0, 0), (0, 0, 0, 0)]
    names = "records_in_ranges bigint, range_read_ops bigint, range_merges bigint, gap_bytes_merged bigint"
    df = spark.createDataFrame(rows, names)
    for c in ranges.MEANS:
        if c not in df.columns:
            df = df.selectExpr("*", f"0 AS {c}")
    r = ranges.phase_metrics(df, []).first()
    assert (r["mean_records_per_range_read"], r["mean_range_merge_ratio"], r["mean_gap_bytes_merged"]) == (1.0, 0.5 / 3, 5 / 3)
