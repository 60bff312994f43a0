import dataclasses

import pytest

from keelson.config import PATTERNS, WorkloadSpec
from keelson.plans import harness, workload
from keelson.plans.cli import arguments, unsigned


def test_workloads_hold_their_shape():
    spec = WorkloadSpec(key_space=500, cluster_count=10, num_query_batches=40, mixed_steps=80)
    for pattern in PATTERNS:
        made = list(workload.steps(5, dataclasses.replace(spec, pattern=pattern)))
        assert made == list(workload.steps(5, dataclasses.replace(spec, pattern=pattern))) != list(workload.steps(6, dataclasses.replace(spec, pattern=pattern)))
        for k, (kind, keys, key, version, payload) in enumerate(made):
            if kind == "query":
                assert len(keys) == 8 == len(set(keys)) and keys == sorted(keys) and 0 <= keys[0] and keys[-1] < 500
                if pattern == "Clustered":
                    assert keys[0] // 50 == keys[-1] // 50
                if pattern == "AdversarialAlternating":
                    assert all((x >= 250) == bool(k % 2) for x in keys)
            else:
                assert 0 <= key < 500 and version == 1 and len(payload) == 32
        assert len(made) == (80 if pattern == "MixedReadWrite" else 40)


@pytest.mark.parametrize("bad", [dict(query_batch_size=11, key_space=10), dict(pattern="AdversarialAlternating", key_space=12), dict(pattern="Clustered", key_space=64, cluster_count=16), dict(pattern="None")])
def test_specs_that_never_end_are_refused(bad):
    with pytest.raises(ValueError):
        list(workload.steps(1, WorkloadSpec(**bad)))


def test_digest(spark):
    spec = WorkloadSpec(key_space=100, num_query_batches=5)
    runs = [("Random", 0, 1), ("Random", 1, 2)]
    made = lambda: {r["run_id"]: r["digest"] for r in workload.digest(workload.generate(spark, runs, spec)).collect()}
    first = made()
    assert first == made() and first[0] != first[1]


#: Published medians of the 11-run artifact: range reads, range bytes, file opens and records a range, before and after;
#: rewrite amplification and planner actions.
PUBLISHED = {
    "Random": ((7.234, 5.656), (1900.3, 1635.0), (6.438, 5.141), (1.119, 2.841), 0.0800, 16),
    "Clustered": ((1.0, 1.0), (5939.1, 5939.1), (1.0, 1.0), (8.0, 8.0), 0.0, 0),
    "SkewedZipfian": ((3.25, 3.375), (4092.2, 3706.9), (2.672, 2.844), (3.103, 2.960), 0.0050, 1),
    "MixedReadWrite": ((4.111, 2.964), (4042.7, 3770.3), (3.699, 2.747), (4.581, 5.508), 0.0791, 16),
    "AdversarialAlternating": ((6.422, 5.094), (3283.1, 2544.4), (5.219, 4.156), (1.284, 2.951), 0.0800, 16),
}


def test_counters_equal_the_published_ones(spark):
    results, summary = harness.benchmark(spark, *harness.PRESETS["sub-run"])
    for r in summary.collect():
        ops, size, opens, records, amplification, actions = PUBLISHED[r["scenario"]]
        for name, (before, after), digits in (("range_ops", ops, 3), ("range_bytes", size, 1), ("file_opens", opens, 3), ("rec_per_range", records, 3)):
            for value, x in ((before, "baseline"), (after, "adapted")):
                assert abs(r[f"median_{name}_{x}"] - value) <= 0.51 * 10**-digits, (r["scenario"], name, x)
        assert abs(r["median_rewrite_amplification"] - amplification) < 6e-5 and r["median_planner_actions"] == actions
        assert r["runs"] == 11 and r["positive_gain_runs"] + r["negative_gain_runs"] + r["zeroish_gain_runs"] == 11
    assert results.count() == 55


def test_traces_cycles_and_budget(spark):
    made = harness.run(spark, [("Random", 0, 9)], harness.template(1024, 32, 6))
    cycles = made["cycles"].where("group_id IS NULL").orderBy("cycle").collect()
    assert [r["cycle"] for r in cycles] == list(range(1, 7)) and all(r["groups_relocated"] <= 1 for r in cycles)
    traces = made["traces"].collect()
    assert 0 < len(traces) <= 16
    for t in traces:
        assert t["observed_same_segment_ratio_before"] < t["observed_same_segment_ratio_after"] == 1.0
        assert t["range_reads_after"] == 1 <= t["range_reads_before"] and t["file_opens_after"] == 1
    still = harness.run(spark, [("Random", 0, 9)], harness.template(1024, 32, 0))
    r = still["results"].first()
    assert (r["planner_actions"], r["rewrite_bytes_total"], r["rewrite_amplification"]) == (0, 0, 0.0)
    assert r["range_ops_baseline"] == r["range_ops_adapted"]


def test_command_line():
    a = arguments(["--runs", "3", "--base-seed", "0xff", "--unknown", "--csv"])
    assert (a.runs, a.base_seed, a.csv) == (3, 255, True)
    assert arguments(["--preset", "small"]).key_space == 2000 and unsigned("12") == 12


def test_wins(spark):
    good = {"scenario": "good", "median_p95_gain": 0.2, "positive_gain_runs": 8, "median_range_ops_adapted": 3.0, "median_range_ops_baseline": 4.0, "median_rec_per_range_adapted": 2.0, "median_rec_per_range_baseline": 1.0, "p95_adapted_iqr": 10.0, "median_p95_baseline_ns": 100.0}
    rows = [good]
    for k, v in (("median_p95_gain", 0.05), ("positive_gain_runs", 7), ("median_range_ops_adapted", 4.0), ("median_rec_per_range_adapted", 1.0), ("p95_adapted_iqr", 20.0)):
        rows.append(good | {"scenario": k, k: v})
    assert [r["scenario"] for r in harness.wins(spark.createDataFrame(rows)).collect()] == ["good"]
