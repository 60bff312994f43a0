"""The benchmark: what does adapting the layout to the reads save?

Every run loads the same keys, replays a seeded workload against the initial layout, plans from what was
read together, relocates under a budget for some cycles, and replays the workload again. All runs of all
scenarios go through Spark at once; only planning and the cycle walk of one run, which are sequential and
small, are Python functions over that run's rows.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.config import PATTERNS, HarnessConfig, PlannerConfig
from keelson.functions import statistics as stats
from keelson.functions.scalars import record_size, signed_gain
from keelson.operators import coaccess, layout
from keelson.operators.planner import NO_WEIGHT, chunk, visit
from keelson.operators.ranges import COUNTERS, batch_counters, phase_metrics
from keelson.operators.scheduler import Cooldowns, primary_trigger, walk
from keelson.plans.workload import digest, generate, schedule
from keelson.schemas import RECORD_OVERHEAD, SEGMENT_HEADER
from keelson.session import saved

RUN = ["scenario", "run_id"]
LOADED_PAYLOAD = 24


@dataclass(frozen=True)
class LatencyModel:
    """Nanoseconds of a batch from its counters. Modelled: layouts are tables here, and nothing is timed."""

    per_open: int = 15_000
    per_range: int = 5_000
    per_byte: float = 1.0


def loaded_layout(spark: SparkSession, keys: int, rotation: int) -> DataFrame:
    """key, segment_id, offset, size of the keys as loaded, one segment after each `rotation` keys."""
    rows = spark.range(keys).withColumnRenamed("id", "key").withColumn("size", F.lit(LOADED_PAYLOAD + RECORD_OVERHEAD).cast("bigint"))
    return layout.append(rows, "key", rotation)


def last_segment(cfg: HarnessConfig) -> tuple[int, int]:
    """The segment that stays open after loading, and where it ends."""
    rotation, size = cfg.initial_segment_rotation, LOADED_PAYLOAD + RECORD_OVERHEAD
    if rotation <= 0:
        return 1, SEGMENT_HEADER + cfg.load_key_count * size
    segments = max(-(-cfg.load_key_count // rotation), 1)
    return segments, SEGMENT_HEADER + (cfg.load_key_count - (segments - 1) * rotation) * size


def written(steps: DataFrame, tails: DataFrame) -> DataFrame:
    """RUN, step, key, segment_id, offset, size of the writes of a replay, appended at each run's tail (segment, end)."""
    rows = steps.where("kind = 'write'").select(*RUN, "step", "key", record_size(F.length("payload")).alias("size"))
    before = Window.partitionBy(*RUN).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(tails, RUN).withColumn("offset", F.col("end") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    return placed.select(*RUN, "step", "key", F.col("segment").alias("segment_id"), "offset", "size")


def replay(steps: DataFrame, base: DataFrame, overlay: DataFrame | None, writes: DataFrame) -> DataFrame:
    """Where each requested key lies when it is read: RUN, step, pos, key, segment_id, offset, size.

    The latest write before the step wins, then the run's overlay (earlier writes and relocations), then
    the loaded layout.
    """
    asked = steps.where("kind = 'query'").select(*RUN, "step", F.posexplode("keys").alias("pos", "key"))
    found = F.struct("segment_id", "offset", "size")
    mine = writes.select(*RUN, "key", F.col("step").alias("at"), found.alias("w"))
    asked = asked.join(mine.groupBy(*RUN, "key").agg(F.collect_list(F.struct("at", "w")).alias("ws")), [*RUN, "key"], "left")
    asked = asked.withColumn("w", F.array_max(F.filter("ws", lambda x: x["at"] < F.col("step")))["w"]).drop("ws")
    places = [F.col("w")]
    if overlay is not None:
        asked = asked.join(overlay.select(*RUN, "key", found.alias("o")), [*RUN, "key"], "left")
        places.append(F.col("o"))
    asked = asked.join(base.select("key", found.alias("b")), "key", "left")
    place = F.coalesce(*places, F.col("b"))
    return asked.select(*RUN, "step", "pos", "key", place.alias("p")).where("p IS NOT NULL").select(*RUN, "step", "pos", "key", "p.*")


def samples(steps: DataFrame, located: DataFrame, cfg: HarnessConfig, model: LatencyModel) -> DataFrame:
    """A row of counters per batch, with modelled latency; batches without a hit have zeros."""
    asked = steps.where("kind = 'query'").select(*RUN, "step")
    found = batch_counters(located, [*RUN, "step"], cfg.merge)
    filled = asked.join(found, [*RUN, "step"], "left").select(*RUN, "step", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS], F.coalesce("colocated_pair_ratio", F.lit(0.0)).alias("colocated_pair_ratio"))
    return filled.withColumn("latency_ns", (F.col("file_opens") * model.per_open + F.col("range_read_ops") * model.per_range + F.col("range_bytes_read") * model.per_byte).cast("bigint"))


def phase(of: DataFrame) -> DataFrame:
    """Means, ratios and latency percentiles of each run."""
    latency = of.groupBy(*RUN).agg(stats.nearest_rank("latency_ns", 0.50).alias("p50_read_latency_ns"), stats.nearest_rank("latency_ns", 0.95).alias("p95_read_latency_ns"))
    return phase_metrics(of, RUN).join(latency, RUN)


def plan_in_memory(edges: list[tuple[int, int, float]], sizes: dict[int, int] | int, cfg: PlannerConfig) -> list[tuple[int, list[int], int, float]]:
    """(group_id, keys, class, gain) of one small graph; the same groups as operators.planner.plan()."""
    if not edges:
        return []
    heaviest = max(w for *_, w in edges)
    norm = heaviest if heaviest > NO_WEIGHT else 1.0
    known = {(a, b): w for a, b, w in edges}
    keys = {k for a, b, _ in edges for k in (a, b)}
    sized = dict.fromkeys(keys, sizes) if isinstance(sizes, int) else sizes
    made = []
    for order in visit([(a, b) for a, b, w in edges if w / norm >= cfg.affinity_threshold]):
        for own in chunk(order, sized, cfg.max_keys_per_group, cfg.max_bytes_per_group):
            if len(own) < 2:
                continue
            inside = sum(known.get((min(a, b), max(a, b)), 0.0) / norm for k, a in enumerate(own) for b in own[k + 1 :])
            gain = inside - cfg.hysteresis_per_key * len(own)
            if gain >= cfg.min_expected_gain:
                made.append((len(made), own, len(made) % max(cfg.segment_classes, 1), gain))
    return made


def plans(edges: DataFrame, cfg: HarnessConfig) -> DataFrame:
    """RUN, group_id, keys, target_segment_class, expected_gain, edge_count of every run's graph."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        scenario, run_id = frame["scenario"].iloc[0], frame["run_id"].iloc[0]
        made = plan_in_memory(sorted(zip(frame["a"].tolist(), frame["b"].tolist(), frame["weight"].tolist())), cfg.planning_key_bytes, cfg.planner)
        return pd.DataFrame([(scenario, run_id, *g, len(frame)) for g in made], columns=[*RUN, "group_id", "keys", "target_segment_class", "expected_gain", "edge_count"])

    return edges.groupBy(*RUN).applyInPandas(make, "scenario string, run_id int, group_id int, keys array<bigint>, target_segment_class int, expected_gain double, edge_count int")


def cycles(planned: DataFrame, placed: DataFrame, segments: DataFrame, cfg: HarnessConfig) -> DataFrame:
    """Walk every run's cycles: a row per relocated group and one (group_id null) per cycle.

    planned: plans(); placed: RUN, group_id, key, segment_id, size; segments: RUN, segment_id, keys.
    """
    first_new = last_segment(cfg)[0] + 1

    def make(key, groups: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        columns = [*RUN, "cycle", "ran", "primary_trigger", "bytes_rewritten", "groups_relocated", "skipped_cooldown", "skipped_low_gain", "budget_cutoff", "logical_bytes_estimated", "group_id", "segment_id", "group_bytes", "keys"]
        counts = dict(zip(held["segment_id"].tolist(), held["n"].tolist()))
        state, rows, next_id, gone = Cooldowns(), [], first_new, set()
        facts = []
        for g in groups.sort_values(["expected_gain", "group_id"], ascending=[False, True]).itertuples():
            where = dict(zip([int(x) for x in g.placed_keys], zip([int(x) for x in g.placed_segments], [int(x) for x in g.placed_sizes])))
            facts.append({"group_id": int(g.group_id), "keys": [int(x) for x in g.keys], "expected_gain": g.expected_gain, "estimated_bytes": cfg.planning_key_bytes * len(g.keys), "where": where})
        for f in facts:
            f["colocated"] = lambda f=f: bool(f["where"]) and len({s for s, _ in f["where"].values()}) == 1
        total = sum(f["expected_gain"] for f in sorted(facts, key=lambda f: f["group_id"]))
        edge_count = int(groups["edge_count"].iloc[0]) if len(groups) else 0
        for _ in range(cfg.stabilization_cycles):
            moved = []

            def relocate(f: dict) -> int:
                nonlocal next_id
                for k, (segment, size) in f["where"].items():
                    counts[segment] -= 1
                    f["where"][k] = (next_id, size)
                counts[next_id] = len(f["where"])
                gone.update(s for s, n in counts.items() if n == 0)
                moved.append((f["group_id"], next_id, sum(s for _, s in f["where"].values()), sorted(f["where"])))
                next_id += 1
                return moved[-1][2]

            trigger = primary_trigger(edge_count, cfg.tracking.max_graph_edges, len(counts) - len(gone), total, cfg.scheduler)
            r = walk(facts, state, cfg.scheduler, trigger, relocate)
            head = (*key, r.cycle, r.ran, r.primary_trigger, r.bytes_rewritten, r.groups_relocated, r.skipped_cooldown, r.skipped_low_gain, r.budget_cutoff, r.logical_bytes_estimated)
            rows.append((*head, None, None, None, None))
            rows += [(*head, *m) for m in moved]
        return pd.DataFrame(rows, columns=columns).astype({"group_id": "Int64", "segment_id": "Int64", "group_bytes": "Int64"})

    own = placed.groupBy(*RUN, "group_id").agg(F.collect_list("key").alias("placed_keys"), F.collect_list("segment_id").alias("placed_segments"), F.collect_list("size").alias("placed_sizes"))
    full = planned.join(own, [*RUN, "group_id"])
    schema = "scenario string, run_id int, cycle int, ran boolean, primary_trigger string, bytes_rewritten bigint, groups_relocated int, skipped_cooldown int, skipped_low_gain int, budget_cutoff boolean, logical_bytes_estimated bigint, group_id int, segment_id bigint, group_bytes bigint, keys array<bigint>"
    return full.groupBy(*RUN).cogroup(segments.groupBy(*RUN)).applyInPandas(make, schema)


def run(spark: SparkSession, runs: list[tuple[str, int, int]], cfg: HarnessConfig = HarnessConfig(), model: LatencyModel = LatencyModel()) -> dict[str, DataFrame]:
    """All runs. Returns results (a row per run), cycles, traces, samples_before, samples_after, steps and digests."""
    steps = saved(generate(spark, runs, cfg.spec), "steps")
    listed = spark.createDataFrame([(s, i) for s, i, _ in runs], "scenario string, run_id int")
    base = loaded_layout(spark, cfg.load_key_count, cfg.initial_segment_rotation)
    segment, end = last_segment(cfg)
    tail = listed.withColumns({"segment": F.lit(segment).cast("bigint"), "end": F.lit(end).cast("bigint")})
    first = saved(written(steps, tail), "writes")
    before = saved(samples(steps, replay(steps, base, None, first), cfg, model), "before")

    # the adapted store replays the workload once to learn from it: its writes stay
    primed = first.groupBy(*RUN, "key").agg(F.max_by(F.struct("segment_id", "offset", "size"), "step").alias("p")).select(*RUN, "key", "p.*")
    asked = steps.where("kind = 'query'").select(*RUN, "step", F.explode("keys").alias("key"))
    edges = coaccess.track(asked, cfg.tracking, [*RUN, "step"], RUN)
    planned = saved(plans(edges, cfg), "plans")
    members = planned.select(*RUN, "group_id", F.explode("keys").alias("key"))
    place = F.coalesce(F.struct("p.segment_id", "p.offset", "p.size"), F.struct("b.segment_id", "b.offset", "b.size"))
    placed = members.join(primed.select(*RUN, "key", F.struct("segment_id", "offset", "size").alias("p")), [*RUN, "key"], "left").join(base.select("key", F.struct("segment_id", "offset", "size").alias("b")), "key", "left")
    placed = saved(placed.select(*RUN, "group_id", "key", F.when(F.col("p").isNotNull(), F.col("p")).otherwise(F.col("b")).alias("x")).where("x IS NOT NULL").select(*RUN, "group_id", "key", "x.*"), "placed")
    away = primed.join(base.select("key", F.col("segment_id").alias("_from")), "key")
    counts = listed.join(base.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")))
    change = away.select(*RUN, F.col("_from").alias("segment_id"), F.lit(-1).alias("n")).unionByName(primed.select(*RUN, "segment_id", F.lit(1).alias("n")))
    segments = counts.select(*RUN, "segment_id", "n").unionByName(change.select(*RUN, "segment_id", F.col("n").cast("bigint"))).groupBy(*RUN, "segment_id").agg(F.sum("n").alias("n"))
    walked = saved(cycles(planned, placed, segments, cfg), "cycles")

    moves = walked.where("group_id IS NOT NULL").select(*RUN, "cycle", "group_id", F.col("segment_id").alias("_to"), F.explode("keys").alias("key"))
    sized = moves.join(placed.select(*RUN, "group_id", "key", "size"), [*RUN, "group_id", "key"]).withColumn("segment_id", F.col("_to"))
    after_key = Window.partitionBy(*RUN, "segment_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("offset", (F.lit(SEGMENT_HEADER) + F.coalesce(F.sum("size").over(after_key), F.lit(0))).cast("bigint"))
    # a group moved again lies where it was moved last
    moved = sized.groupBy(*RUN, "key").agg(F.max_by(F.struct("segment_id", "offset", "size"), "segment_id").alias("m")).select(*RUN, "key", "m.*")
    overlay = saved(primed.join(moved.select(*RUN, "key"), [*RUN, "key"], "left_anti").unionByName(moved), "overlay")

    newest = listed.join(walked.groupBy(*RUN).agg(F.max("segment_id").alias("last")), RUN, "left")
    ends = first.groupBy(*RUN).agg(F.max(F.col("offset") + F.col("size")).alias("e"))
    tails = newest.join(ends, RUN, "left").select(
        *RUN, F.coalesce(F.col("last") + 1, F.lit(segment)).cast("bigint").alias("segment"),
        F.when(F.col("last").isNotNull(), F.lit(SEGMENT_HEADER)).otherwise(F.coalesce("e", F.lit(end))).cast("bigint").alias("end"),
    )
    again = written(steps, tails)
    after = saved(samples(steps, replay(steps, base, overlay, again), cfg, model), "after")
    return {
        "results": results(listed, steps, before, after, walked, cfg), "cycles": walked, "traces": traces(planned, walked, placed, sized, cfg),
        "samples_before": before, "samples_after": after, "steps": steps, "digests": digest(steps), "plans": planned,
    }


def results(listed: DataFrame, steps: DataFrame, before: DataFrame, after: DataFrame, walked: DataFrame, cfg: HarnessConfig) -> DataFrame:
    """A flat row per run: both phases, signed gains, amplification and actions."""
    b, a = (phase(x).select(*RUN, *[F.col(c).alias(f"{c}_{n}") for c in phase(x).columns if c not in RUN]) for x, n in ((before, "b"), (after, "a")))
    work = walked.where("group_id IS NOT NULL").groupBy(*RUN).agg(F.count(F.lit(1)).alias("planner_actions"), F.sum("group_bytes").alias("rewrite_bytes_total"))
    user = steps.where("kind = 'write'").groupBy(*RUN).agg(F.sum(F.length("payload")).alias("extra"))
    seeds = steps.groupBy(*RUN).agg(F.first("seed").alias("seed"))
    full = listed.join(b, RUN, "left").join(a, RUN, "left").join(work, RUN, "left").join(user, RUN, "left").join(seeds, RUN, "left")
    full = full.fillna(0, ["planner_actions", "rewrite_bytes_total", "extra"])
    loaded = cfg.load_key_count * LOADED_PAYLOAD
    pairs = {"range_ops": "mean_range_read_ops", "range_bytes": "mean_range_bytes_read", "file_opens": "mean_file_opens", "rec_per_range": "mean_records_per_range_read"}
    latency = [F.col(f"{p}_read_latency_ns_{x}").alias(f"{p}_{n}_ns") for p in ("p50", "p95") for x, n in (("b", "baseline"), ("a", "adapted"))]
    return full.select(
        "run_id", F.col("seed").cast("decimal(20,0)").alias("seed"), "scenario", *latency,
        *[F.col(f"{c}_{x}").alias(f"{n}_{y}") for n, c in pairs.items() for x, y in (("b", "baseline"), ("a", "adapted"))],
        signed_gain("p95_read_latency_ns_b", "p95_read_latency_ns_a").alias("p95_gain"),
        *[signed_gain(f"{pairs[n]}_b", f"{pairs[n]}_a").alias(f"{n}_gain") for n in ("range_ops", "range_bytes", "file_opens")],
        signed_gain("mean_physical_read_ops_b", "mean_physical_read_ops_a").alias("physical_ops_gain"),
        (F.col("rewrite_bytes_total") / (F.lit(loaded) + F.col("extra"))).alias("rewrite_amplification"),
        "planner_actions", "rewrite_bytes_total", (F.lit(loaded) + F.col("extra")).alias("user_write_bytes_total"),
        (F.col("planner_actions") / max(cfg.stabilization_cycles, 1)).alias("planner_action_rate"),
    )


def traces(planned: DataFrame, walked: DataFrame, placed: DataFrame, sized: DataFrame, cfg: HarnessConfig) -> DataFrame:
    """Before and after of the first groups whose colocation improved, by cycle and group."""
    by = [*RUN, "group_id"]

    def facts(rows: DataFrame, name: str) -> DataFrame:
        counted = batch_counters(rows, by, cfg.merge)
        spans = rows.groupBy(*by).agg((F.max("offset") - F.min("offset")).alias(f"observed_offsets_span_{name}"), F.sort_array(F.collect_list(F.struct("key", "segment_id"))).alias(f"_at_{name}"))
        chosen = {"colocated_pair_ratio": "observed_same_segment_ratio", "range_read_ops": "range_reads", "range_bytes_read": "range_bytes", "file_opens": "file_opens"}
        return counted.select(*by, *[F.col(c).alias(f"{n}_{name}") for c, n in chosen.items()]).join(spans, by)

    done = walked.where("group_id IS NOT NULL").groupBy(*by).agg(F.min("cycle").alias("cycle"))
    first = sized.join(done, [*by, "cycle"]).select(*by, "key", "segment_id", "offset", "size")
    both = planned.join(done, by).join(facts(placed, "before"), by).join(facts(first, "after"), by)
    better = both.where("observed_same_segment_ratio_before < observed_same_segment_ratio_after")
    rank = F.row_number().over(Window.partitionBy(*RUN).orderBy("cycle", "group_id"))
    named = better.select(
        *by, "cycle", "keys", F.size("keys").alias("keys_count"), "expected_gain", F.col("_at_before.segment_id").alias("segment_ids_before"), F.get("_at_after.segment_id", 0).alias("segment_id_after"),
        *[f"{n}_{x}" for n in ("observed_same_segment_ratio", "observed_offsets_span", "range_reads", "range_bytes", "file_opens") for x in ("before", "after")], F.lit(0).cast("bigint").alias("bytes_written"),
    )
    return named.withColumn("_rank", rank).where(F.col("_rank") <= cfg.max_relocation_traces).drop("_rank")


MEDIANS = (
    "p50_baseline_ns", "p50_adapted_ns", "p95_baseline_ns", "p95_adapted_ns", "range_ops_baseline", "range_ops_adapted", "range_bytes_baseline", "range_bytes_adapted",
    "file_opens_baseline", "file_opens_adapted", "rec_per_range_baseline", "rec_per_range_adapted", "p95_gain", "range_ops_gain", "range_bytes_gain", "file_opens_gain", "rewrite_amplification", "planner_actions",
)


def summarize(runs: DataFrame, base_seed: int | None = None, mode: str = "single-process") -> DataFrame:
    """A row per scenario: medians of each field by itself, spread of the adapted p95, signs of gains."""
    flagged = runs.withColumn("_flip", stats.flips("p95_gain", ["scenario"], "run_id"))
    summary = flagged.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("runs"), *[stats.median(c).alias(f"median_{c}") for c in MEDIANS],
        stats.iqr("p95_adapted_ns").alias("p95_adapted_iqr"), stats.least("p95_adapted_ns").alias("p95_adapted_min"), stats.greatest("p95_adapted_ns").alias("p95_adapted_max"),
        stats.least("p95_gain").alias("min_p95_gain"), stats.greatest("p95_gain").alias("max_p95_gain"), F.lit(stats.ZEROISH).alias("zeroish_gain_threshold"),
        stats.negative_runs("p95_gain").alias("negative_gain_runs"), stats.positive_runs("p95_gain").alias("positive_gain_runs"), stats.zeroish_runs("p95_gain").alias("zeroish_gain_runs"),
        F.sum("_flip").alias("sign_flip_count"),
    )
    return summary.withColumns({"base_seed": F.lit(str(base_seed)).cast("decimal(20,0)") if base_seed is not None else F.lit(None).cast("decimal(20,0)"), "mode": F.lit(mode)})


def wins(summary: DataFrame, least_gain: float = 0.05, least_positive: int = 8) -> DataFrame:
    """Scenarios that count as won: a median p95 gain over least_gain, in enough runs positive and greater than
    the spread of the adapted p95; fewer range reads, and more records in each."""
    return summary.where(
        (F.col("median_p95_gain") > least_gain)
        & (F.col("positive_gain_runs") >= least_positive)
        & (F.col("median_range_ops_adapted") < F.col("median_range_ops_baseline"))
        & (F.col("median_rec_per_range_adapted") > F.col("median_rec_per_range_baseline"))
        & (F.col("p95_adapted_iqr") / F.col("median_p95_baseline_ns") < F.col("median_p95_gain"))
    )


def template(key_space: int = 8000, batches: int = 96, cycles: int = 24) -> HarnessConfig:
    """The benchmark's settings at a size."""
    default = HarnessConfig()
    spec = dataclasses.replace(default.spec, key_space=key_space, num_query_batches=batches, query_batch_size=8, cluster_count=32, zipf_s=1.1, read_fraction=0.7, mixed_steps=2 * batches, write_payload_len=32)
    return dataclasses.replace(default, spec=spec, load_key_count=key_space, stabilization_cycles=cycles, initial_segment_rotation=max(key_space // 16, 64))


PRESETS = {"small": (7, 2000, 48, 12), "medium": (11, 8000, 96, 24), "sub-run": (11, 4000, 64, 16)}


def benchmark(spark: SparkSession, runs: int = 11, key_space: int = 8000, batches: int = 96, cycles: int = 24, base_seed: int = 0xBEEFC0DE, scenarios: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results of every run, summary by scenario)."""
    made = run(spark, schedule(scenarios or list(PATTERNS), runs, base_seed), template(key_space, batches, cycles))
    flat = saved(made["results"], "results")
    return flat, summarize(flat, base_seed)


def as_json(row: dict) -> str:
    return json.dumps(row, default=str, sort_keys=True)
