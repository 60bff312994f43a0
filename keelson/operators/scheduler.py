"""Deciding what to relocate: triggers, budgets, and the guards of a cycle.

A cycle looks at plan groups in order of gain until its budget is spent. That order matters, so the walk is
sequential; what it reads of each group - bytes, gain, colocation - is computed by Spark beforehand, one
row a group, and only as many rows as the budget allows are looked at.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.config import SchedulerConfig

#: Triggers by priority.
TRIGGERS = ("Fragmentation", "GraphPressure", "LocalityGain")
#: Bytes of a key whose size is not known.
UNKNOWN_BYTES = 8


def edge_pressure(edge_count: Column, max_edges: Column) -> Column:
    return F.when(max_edges == 0, F.lit(0.0)).otherwise(edge_count / max_edges)


def triggers_fired(inputs: DataFrame, cfg: SchedulerConfig = SchedulerConfig()) -> DataFrame:
    """Adds fired (by priority) and primary (null if none) to rows of edge_count, max_graph_edges, segment_count, plan_total_gain."""
    tests = (
        F.col("segment_count") >= cfg.fragmentation_segments,
        edge_pressure(F.col("edge_count"), F.col("max_graph_edges")) >= cfg.edge_pressure_ratio,
        F.col("plan_total_gain") >= cfg.locality_gain,
    )
    fired = F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in zip(tests, TRIGGERS)]), lambda x: x.isNotNull())
    return inputs.withColumn("fired", fired).withColumn("primary", F.get("fired", 0))


def primary_trigger(edge_count: int, max_edges: int, segments: int, gain: float, cfg: SchedulerConfig) -> str | None:
    tests = (segments >= cfg.fragmentation_segments, (edge_count / max_edges if max_edges else 0.0) >= cfg.edge_pressure_ratio, gain >= cfg.locality_gain)
    return next((n for n, t in zip(TRIGGERS, tests) if t), None)


@dataclass(frozen=True)
class Budget:
    max_bytes: int
    max_groups: int

    def allows(self, used_bytes: int, used_groups: int, more_bytes: int) -> bool:
        return used_groups < self.max_groups and used_bytes + more_bytes <= self.max_bytes


def effective_budget(cfg: SchedulerConfig) -> Budget:
    """Limits times the CPU share, held within 0 and 1 and rounded down."""
    share = min(max(cfg.cpu_budget_share, 0.0), 1.0)
    return Budget(int(cfg.max_bytes_rewritten_per_cycle * share), int(cfg.max_groups_relocated_per_cycle * share))


def budget_columns(max_bytes: Column, max_groups: Column, share: Column) -> tuple[Column, Column]:
    held = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return F.floor(max_bytes * held).cast("bigint"), F.floor(max_groups * held).cast("bigint")


def key_sizes(idx: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """key, bytes: known sizes, or the default for every indexed key where none are known."""
    if known is not None and not known.isEmpty():
        return known.select("key", "bytes")
    return idx.select("key", F.lit(UNKNOWN_BYTES).cast("bigint").alias("bytes"))


def group_facts(groups: DataFrame, idx: DataFrame, sizes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What a cycle reads of each plan group: estimated bytes, bytes to be rewritten, and the greatest share in one segment."""
    by = by or ["group_id"]
    keys = groups.select(*by, F.explode("keys").alias("key"))
    estimate = keys.join(sizes, [*[c for c in by if c in sizes.columns], "key"], "left").groupBy(*by).agg(F.sum(F.coalesce("bytes", F.lit(UNKNOWN_BYTES))).alias("estimated_bytes"))
    held = keys.join(idx.select(*[c for c in by if c in idx.columns], "key", "segment_id", "size"), [*[c for c in by if c in idx.columns], "key"])
    counts = held.groupBy(*by, "segment_id").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    share = counts.groupBy(*by).agg((F.max("c") / F.sum("c")).alias("share"), F.sum("s").alias("actual_bytes"))
    return groups.join(estimate, by).join(share, by, "left").fillna(0, ["share", "actual_bytes"])


@dataclass
class Cooldowns:
    """Cycles until which keys and groups rest, the cycle count and totals."""

    cycle: int = 0
    keys: dict[int, int] = field(default_factory=dict)
    groups: dict[int, int] = field(default_factory=dict)
    bytes_rewritten: int = 0
    groups_relocated: int = 0

    def rests(self, group_id: int, keys: Iterable[int]) -> bool:
        return self.cycle < self.groups.get(group_id, 0) or any(self.cycle < self.keys.get(k, 0) for k in keys)

    def rest(self, group_id: int, keys: Iterable[int], cfg: SchedulerConfig) -> None:
        self.groups[group_id] = self.cycle + cfg.cooldown_cycles_per_group
        self.keys.update(dict.fromkeys(keys, self.cycle + cfg.cooldown_cycles_per_key))


@dataclass
class CycleReport:
    cycle: int
    ran: bool = False
    primary_trigger: str | None = None
    bytes_rewritten: int = 0
    groups_relocated: int = 0
    skipped_cooldown: int = 0
    skipped_low_gain: int = 0
    budget_cutoff: bool = False
    logical_bytes_estimated: int = 0
    relocated: list[int] = field(default_factory=list)


def walk(groups: Iterable[dict], state: Cooldowns, cfg: SchedulerConfig, trigger: str | None, relocate) -> CycleReport:
    """One cycle over groups in descending gain (ties by group_id).

    groups have group_id, keys, expected_gain, estimated_bytes and colocated (a value or a function);
    relocate(group) moves one and returns the bytes it wrote. The budget is tested with estimates and
    consumed by what was written.
    """
    state.cycle += 1
    report = CycleReport(state.cycle, primary_trigger=trigger)
    if trigger is None:
        return report
    report.ran = True
    budget = effective_budget(cfg)
    if not budget.max_bytes or not budget.max_groups:
        return report
    for g in groups:
        if g["expected_gain"] < cfg.minimum_improvement_delta:
            report.skipped_low_gain += 1
        elif state.rests(g["group_id"], g["keys"]):
            report.skipped_cooldown += 1
        elif g["colocated"]() if callable(g["colocated"]) else g["colocated"]:
            report.skipped_low_gain += 1
        elif not budget.allows(report.bytes_rewritten, report.groups_relocated, g["estimated_bytes"]):
            report.budget_cutoff = True
            break
        else:
            report.logical_bytes_estimated += g["estimated_bytes"]
            report.bytes_rewritten += relocate(g) or g["estimated_bytes"]
            report.groups_relocated += 1
            report.relocated.append(g["group_id"])
            state.rest(g["group_id"], g["keys"], cfg)
    state.bytes_rewritten += report.bytes_rewritten
    state.groups_relocated += report.groups_relocated
    return report


def select_within_budget(groups: DataFrame, budget: Budget, spent: str = "estimated_bytes", order: list | None = None) -> DataFrame:
    """The groups that a fresh cycle takes, as a fold: in order of gain, up to the first that the budget refuses.

    Only as many groups as the budget admits are looked at.
    """
    order = order or [F.desc("expected_gain"), F.asc("group_id")]
    first = groups.orderBy(*order).limit(budget.max_groups)
    rows = first.agg(F.sort_array(F.collect_list(F.struct((-F.col("expected_gain")).alias("down"), "group_id", F.col(spent).alias("bytes")))).alias("rows"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("shut"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        refused = acc["shut"] | (acc["used"] + x["bytes"] > budget.max_bytes)
        return F.struct(
            F.when(refused, acc["used"]).otherwise(acc["used"] + x["bytes"]).cast("bigint").alias("used"), refused.alias("shut"),
            F.when(refused, acc["taken"]).otherwise(F.concat(acc["taken"], F.array(x["group_id"]))).alias("taken"),
        )

    taken = rows.select(F.explode(F.aggregate("rows", zero, step)["taken"]).alias("group_id"))
    return groups.join(taken, "group_id", "left_semi")
