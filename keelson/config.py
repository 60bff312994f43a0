"""Settings and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ReadTracking:
    enabled: bool = True
    max_keys_per_session: int = 256
    max_pair_inserts_per_query: int = 4096
    max_graph_edges: int = 500_000
    pair_weight: float = 1.0


@dataclass(frozen=True)
class ReadMergePolicy:
    """Neighbouring records are read together if the gap and the whole range stay within these bytes."""

    max_read_gap_bytes: int = 4096
    max_range_bytes: int = 1 << 20


@dataclass(frozen=True)
class SchedulerConfig:
    max_bytes_rewritten_per_cycle: int = 4 << 20
    max_groups_relocated_per_cycle: int = 8
    cpu_budget_share: float = 0.25
    edge_pressure_ratio: float = 0.35
    fragmentation_segments: int = 12
    locality_gain: float = 2.0
    cooldown_cycles_per_key: int = 4
    cooldown_cycles_per_group: int = 3
    minimum_improvement_delta: float = 0.05


@dataclass(frozen=True)
class PlannerConfig:
    max_keys_per_group: int = 64
    max_bytes_per_group: int = 262_144
    affinity_threshold: float = 0.15
    min_expected_gain: float = 0.5
    hysteresis_per_key: float = 0.02
    segment_classes: int = 4


PATTERNS = ("Random", "Clustered", "SkewedZipfian", "MixedReadWrite", "AdversarialAlternating")


@dataclass(frozen=True)
class WorkloadSpec:
    pattern: str = "Random"
    key_space: int = 10_000
    query_batch_size: int = 8
    num_query_batches: int = 64
    cluster_count: int = 16
    zipf_s: float = 1.2
    read_fraction: float = 0.7
    mixed_steps: int = 200
    write_payload_len: int = 32


@dataclass(frozen=True)
class HarnessConfig:
    seed: int = 0xC0FFEE
    spec: WorkloadSpec = field(default_factory=WorkloadSpec)
    load_key_count: int = 10_000
    stabilization_cycles: int = 24
    planner: PlannerConfig = PlannerConfig(max_keys_per_group=8, affinity_threshold=0.05, min_expected_gain=0.0, hysteresis_per_key=0.0)
    scheduler: SchedulerConfig = SchedulerConfig(max_bytes_rewritten_per_cycle=256 * 1024, max_groups_relocated_per_cycle=4, minimum_improvement_delta=0.02)
    merge: ReadMergePolicy = ReadMergePolicy()
    tracking: ReadTracking = ReadTracking()
    initial_segment_rotation: int = 512
    max_relocation_traces: int = 16
    planning_key_bytes: int = 32


@dataclass(frozen=True)
class StoreConfig:
    data_dir: str
    tracking: ReadTracking = ReadTracking()
    merge: ReadMergePolicy = ReadMergePolicy()
    scheduler: SchedulerConfig = SchedulerConfig()
    planner: PlannerConfig = PlannerConfig()
