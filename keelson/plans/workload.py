"""Seeded workloads: key batches in five patterns, reads mixed with writes in one of them."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.config import PATTERNS, WorkloadSpec
from keelson.functions.prng import Stream, derive_seed, zipf_cdf

STEP_SCHEMA = "scenario string, run_id int, seed string, step int, kind string, keys array<bigint>, key bigint, version bigint, payload binary"


def check(spec: WorkloadSpec) -> None:
    """Refuse specs whose batches could never be filled with distinct keys."""
    space, batch = max(spec.key_space, 1), spec.query_batch_size
    if spec.pattern not in PATTERNS:
        raise ValueError(f"unknown pattern {spec.pattern}")
    if batch > space:
        raise ValueError(f"{batch} distinct keys of {space}")
    if spec.pattern == "AdversarialAlternating" and batch > max(space // 2, 1):
        raise ValueError(f"{batch} distinct keys of half of {space}")
    if spec.pattern in ("Clustered", "MixedReadWrite"):
        clusters = max(spec.cluster_count, 1)
        span = math.ceil(space / clusters)
        last = min((clusters - 1) * span, space - 1)
        if batch > min(span, space - last):
            raise ValueError(f"{batch} distinct keys of a cluster of {min(span, space - last)}")


def _distinct(size: int, draw: Callable[[], int]) -> list[int]:
    """A batch: `size` draws at first, then one at a time until that many are distinct; ascending."""
    keys = {draw() for _ in range(size)}
    while len(keys) < size:
        keys.add(draw())
    return sorted(keys)


def steps(seed: int, spec: WorkloadSpec) -> Iterator[tuple[str, list[int] | None, int | None, int | None, bytes | None]]:
    """(kind, keys, key, version, payload) of each step."""
    check(spec)
    rng, space, size = Stream(seed), max(spec.key_space, 1), spec.query_batch_size
    shares = zipf_cdf(spec.key_space, spec.zipf_s).tolist() if spec.pattern == "SkewedZipfian" else []
    side = False

    def uniform() -> list[int]:
        return _distinct(size, lambda: rng.below(space))

    def clustered() -> list[int]:
        clusters = max(spec.cluster_count, 1)
        span = -(-space // clusters)
        base = min(rng.below(clusters) * span, space - 1)
        return _distinct(size, lambda: min(base + rng.below(span), space - 1))

    def zipf() -> list[int]:
        return _distinct(size, lambda: min(bisect_left(shares, rng.unit()), space - 1))

    def alternating() -> list[int]:
        nonlocal side
        side = not side
        half = max(space // 2, 1)
        first, width = (0, half) if side else (half, max(space - half, 1))
        return _distinct(size, lambda: min(first + rng.below(width), space - 1))

    one = {"Random": uniform, "Clustered": clustered, "SkewedZipfian": zipf, "AdversarialAlternating": alternating}
    if spec.pattern != "MixedReadWrite":
        for _ in range(spec.num_query_batches):
            yield "query", one[spec.pattern](), None, None, None
        return
    for _ in range(spec.mixed_steps):
        if rng.unit() < spec.read_fraction:
            yield "query", (uniform if rng.unit() < 0.5 else clustered)(), None, None, None
        else:
            key = rng.below(space)
            yield "write", None, key, 1, bytes(rng.bits() & 255 for _ in range(spec.write_payload_len))


def generate(spark: SparkSession, runs: list[tuple[str, int, int]], spec: WorkloadSpec) -> DataFrame:
    """Steps of many runs [(scenario, run_id, seed)], the scenario naming the pattern; a task for each run."""
    import dataclasses

    for scenario in {r[0] for r in runs}:
        check(dataclasses.replace(spec, pattern=scenario))

    def make(frames):
        for frame in frames:
            for scenario, run_id, seed in zip(frame["scenario"], frame["run_id"], frame["seed"]):
                own = dataclasses.replace(spec, pattern=scenario)
                rows = [(scenario, run_id, seed, k, *s) for k, s in enumerate(steps(int(seed), own))]
                yield pd.DataFrame(rows, columns=["scenario", "run_id", "seed", "step", "kind", "keys", "key", "version", "payload"]).astype({"key": "Int64", "version": "Int64"})

    listed = spark.createDataFrame([(s, i, str(seed)) for s, i, seed in runs], "scenario string, run_id int, seed string")
    return listed.repartition(min(len(runs), 256), "scenario", "run_id").mapInPandas(make, STEP_SCHEMA)


def schedule(scenarios: list[str], runs: int, base_seed: int) -> list[tuple[str, int, int]]:
    """All (scenario, run, seed); a run's seed is the same in every scenario."""
    return [(s, i, derive_seed(base_seed, i)) for s in scenarios for i in range(runs)]


def digest(made: DataFrame) -> DataFrame:
    """scenario, run_id, digest: depends on the seed and on every step in order."""
    step = F.concat_ws("|", "step", "kind", F.array_join(F.col("keys").cast("array<string>"), ","), "key", "version", F.hex("payload"))
    own = F.sort_array(F.collect_list(F.struct("step", F.sha2(step, 256).alias("h"))))
    return made.groupBy("scenario", "run_id", "seed").agg(own.alias("own")).select("scenario", "run_id", F.sha2(F.concat_ws(",", "seed", F.array_join("own.h", ",")), 256).alias("digest"))
