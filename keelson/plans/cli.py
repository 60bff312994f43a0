"""Command line of the layout benchmark: python -m keelson.plans.cli --preset small."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys

from keelson.config import PATTERNS
from keelson.plans import harness, workload
from keelson.session import local_session
from keelson.sources.reports import summary_lines, write_artifacts


def unsigned(text: str) -> int:
    """A decimal or 0x-prefixed number."""
    return int(text, 16 if text[:2].lower() == "0x" else 10)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="keelson-bench", description=__doc__)
    p.add_argument("--preset", choices=sorted(harness.PRESETS), help="runs, keys, batches and cycles at once")
    p.add_argument("--runs", type=int, default=11)
    p.add_argument("--base-seed", type=unsigned, default=0xBEEFC0DE)
    p.add_argument("--mode", choices=("single-process", "subprocess"), default="single-process")
    p.add_argument("--key-space", type=int, default=8000)
    p.add_argument("--batches", type=int, default=96)
    p.add_argument("--cycles", type=int, default=24)
    p.add_argument("--out-dir")
    p.add_argument("--csv", action="store_true")
    p.add_argument("--child-run", help="run one scenario once and print it as a line of JSON")
    p.add_argument("--child-seed", type=unsigned)
    p.add_argument("--child-run-id", type=int, default=0)
    p.add_argument("--cpus", type=int, default=8)
    known, _ = p.parse_known_args(argv)
    if known.preset:
        known.runs, known.key_space, known.batches, known.cycles = harness.PRESETS[known.preset]
    return known


def child(args: argparse.Namespace) -> dict:
    spark = local_session(args.cpus)
    runs = [(args.child_run, args.child_run_id, args.child_seed if args.child_seed is not None else args.base_seed)]
    row = harness.run(spark, runs, harness.template(args.key_space, args.batches, args.cycles))["results"].first().asDict()
    return row | {"seed": int(row["seed"])}


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    if args.child_run:
        if args.child_run not in PATTERNS:
            print(f"unknown scenario {args.child_run}", file=sys.stderr)
            return 2
        print(json.dumps(child(args)))
        return 0
    spark = local_session(args.cpus)
    if args.mode == "subprocess":
        rows = []
        for scenario, run_id, seed in workload.schedule(list(PATTERNS), args.runs, args.base_seed):
            command = [sys.executable, "-m", "keelson.plans.cli", "--child-run", scenario, "--child-seed", str(seed), "--child-run-id", str(run_id)]
            command += ["--key-space", str(args.key_space), "--batches", str(args.batches), "--cycles", str(args.cycles), "--cpus", str(args.cpus)]
            done = subprocess.run(command, capture_output=True, text=True, check=True)
            rows.append(json.loads(done.stdout.strip().splitlines()[-1]))
        results = spark.createDataFrame([{**r, "seed": str(r["seed"])} for r in rows]).withColumn("seed", _decimal())
        summary = harness.summarize(results, args.base_seed, args.mode)
    else:
        results, summary = harness.benchmark(spark, args.runs, args.key_space, args.batches, args.cycles, args.base_seed)
    for r in summary_lines(summary).orderBy("scenario").collect():
        print(r["line"])
    if args.out_dir:
        for path in write_artifacts(results, summary, args.out_dir, args.csv):
            print(path)
    return 0


def _decimal():
    from pyspark.sql import functions as F

    return F.col("seed").cast("decimal(20,0)")


if __name__ == "__main__":
    sys.exit(main())
