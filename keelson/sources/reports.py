"""Sinks of benchmark results."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the CSV, in order.
CSV_COLUMNS = (
    "run_id", "seed", "scenario", "p50_baseline_ns", "p50_adapted_ns", "p95_baseline_ns", "p95_adapted_ns", "range_ops_baseline", "range_ops_adapted",
    "range_bytes_baseline", "range_bytes_adapted", "file_opens_baseline", "file_opens_adapted", "rec_per_range_baseline", "rec_per_range_adapted",
    "p95_gain", "range_ops_gain", "range_bytes_gain", "file_opens_gain", "rewrite_amplification", "planner_actions",
)


def write_artifacts(results: DataFrame, summary: DataFrame, folder: str, with_csv: bool = False) -> list[str]:
    """raw_runs.json, summary.json and, if wanted, runs.csv, overwritten. Results are some rows a scenario."""
    os.makedirs(folder, exist_ok=True)
    made = []
    for name, df, order in (("raw_runs.json", results, ["scenario", "run_id"]), ("summary.json", summary, ["scenario"])):
        rows = [{k: int(v) if k in ("seed", "base_seed") and v is not None else v for k, v in r.asDict().items()} for r in df.orderBy(*order).toLocalIterator()]
        made.append(os.path.join(folder, name))
        with open(made[-1], "w", encoding="utf-8") as f:
            json.dump(rows, f, indent=2)
    if with_csv:
        made.append(os.path.join(folder, "runs.csv"))
        with open(made[-1], "w", encoding="utf-8", newline="") as f:
            out = csv.writer(f)
            out.writerow(CSV_COLUMNS)
            for r in results.select(*CSV_COLUMNS).orderBy("scenario", "run_id").toLocalIterator():
                out.writerow([r[c] for c in CSV_COLUMNS])
    return made


def as_json(df: DataFrame) -> DataFrame:
    """Each row as pretty JSON."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))


def summary_lines(summary: DataFrame) -> DataFrame:
    """Each scenario's figures in a line."""
    text = F.format_string(
        "%s: p95 gain %+.3f, range reads %.2f -> %.2f, opens %.2f -> %.2f, records a range %.2f -> %.2f, +%d/-%d/0 %d, flips %d, amplification %.3f",
        "scenario", "median_p95_gain", "median_range_ops_baseline", "median_range_ops_adapted", "median_file_opens_baseline", "median_file_opens_adapted",
        "median_rec_per_range_baseline", "median_rec_per_range_adapted", "positive_gain_runs", "negative_gain_runs", "zeroish_gain_runs", "sign_flip_count", "median_rewrite_amplification",
    )
    return summary.select("scenario", text.alias("line"))


def write_graph(graph: DataFrame, path: str) -> None:
    """A graph snapshot, sorted by (a, b)."""
    graph.repartitionByRange("a", "b").sortWithinPartitions("a", "b").write.mode("overwrite").parquet(path)
