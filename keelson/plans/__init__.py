"""Whole computations: workloads, the benchmark harness, the store, and the query catalogue."""
