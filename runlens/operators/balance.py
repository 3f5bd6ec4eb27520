"""Parallelism guard for CPU-heavy row work over a source of few files.

A scan yields one task per file split.  A small input (one file, one row
group) is one task, and per-row parsing then runs on one core however many
the cluster has.  ``spread_files`` adds a round-robin repartition only where
the source has fewer files than the cluster has cores.  It asks for the file
list alone, which runs no job; library operators never repartition by
themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_files(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """``df``, a scan and projections of files, over at least as many tasks as cores."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= target else df.repartition(target)
