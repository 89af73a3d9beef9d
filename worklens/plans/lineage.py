"""Cutting lineage and spreading work, in ways that survive the loss of executors."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's ``spark.checkpoint.dir``; only in local mode a temporary one is made where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="worklens-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage ended."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    # New column ids: a checkpoint keeps constraints on columns of the plan before it, which a later union cannot resolve.
    return kept.select(*[F.col(f"`{c}`").alias(c) for c in kept.columns])


def cut_and_measure(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, Any]]:
    """``cut``, and aggregates of the rows that were written, in one job."""
    seen = Observation()
    named = [c.alias(k) for k, c in measures.items()]
    kept = cut(df.observe(seen, *named))
    try:
        return kept, seen.get
    except Exception:  # a plan that turned out to be empty is not measured
        return kept, kept.agg(*named).first().asDict()


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str, factor: int = 2) -> DataFrame:
    """Hash-partition by ``keys`` when a scan has fewer partitions than there are cores (a small file with one row group); else unchanged.

    Only used in front of Python stages that cost far more than moving their input.
    """
    n = parallelism(df.sparkSession)
    return df.repartition(factor * n, *keys) if df.rdd.getNumPartitions() < n else df


def together(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """The results of independent ``jobs``, submitted at once so that one's tasks run while another is being planned."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]
