"""Parquet tables and their current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one greatest by ``order``, then by all other columns.

    An aggregate with map-side combine, so repeats of a hot key are reduced before the shuffle. Null orders come
    last; rows with a null key form one group. An empty table gives an empty table.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [c for c in order if c in rest]
    last = [c for c in rest if c not in first]
    row = F.max(F.struct(*[F.col(f"`{c}`") for c in first + last])).alias("__row")
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(row).select(*[F.col(f"`{c}`") if c in keys else F.col(f"__row.`{c}`") for c in df.columns])


def blank_to_null(c: Column) -> Column:
    """Trimmed of white space of every kind; null if nothing is left."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)
