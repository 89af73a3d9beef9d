"""Timelines of issues out of their change entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stays(entries: DataFrame, key: str, at: str, id_col: str, before: str, after: str, created: str | None = None) -> DataFrame:
    """(key, value, micros, place): how long each value lasted until the entry that ended it.

    The first stay runs from ``created`` (if given and known) in the first entry's ``before``; the last, open one is not listed.
    Negative stays are left out; a null value is "unknown".
    """
    w = Window.partitionBy(key).orderBy(at, id_col)
    start = F.coalesce(F.lag(at).over(w), F.col(created) if created else F.lit(None).cast("timestamp"))
    value = F.when(F.row_number().over(w) == 1, F.col(before)).otherwise(F.lag(after).over(w))
    out = entries.select(key, F.coalesce(value, F.lit("unknown")).alias("value"), (F.unix_micros(at) - F.unix_micros(start)).alias("micros"), F.row_number().over(w).alias("place"))
    return out.where("micros >= 0")


def sequences(entries: DataFrame, key: str, at: str, id_col: str, before: str, after: str) -> DataFrame:
    """(key, sequence, steps): the values of each entity in order, joined by " > ". One aggregation; entries of one entity only."""
    row = F.struct(at, id_col, before, after)
    rows = entries.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("r"))
    names = F.concat(F.array(F.coalesce(F.expr(f"r[0].{before}"), F.lit("unknown"))), F.transform("r", lambda x: F.coalesce(x[after], F.lit("unknown"))))
    return rows.select(key, F.array_join(names, " > ").alias("sequence"), F.size("r").alias("steps"))


def returned(entries: DataFrame, key: str, at: str, id_col: str, after: str, terminal: Column) -> DataFrame:
    """(key, returned): whether an entry leads out of a terminal value again."""
    w = Window.partitionBy(key).orderBy(at, id_col).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(terminal.cast("int")).over(w)
    marked = entries.withColumn("__back", ((F.coalesce(seen, F.lit(0)) == 1) & ~F.coalesce(terminal, F.lit(False))).cast("int"))
    return marked.groupBy(key).agg((F.max("__back") == 1).alias("returned"))
