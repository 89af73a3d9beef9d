"""Keyed tables: upserts, replacements, deletions that cascade, and incremental tests, as DataFrame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.sources.tables import latest_rows


def upsert(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``batch`` in place of those with the same key (null equals null). Of several rows of a key in the batch the greatest stays."""
    new = latest_rows(batch.select(*table.columns), keys, [c for c in table.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [table[k].eqNullSafe(new[k]) for k in keys])
    return table.join(new, same, "left_anti").unionByName(new)


def replace_children(children: DataFrame, parent: str, batch: DataFrame) -> DataFrame:
    """``children`` with all rows of the parents in ``batch`` replaced by the batch's rows."""
    return children.join(batch.select(parent).distinct(), parent, "left_anti").unionByName(batch.select(*children.columns))


def delete_where(table: DataFrame, gone: Column, children: DataFrame, key: str, parent: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that stay, the children that stay, and (n_deleted). A condition that is null deletes nothing."""
    hit = F.coalesce(gone, F.lit(False))
    out = table.where(hit).select(F.col(key).alias(parent)).distinct()
    return table.where(~hit), children.join(out, parent, "left_anti"), table.where(hit).agg(F.count("*").alias("n_deleted"))


def needs_update(remote: DataFrame, stored: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows of ``remote`` that are not stored, have no stamp, or another stamp than the stored row."""
    s = stored.select(F.col(key).alias("__k"), F.col(stamp).alias("__s"), F.lit(True).alias("__there"))
    return remote.join(s, F.col(key) == F.col("__k"), "left").where(F.col("__there").isNull() | F.col(stamp).isNull() | ~F.col(stamp).eqNullSafe(F.col("__s"))).select(*remote.columns)


def lookup(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``table`` whose ``keys`` stand in ``wanted``. A null key is not found."""
    return table.join(wanted.select(*keys).distinct(), keys, "left_semi")


def where_given(table: DataFrame, **values: str | int | None) -> DataFrame:
    """The rows that have all given values; a value that is None lets all pass. The filters reach the scan."""
    for c, v in values.items():
        table = table if v is None else table.where(F.col(c) == v)
    return table


def settings(given: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key, value): the value set last for each key; ties by the greater value. A null key is none."""
    last = given.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, value))[value].alias(value))
    return last.select(F.col(key).alias("key"), F.col(value).alias("value"))


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows.select(*log.columns))
