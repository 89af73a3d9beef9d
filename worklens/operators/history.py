"""History of changing attributes: gaps and islands over updates or snapshots.

Within an entity, a row whose attribute hash differs from the row before marks a change; the running sum of marks numbers
the islands, an island's first row gives the start of a version and the next island's first row its end.

An entity with very many rows is cut at quantiles of its time into runs that are worked on apart; what stands at the end
of a run is carried to the next over one row for each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hash(c: Column) -> Column:
    return F.md5(F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")))


def _runs(df: DataFrame, keys: list[str], at: str, run_rows: int) -> tuple[DataFrame, bool]:
    """``df`` with __run: 0, or for entities of more than ``run_rows`` rows the run of its time, such that equal times are in one run; and whether there are such entities."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__rows")).where(F.col("__rows") > run_rows)
    if sizes.isEmpty():
        return df.withColumn("__run", F.lit(0)), False
    most = sizes.agg(F.max("__rows")).first()[0]
    pieces = int(most // run_rows) + 1
    quantiles = F.percentile_approx(F.unix_micros(at), [i / pieces for i in range(1, pieces)] or [0.5], 10000)
    cuts = df.join(sizes.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.array_distinct(quantiles).alias("__cuts"))
    run = F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.unix_micros(at))), F.lit(0))
    return df.join(cuts, keys, "left").withColumn("__run", F.when(F.col("__cuts").isNull(), 0).otherwise(run)).drop("__cuts"), True


def versions(df: DataFrame, keys: list[str], at: str, id_col: str, value: str, before: str | None = None, run_rows: int = 1_000_000) -> DataFrame:
    """(keys, value, valid_from, valid_to, open_id, close_id): every version of ``value`` of each entity.

    Rows are taken by ``at`` (a timestamp), then ``id_col``. A row begins a version if its value differs from that of the
    row before; for an entity's first row from its own ``before`` if that is given, else always. Null is a value like
    any other and equals itself. ``valid_to`` and ``close_id`` are null for the last version. Rows without time, id or
    one of the keys cannot be placed and are left out. Rows that agree in keys, time and both values are one, under the
    least id. Other columns are not read. An empty table gives an empty result.
    """
    value_before = F.col(before) if before else F.lit(None).cast("string")
    rows = df.select(*keys, F.col(at).alias("__at"), F.col(id_col).alias("__id"), F.col(value).alias("__v"), value_before.alias("__b"))
    rows = rows.dropna(subset=[*keys, "__at", "__id"])
    part = [*keys, "__run"]
    rows, split = _runs(rows, keys, "__at", run_rows)
    rows = rows.repartition(*part).groupBy(*part, "__at", "__v", "__b").agg(F.min("__id").alias("__id"))
    w = Window.partitionBy(*part).orderBy("__at", "__id")
    # The last value of the runs before, one row for each run.
    ends = rows.groupBy(*part).agg(F.max(F.struct("__at", "__id", _hash(F.col("__v")).alias("h")))["h"].alias("__end"))
    across = Window.partitionBy(*keys).orderBy("__run")
    carried = ends.select(*part, F.lag("__end").over(across).alias("__carried")).where("__carried is not null")
    marked = rows.withColumn("__h", _hash(F.col("__v"))).withColumn("__prev", F.lag("__h").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    if split:
        marked = marked.join(carried, part, "left").withColumn("__prev", F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__prev")))
    own = _hash(F.col("__b")) if before else F.lit("")
    mark = (F.col("__h") != F.coalesce("__prev", own)).cast("int")
    islands = marked.withColumn("__island", F.sum(mark.cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    opened = islands.where("__island > 0").groupBy(*part, "__island").agg(F.min(F.struct("__at", "__id", "__v")).alias("__o"))
    v = Window.partitionBy(*part).orderBy("__island")
    out = opened.select(*part, "__island", "__o", F.lead("__o").over(v).alias("__c"))
    if split:
        all_runs = ends.select(*part).join(opened.groupBy(*part).agg(F.min("__o").alias("__c1")), part, "left")
        follow = all_runs.select(*part, F.first("__c1", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("__c2"))
        out = out.join(follow, part, "left").withColumn("__c", F.coalesce("__c", "__c2"))
    return out.select(
        *keys,
        F.col("__o.__v").alias("value"),
        F.col("__o.__at").alias("valid_from"),
        F.col("__c.__at").alias("valid_to"),
        F.col("__o.__id").alias("open_id"),
        F.col("__c.__id").alias("close_id"),
    )


def snapshot_history(df: DataFrame, keys: list[str], at: str, attributes: list[str]) -> DataFrame:
    """(keys, attributes, valid_from, valid_to) from periodic snapshots: ``versions`` of all ``attributes`` together."""
    state = F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"})
    kind = df.select(*attributes).schema
    rows = df.select(*keys, F.col(at).alias("__t"), F.col(at).cast("string").alias("__i"), state.alias("__s"))
    out = versions(rows, keys, "__t", "__i", "__s").withColumn("__x", F.from_json("value", kind))
    return out.select(*keys, *[F.col(f"__x.`{a}`") for a in attributes], "valid_from", "valid_to")
