"""Statistics of groups: percentiles in two definitions, frequency ranks, trends, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(value: str, p: float) -> Column:
    """The least value with at least the share ``p`` of values at or below it; 0 for none."""
    return F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {value})"), F.lit(0))


def interpolated(value: str, p: float) -> Column:
    return F.expr(f"percentile({value}, {p})")


def percent(part: Column, whole: Column) -> Column:
    """A share in whole percent, halves up; 0 of nothing is 0."""
    return F.when(whole == 0, 0).otherwise(F.floor(F.lit(100.0) * part / F.when(whole == 0, 1).otherwise(whole) + 0.5)).cast("int")


def spread_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, p25, median, p75, p90, mean, sd): percentiles interpolated, p90 by nearest rank, population deviation. Nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        interpolated(value, 0.25).alias("p25"),
        interpolated(value, 0.5).alias("median"),
        interpolated(value, 0.75).alias("p75"),
        nearest_rank(value, 0.9).alias("p90"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.stddev_pop(value), 6).alias("sd"),
    )


def top_n(df: DataFrame, keys: list[str], item: str, n: int) -> DataFrame:
    """(keys, item, count, rank): the ``n`` most frequent items of each group; ties by item. Null items are left out.

    Counted with map-side combine first, so the window sees one row for each distinct item.
    """
    counts = df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("count"))
    w = Window.partitionBy(*keys).orderBy(F.desc("count"), item)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, slope, intercept) of a least-squares line; of one point the slope is 0 and the intercept its y."""
    one = F.count(y) <= 1
    return df.groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.round(F.when(one, 0.0).otherwise(F.regr_slope(y, x)), 6).alias("slope"),
        F.round(F.when(one, F.coalesce(F.max(F.col(y).cast("double")), F.lit(0.0))).otherwise(F.regr_intercept(y, x)), 6).alias("intercept"),
    )


def counts_by(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, name, n): rows by each of the columns of ``kinds`` {kind: column}, and of all, in one pass over the table. A null counts as an empty name."""
    sets = [[F.col(c)] for c in kinds.values()] + [[]]
    kind = F.lit("all")
    for k, c in kinds.items():
        kind = F.when(F.grouping(c) == 0, k).otherwise(kind)
    name = F.coalesce(*[F.col(c) for c in kinds.values()], F.lit(""))
    return df.groupingSets(sets, *[F.col(c) for c in kinds.values()]).agg(kind.alias("kind"), name.alias("name"), F.count("*").alias("n")).select("kind", "name", "n")


def two_places(c: Column) -> Column:
    """Rounded to two decimals, halves up."""
    return F.floor(c * 100 + 0.5) / 100


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with their place. First within hash parts of each group, so that no large group is one task."""
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    low = Window.partitionBy(*keys, "__part").orderBy(*order)
    few = df.withColumn("__part", part).withColumn("__place", F.row_number().over(low)).where(F.col("__place") <= n).drop("__part", "__place")
    return few.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)
