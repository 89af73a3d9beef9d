"""Exact Jaccard similarity of token sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions.text import jaccard
from worklens.plans.lineage import cut


def similar_pairs(sets: DataFrame, key: str, tokens: str, threshold: float, strict: bool = False) -> DataFrame:
    """(key_a, key_b, similarity): pairs of rows, key_a below key_b, with Jaccard similarity of at least (``strict``: above) ``threshold``.

    Equal sets are one class first. Only the rarest tokens of a class, as many as a similar partner must share one of,
    are join keys (prefix filter; exact). A pair whose sizes differ too much, or that has too few tokens left behind the
    places at which it meets, is none; the sets of the others are compared where they meet, so that only similar pairs are
    exchanged again. A token with very many sets is a skewed join key, which adaptive execution splits. Empty sets have no
    partner.
    """
    canonical = sets.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(tokens)).alias("t")).where(F.size("t") > 0)
    classes = canonical.groupBy("t").agg(F.min("k").alias("c"))
    each = classes.select("c", F.explode("t").alias("w"))
    df = each.groupBy("w").agg(F.count("*").alias("df"))
    ranked = cut(each.join(df, "w").groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("r")))
    heads = ranked.select("c", "r", F.size("r").alias("n"), F.posexplode(F.expr(f"slice(r, 1, cast(size(r) - ceil(size(r) * {threshold}D) + 1 as int))")).alias("i", "w"))
    a, b = heads.toDF("a", "ta", "na", "i", "w"), heads.toDF("b", "tb", "nb", "j", "w")
    shared = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9  # tokens that a similar pair has in common
    near = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9) & (F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) >= shared)
    met = a.join(b, "w").where("a < b").where(near).select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("similarity"))
    pairs = met.where(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold).distinct()
    members = canonical.distinct().join(classes, "t").select("c", "k")
    across = pairs.join(members.toDF("a", "ka"), "a").join(members.toDF("b", "kb"), "b").select("ka", "kb", "similarity")
    within = members.toDF("c", "ka").join(members.toDF("c", "kb"), "c").where("ka < kb").select("ka", "kb", F.lit(1.0).alias("similarity"))
    within = within.where(F.lit(not strict or threshold < 1))
    return across.union(within).select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "similarity")


def similar_to(sets: DataFrame, key: str, tokens: str, query: list[str] | DataFrame, threshold: float) -> DataFrame:
    """(key, similarity): rows similar to one set of tokens given as a parameter. A filter: no shuffle.

    ``query`` may be a table (query, tokens) instead: then (query, key, similarity), by prefix filter as in ``similar_pairs``.
    """
    if isinstance(query, DataFrame):
        return _similar_to_each(sets, key, tokens, query, threshold)
    q = F.array(*[F.lit(x) for x in query]) if query else F.array().cast("array<string>")
    return sets.select(F.col(key), jaccard(F.array_distinct(tokens), q).alias("similarity")).where(F.col("similarity") >= threshold)


def _similar_to_each(sets: DataFrame, key: str, tokens: str, queries: DataFrame, threshold: float) -> DataFrame:
    rows = sets.select(F.col(key).alias("k"), F.array_distinct(tokens).alias("t")).where(F.size("t") > 0)
    asked = queries.select(F.col("query").alias("k"), F.array_distinct("tokens").alias("t")).where(F.size("t") > 0)
    df = rows.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    rarest = F.expr(f"slice(r, 1, cast(size(t) - ceil(size(t) * {threshold}D) + 1 as int))")

    def heads(x: DataFrame) -> DataFrame:
        placed = x.select("k", "t", F.explode("t").alias("w")).join(df, "w", "left").groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("r"), F.first("t").alias("t"))
        return placed.select("k", "t", F.explode(F.transform(rarest, lambda y: y["w"])).alias("w"))

    met = heads(asked).toDF("query", "tq", "w").join(heads(rows), "w")
    close = F.least(F.size("t"), F.size("tq")) >= F.lit(threshold) * F.greatest(F.size("t"), F.size("tq"))
    pairs = met.where(close).select("query", F.col("k").alias(key), jaccard(F.col("t"), F.col("tq")).alias("similarity")).distinct()
    return pairs.where(F.col("similarity") >= threshold)


def best_by_keywords(sets: DataFrame, key: str, tokens: str, queries: DataFrame, threshold: float, keywords: int, most: int) -> DataFrame:
    """(query, key, similarity, rank): for each of ``queries`` (query, tokens) the ``most`` rows of at least ``threshold`` similarity among
    those that hold its ``keywords`` longest tokens. The longest one is the join key, so what is compared follows the rows that hold it."""
    from pyspark.sql import Window

    from worklens.functions.text import longest

    asked = queries.select("query", F.array_distinct("tokens").alias("q")).withColumn("k", longest(F.col("q"), keywords)).where(F.size("k") > 0).withColumn("w", F.col("k")[0])
    rows = sets.select(F.col(key), F.array_distinct(tokens).alias("t"))
    met = rows.withColumn("w", F.explode("t")).join(asked, "w").where(F.size(F.array_except("k", "t")) == 0)
    out = met.select("query", key, jaccard(F.col("t"), F.col("q")).alias("s")).where(F.col("s") >= threshold).select("query", key, F.round("s", 6).alias("similarity"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))).where(F.col("rank") <= most)
