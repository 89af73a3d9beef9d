"""Near-duplicate tickets: the similarity join over the word sets of current tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm.simjoin import classes, sign, similar_classes
from worklens.plans.lineage import cut, spread
from worklens.sources.tables import load

LEAST_WORDS = 12


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "tickets").select("issue_key", "updated", "summary", "description").where("issue_key is not null")
    text = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("description", F.lit("")))
    return t.select(F.col("issue_key").alias("key"), "updated", text.alias("text"))


def ticket_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, h, g, n, ...): the signed word sets of the current tickets with at least 12 distinct words in summary and description.

    Rows are signed first, so that only signatures are exchanged to find the current ones. Of rows of a key with one
    ``updated`` the one with the greatest name (h, g) of its set counts.
    """
    signed = sign(spread(_texts(spark, sf_dir), "key"), ["key", "updated"], "text", least_words=LEAST_WORDS)
    rest = [c for c in signed.columns if c not in ("key", "updated")]
    last = signed.groupBy("key").agg(F.max(F.struct("updated", *rest)).alias("r"))
    return last.select("key", *[f"r.{c}" for c in rest]).where(F.col("n") >= LEAST_WORDS)


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reps, members = classes(ticket_sets(spark, sf_dir))
    texts = lambda asked: _texts(spark, sf_dir).join(asked.withColumnRenamed("rep", "key"), "key").select("cid", "h", "g", "text")
    return similar_classes(reps, texts, 0.6), members


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of issue keys, the smaller first, whose word sets have a Jaccard similarity of at least 0.6."""
    pairs, members = _links(spark, sf_dir)
    x = members.select(F.col("cid").alias("a"), F.col("key").alias("ka"))
    y = members.select(F.col("cid").alias("b"), F.col("key").alias("kb"))
    across = pairs.join(x, "a").join(y, "b").select("ka", "kb")
    within = x.withColumnRenamed("a", "c").join(y.select(F.col("b").alias("c"), "kb"), "c").where("ka < kb").select("ka", "kb")
    return across.union(within).select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cid, root): the least cid that each node reaches by ``links`` (a, b).

    Each round every node with links takes the name of the one of least rank among itself and its neighbours; nodes of one
    name become one, until no link is left. Ranks are hashes, new in each round, so whatever the order of the ids a round
    leaves a fraction of the nodes, and the rounds are about the logarithm of the longest chain. A round always joins some
    nodes, so the loop ends. Aggregations combine on the map side, so a node with very many links is no single task.
    """
    edges = cut(links.union(links.select("b", "a")).toDF("src", "dst").where("src <> dst").distinct())
    label = cut(nodes.select("cid", F.col("cid").alias("root")))
    turn = 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("rank"), F.col(c).alias("id"))  # noqa: B023, E731
        names = edges.groupBy("src").agg(F.min(rank("dst")).alias("via")).select("src", F.least(rank("src"), "via")["id"].alias("name"))
        names = cut(names)
        label = cut(label.join(names.withColumnRenamed("src", "root"), "root", "left").select("cid", F.coalesce("name", "root").alias("root")))
        of = names.select(F.col("src").alias("dst"), F.col("name").alias("to"))
        edges = cut(edges.join(names, "src").join(of, "dst").where("name <> to").select(F.col("name").alias("src"), F.col("to").alias("dst")).distinct())
        turn += 1
    least = label.groupBy("root").agg(F.min("cid").alias("least"))
    return cut(label.join(least, "root").select("cid", F.col("least").alias("root")))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each current ticket of at least 12 words: (issue_key, class_key, group_key, n_links).

    class_key: the least key with the same word set; group_key: the least key that is reached by near-duplicate links;
    n_links: the number of other tickets that it is a near-duplicate of. No pair of copies is spelt out.
    """
    pairs, members = _links(spark, sf_dir)
    pairs = cut(pairs)
    per = cut(members.groupBy("cid").agg(F.min("key").alias("class_key"), F.count("*").alias("copies")))
    root = components(per.select("cid"), pairs)
    both = pairs.union(pairs.select("b", "a")).toDF("cid", "other")
    linked = both.join(per.select(F.col("cid").alias("other"), "copies"), "other").groupBy("cid").agg(F.sum("copies").alias("n"))
    low = root.join(per, "cid").groupBy("root").agg(F.min("class_key").alias("group_key"))
    facts = per.join(root, "cid").join(low, "root").join(linked, "cid", "left")
    facts = facts.select("cid", "class_key", "group_key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return members.join(facts, "cid").select(F.col("key").alias("issue_key"), "class_key", "group_key", "n_links")
