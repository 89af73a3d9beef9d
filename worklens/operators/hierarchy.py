"""Parent-child links of unknown depth to full hierarchies.

Frontiers are joined downwards from the roots, each twice as deep as the one before: a node that has not reached a root
knows its nearest 1, 2, 4, ... ancestors, and takes on what the farthest of them knows. When that one has reached a root,
the node's path is whole; else the node knows twice as many. A branch of depth d takes log2 d joins, nodes that are done
leave the loop, and a node whose ancestors repeat stands on or below a loop, which shows where the loop is.

``levels`` does the same with a depth and one ancestor in place of all, for branches too deep to write their paths out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.plans.lineage import cut, cut_and_measure


@dataclass
class Hierarchy:
    """``up`` (id, up array): ancestors of every node that a root reaches, nearest first, up to the root.
    ``tangled`` (id, up array): nodes on or below loops; their ancestors go round the loop at least once. None if there are none."""

    up: DataFrame
    tangled: DataFrame | None


def clean_links(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent), one row for each node. Blanks around a parent do not count; a blank or null parent, or one that is no id, is null.

    Rows without an id are no nodes. Of several rows with one id the greatest parent counts; pass current rows.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.regexp_replace(F.col(f"`{parent_col}`").cast("string"), r"(?U)^\s+|\s+$", "").alias("parent")).where("id is not null")
    nodes = cut(rows.groupBy("id").agg(F.max("parent").alias("parent")))
    there = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    return nodes.withColumn("parent", F.when(F.col("parent") != "", F.col("parent"))).join(there, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("parent"))


def _repeats(up: Column) -> Column:
    return F.size(F.array_distinct(up)) < F.size(up)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def hierarchy(df: DataFrame, id_col: str, parent_col: str) -> Hierarchy:
    """Walk the links of ``df`` (current rows, see ``clean_links``).

    Defined for empty tables (no rows), several roots, missing parents (their children are roots), a node that is its own
    parent (a loop of one), and very deep branches. Joins are on ids that are unique on one side, so a parent with a third
    of all children is a skew that adaptive execution splits; no group is gathered.
    """
    nodes = clean_links(df, id_col, parent_col)
    none = F.array().cast("array<string>")
    start = nodes.select("id", F.when(F.col("parent").isNull(), none).otherwise(F.array("parent")).alias("up"), F.col("parent").isNotNull().alias("open"), F.lit(False).alias("loop"))
    step, seen = cut_and_measure(start, left=F.count_if("open"))
    done, looped = [step.where("not open")], 0
    while seen["left"]:
        waiting = step.where("open").select("id", "up", F.element_at("up", -1).alias("top"))
        known = _union([*done, step.where("open")]).select(F.col("id").alias("top"), F.col("up").alias("more"), F.col("open").alias("on"), F.col("loop").alias("round"))
        met = known.join(waiting, "top").select("id", F.concat("up", "more").alias("up"), "on", "round")
        loop = F.col("round") | F.col("on") & _repeats(F.col("up"))
        step, seen = cut_and_measure(met.select("id", "up", (F.col("on") & ~loop).alias("open"), loop.alias("loop")), left=F.count_if("open"), looped=F.count_if("loop"))
        looped += seen["looped"]
        done.append(step.where("not open"))
    whole = _union(done)
    return Hierarchy(whole.where("not loop").select("id", "up"), whole.where("loop").select("id", "up") if looped else None)


def _members(up: Column) -> Column:
    """The members of the loop at which the ancestors ``up``, which repeat, arrive."""
    once = F.array_distinct(up)
    back = F.array_position(once, F.element_at(up, F.size(once) + 1))
    return F.slice(once, back.cast("int"), F.size(once))


def ancestors(h: Hierarchy) -> DataFrame:
    """(id, ancestor): each node and each node above it, once. Members of a loop are above each other, themselves and all nodes below."""
    pairs = h.up.select("id", F.explode("up").alias("ancestor"))
    return pairs if h.tangled is None else pairs.union(h.tangled.select("id", F.explode(F.array_distinct("up"))))


def paths(h: Hierarchy) -> DataFrame:
    """(id, path, depth, root, on_loop): the path from the root to the node, both included; a root has depth 0.

    A node on or below a loop has as root the loop's least member, at which the loop is taken as opened.
    """
    out = h.up.select("id", "up", F.lit(False).alias("on_loop"))
    if h.tangled is not None:
        least = F.array_min(_members(F.col("up")))
        opened = h.tangled.select("id", "up", least.alias("least"), F.array_contains("up", F.col("id")).alias("on_loop"))
        to = F.when(F.col("id") == F.col("least"), 0).otherwise(F.array_position("up", F.col("least"))).cast("int")
        out = out.union(opened.select("id", F.slice("up", 1, to), "on_loop"))
    path = F.concat(F.reverse("up"), F.array("id"))
    return out.select("id", path.alias("path"), F.size("up").alias("depth"), F.element_at(path, 1).alias("root"), "on_loop")


def levels(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, depth, root) of every node that a root reaches; nodes on or below loops have no row. As ``hierarchy``, without paths.

    In each round the nodes of depth 2 ** k to 2 ** (k + 1) - 1 find their root; as every depth up to the greatest occurs, a
    round in which none does is the last.
    """
    nodes = clean_links(df, id_col, parent_col)
    start = nodes.select("id", F.coalesce("parent", "id").alias("top"), F.col("parent").isNotNull().cast("bigint").alias("depth"), F.col("parent").isNotNull().alias("open"))
    measures = {"left": F.count_if("open"), "found": F.count_if(~F.col("open"))}
    step, seen = cut_and_measure(start, **measures)
    done = [step.where("not open")]
    while seen["left"] and seen["found"]:
        waiting = step.where("open").select("id", "top", "depth")
        known = _union([*done, step.where("open")]).select(F.col("id").alias("top"), F.col("top").alias("far"), F.col("depth").alias("more"), "open")
        met = known.join(waiting, "top").select("id", F.col("far").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), "open")
        step, seen = cut_and_measure(met, **measures)
        done.append(step.where("not open"))
    return _union(done).select("id", F.col("depth").cast("int").alias("depth"), F.col("top").alias("root"))
