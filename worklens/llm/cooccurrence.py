"""Items that appear together: an incremental pair table.

Baskets arrive in batches. A changed basket subtracts the pairs and items it had and adds those it has now; the signed
deltas are summed before the shuffle and merged into counts that are kept in hash buckets. Only buckets with changes are
read and written again. The table lives in a folder under a manifest (``sources.buckets``): it can be opened again at any
time, a batch that fails leaves no trace, and one that is repeated changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.plans.lineage import ensure_checkpoint_dir, parallelism, together
from worklens.sources.buckets import Store, Table
from worklens.sources.tables import load

_ITEM, _PAIR = "item string, n bigint", "item_a string, item_b string, n bigint"


class PairTable:
    """Persistent counts of baskets, items and pairs in the folder ``root`` (a new one if it is not given).

    ``apply(changed, removed, batch)`` takes rows (basket_id, items array<string>): the present state of baskets that are
    new or have changed (of several rows with one id the one greatest by its items counts), and rows (basket_id) of
    baskets that are no more. Null items are dropped, repeated ones count once, a null or empty list is a basket without
    items that still counts as a basket. A basket that is in both is removed. Rows without a basket_id are left out. Other
    columns are not read. A ``batch`` with a number that is not above that of the last one taken changes nothing.

    ``rows_a_bucket``: the number of buckets follows the number of rows, so that no task holds more than about so many.
    ``block``: of a basket with more items the pairs are made by many tasks, one for each two blocks of items.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, rows_a_bucket: int = 1_000_000, block: int = 512) -> None:
        self.spark, self.block = spark, block
        self.store = Store(spark, root or f"{ensure_checkpoint_dir(spark)}/pairs-{uuid.uuid4().hex}")
        self.baskets = Table(self.store, "baskets", "basket_id string, items array<string>", ["basket_id"], rows_a_bucket)
        self.items = Table(self.store, "items", _ITEM, ["item"], rows_a_bucket)
        self.pairs = Table(self.store, "pairs", _PAIR, ["item_a", "item_b"], rows_a_bucket)

    @property
    def total(self) -> int:
        """The number of baskets."""
        return self.store.state.get("baskets", 0)

    def _signed(self, both: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
        """The deltas of items and of pairs of baskets (was, now)."""
        signed = both.select(F.explode(F.array(F.struct(F.lit(-1).alias("s"), F.col("was").alias("items")), F.struct(F.lit(1).alias("s"), F.col("now").alias("items")))).alias("x")).select("x.*").where("size(items) > 0")
        items = signed.select("s", F.explode("items").alias("item"))
        short = signed.where(F.size("items") <= self.block).select("s", "items", F.posexplode("items").alias("i", "item_a"))
        pairs = short.where("i + 1 < size(items)").select("s", "item_a", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("item_b"))
        if longest > self.block:
            b = self.block
            last = F.expr(f"cast((size(items) - 1) div {b} as int)")
            long = signed.where(F.size("items") > b).select("s", "items", F.posexplode(F.sequence(F.lit(0), last)).alias("i", "__i"))
            two = long.select("s", "i", F.expr(f"slice(items, i * {b} + 1, {b})").alias("a"), F.explode(F.expr(f"transform(sequence(i, cast((size(items) - 1) div {b} as int)), j -> slice(items, j * {b} + 1, {b}))")).alias("b"))
            two = two.repartition(4 * parallelism(self.spark))
            met = two.select("s", F.explode("a").alias("item_a"), "b").select("s", "item_a", F.explode("b").alias("item_b")).where("item_a < item_b")  # items are sorted
            pairs = pairs.union(met)
        total = F.sum(F.col("s").cast("bigint")).alias("n")
        return items.groupBy("item").agg(total).where("n <> 0"), pairs.groupBy("item_a", "item_b").agg(total).where("n <> 0")

    def _merge(self, table: Table, delta: DataFrame, folder: str, state: dict) -> tuple[dict, dict, int]:
        """Stage the ``delta`` and, where there are counts already, the sums of both. Places of the delta, of the table, and its number of buckets."""
        known = state.get(f"rows-{table.name}", 0)
        fresh = Table(self.store, f"{table.name}-delta", table.schema, table.keys)
        places, seen = fresh.stage(delta, folder, table.n)
        n = table.grown(known + seen["rows"])
        if not table.places and n == table.n:
            state[f"rows-{table.name}"] = seen["rows"]
            return places, places, n
        touched = list(places) if n == table.n else list(table.places)
        if not places:
            return places, table.places, table.n
        old = table.read(touched)
        arrived = self.spark.read.schema(table.schema).parquet(*places.values())
        sums = old.unionByName(arrived).groupBy(*table.keys).agg(F.sum("n").alias("n")).where("n <> 0")
        new, rows = table.stage(sums, folder, n)
        state[f"rows-{table.name}"] = rows["rows"] if n != table.n else known + rows["rows"] - old.count()
        return places, table.merged(new, touched if n == table.n else table.places), n

    def apply(self, changed: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> bool:
        """Take a batch; false if it was a repeat."""
        store, state = self.store, dict(self.store.state)
        if batch is not None and batch <= state.get("batch", -1):
            return False
        folder = store.folder()
        clean = F.array_sort(F.array_distinct(F.filter(F.coalesce("items", F.array().cast("array<string>")), lambda x: x.isNotNull())))
        new = changed.select(F.col("basket_id").cast("string").alias("basket_id"), clean.alias("items"), F.lit(False).alias("gone"))
        if removed is not None:
            new = new.union(removed.select(F.col("basket_id").cast("string"), F.array().cast("array<string>"), F.lit(True)))
        new = new.where("basket_id is not null").groupBy("basket_id").agg(F.max(F.struct("gone", "items")).alias("r")).select("basket_id", "r.*")
        arrived = Table(store, "arrived", "basket_id string, items array<string>, gone boolean", ["basket_id"])
        places, seen = arrived.stage(new, folder, self.baskets.n, longest=F.max(F.size("items")), gone=F.count_if("gone"))
        if not places:
            return self._commit({**state, **({} if batch is None else {"batch": batch})}, {}, {}, {}, folder)
        new = self.spark.read.schema(arrived.schema).parquet(*places.values())
        old = self.baskets.read(places)
        n = self.baskets.grown(self.total + seen["rows"])
        if not any(b in self.baskets.places for b in places):
            both = new.where("not gone").select("basket_id", F.lit(None).cast("array<string>").alias("was"), F.col("items").alias("now"))
            grown, longest = seen["rows"] - seen["gone"], seen["longest"] or 0
        else:
            both = new.join(old.withColumnRenamed("items", "was"), "basket_id", "left").select("basket_id", "was", F.when(~F.col("gone"), F.col("items")).alias("now")).where("not (was <=> now)")
            change = Table(store, "changed", "basket_id string, was array<string>, now array<string>", ["basket_id"])
            at, counts = change.stage(both, folder, self.baskets.n, born=F.expr("count_if(was is null)"), died=F.expr("count_if(now is null)"), longest=F.max(F.greatest(F.size("was"), F.size("now"))))
            both = self.spark.read.schema(change.schema).parquet(*at.values()) if at else self.spark.createDataFrame([], change.schema)
            grown, longest = counts["born"] - counts["died"], counts["longest"] or 0
        items, pairs = self._signed(both, longest)
        state["baskets"] = self.total + grown
        if batch is not None:
            state["batch"] = batch
        whole = list(places) if n == self.baskets.n else list(self.baskets.places)

        def keep() -> dict[int, str]:
            if n == self.baskets.n and not any(b in self.baskets.places for b in places) and not seen["gone"]:
                return self.baskets.merged(places, places)
            kept = self.baskets.read(whole).join(new.select("basket_id"), "basket_id", "left_anti").unionByName(new.where("not gone").select("basket_id", "items"))
            return self.baskets.merged(self.baskets.stage(kept, folder, n)[0], whole)

        one, two, kept = together(self.spark, lambda: self._merge(self.items, items, folder, state), lambda: self._merge(self.pairs, pairs, folder, state), keep)
        merged = {"items": one, "pairs": two, "baskets": ({}, kept, n)}
        return self._commit(state, {k: v[0] for k, v in merged.items()}, {k: v[1] for k, v in merged.items()}, {k: v[2] for k, v in merged.items()}, folder)

    def _commit(self, state: dict, deltas: dict, places: dict, sizes: dict, folder: str) -> bool:
        last = {f"{t}-delta": deltas.get(t, {}) for t in ("items", "pairs")}
        self.store.commit(state, {**self.store.places, **places, **last}, {**self.store.sizes, **sizes})
        return True

    def affected(self) -> DataFrame:
        """(item_a, item_b): pairs whose own count or one of whose items' counts the last batch changed, those with no basket left among them."""
        items, own = (Table(self.store, f"{t.name}-delta", t.schema, t.keys).read() for t in (self.items, self.pairs))
        pairs = self.pairs.read()
        sides = [pairs.join(items.select(F.col("item").alias(c)), c, "left_semi").select("item_a", "item_b") for c in ("item_a", "item_b")]
        return sides[0].union(sides[1]).union(own.select("item_a", "item_b")).distinct()

    def scores(self, affected_only: bool = False) -> DataFrame:
        """(item_a, item_b, n_both, n_a, n_b, n_baskets, lift): item_a below item_b by code point; lift is how much more often than by chance.

        With ``affected_only`` the pairs of which the own count or an item's changed in the last batch; all other pairs have kept
        their counts, and their lift changes only by the number of baskets. A pair without baskets has no score.
        """
        pairs, items = self.pairs.read(), self.items.read()
        if affected_only:
            pairs = pairs.join(self.affected(), ["item_a", "item_b"], "left_semi")
        out = pairs.withColumnRenamed("n", "n_both")
        out = out.join(items.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a").join(items.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        lift = F.col("n_both") * F.lit(float(self.total)) / (F.col("n_a").cast("double") * F.col("n_b"))
        return out.select("item_a", "item_b", "n_both", "n_a", "n_b", F.lit(self.total).cast("bigint").alias("n_baskets"), lift.alias("lift"))


def item(prefix: str, c: Column) -> Column:
    """``prefix`` and the entry, trimmed, lower-cased, each run of blanks, ``_`` or ``-`` as one ``-``; null for a null or blank entry."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", F.concat(F.lit(prefix), F.regexp_replace(F.lower(t), r"(?U)[\s_-]+", "-")))


def ticket_items(tickets: DataFrame) -> DataFrame:
    """(basket_id, items): the labels (``l:``) and components (``c:``) of rows of tickets."""
    none = F.array().cast("array<string>")
    items = F.concat(F.transform(F.coalesce("labels", none), lambda x: item("l:", x)), F.transform(F.coalesce("components", none), lambda x: item("c:", x)))
    return tickets.select(F.col("issue_key").alias("basket_id"), items.alias("items"))


def ticket_pairs(spark: SparkSession, sf_dir: str, root: str | None = None) -> PairTable:
    """The pair table of the current tickets, built as it would be kept: the oldest row of each ticket first, then the current rows as changes."""
    t = load(spark, sf_dir, "tickets").select("issue_key", "updated", "labels", "components")
    rank = F.struct("updated", "labels", "components")
    ends = t.groupBy("issue_key").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
    table = PairTable(spark, root)
    table.apply(ticket_items(ends.select("issue_key", "first.labels", "first.components")))
    table.apply(ticket_items(ends.where("first.updated < last.updated or not (first <=> last)").select("issue_key", "last.labels", "last.components")))
    return table


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that stand on at least 6 current tickets and at least 3 times as often as by chance."""
    return ticket_pairs(spark, sf_dir).scores().where("n_both >= 6 and n_both * n_baskets >= 3 * n_a * n_b").select("item_a", "item_b")
