"""Keyed tables kept in hash buckets under a manifest.

A manifest is one small file for each version, written last: it names the folder in which each bucket of each table lies,
and what else the owner keeps (counts, numbers of batches). A writer puts new buckets into a folder of its own and then
commits the next manifest by renaming, so a writer that fails leaves the version before it as it is, and of two writers
of one version one fails. Buckets that a batch does not touch are neither read nor written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"


class Store:
    """A folder with a manifest: ``state`` is a dictionary of plain values, ``places`` {table: {bucket: folder}}, ``sizes`` {table: number of buckets}."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.state, self.places, self.sizes = 0, {}, {}, {}
        self.reload()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def reload(self) -> None:
        """The newest version that is committed."""
        versions = [int(n.split(".")[0]) for n in self._names(f"{self.root}/_manifest") if n.endswith(".json")]
        if versions:
            self.version = max(versions)
            stream = self.fs.open(self._path(f"{self.root}/_manifest/{self.version:012d}.json"))
            try:
                kept = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            self.state, self.sizes = kept["state"], kept["sizes"]
            self.places = {t: {int(b): p for b, p in places.items()} for t, places in kept["places"].items()}

    def folder(self) -> str:
        """A new folder for files of the next version."""
        return f"{self.root}/v{self.version + 1:012d}-{uuid.uuid4().hex[:8]}"

    def commit(self, state: dict, places: dict[str, dict[int, str]], sizes: dict[str, int]) -> None:
        body = json.dumps({"state": state, "places": places, "sizes": sizes})
        draft = self._path(f"{self.root}/_manifest/{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        target = self._path(f"{self.root}/_manifest/{self.version + 1:012d}.json")
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            self.fs.delete(draft, False)
            raise RuntimeError(f"another writer has committed version {self.version + 1} of {self.root}")
        before = self.places
        self.version += 1
        self.state, self.places, self.sizes = state, {t: dict(p) for t, p in places.items()}, dict(sizes)
        self._sweep(before)

    def _sweep(self, before: dict[str, dict[int, str]]) -> None:
        """Remove folders that neither this version nor the one before it names, which a reader may still have open."""
        named = {p.removeprefix(f"{self.root}/").split("/")[0] for places in (before, self.places) for t in places.values() for p in t.values()}
        named |= {str(v).removeprefix(f"{self.root}/").split("/")[0] for v in self.state.values() if isinstance(v, str)}
        for name in self._names(self.root):
            if name.startswith("v") and name not in named and int(name[1:13]) < self.version:
                self.fs.delete(self._path(f"{self.root}/{name}"), True)
        for name in self._names(f"{self.root}/_manifest"):
            if name.endswith(".json") and int(name[:12]) < self.version - 1:
                self.fs.delete(self._path(f"{self.root}/_manifest/{name}"), False)


def bucket_of(n: int, keys: Iterable[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n)).cast("int").alias(BUCKET)


class Table:
    """One table of a store: ``read`` it, or some of its buckets; ``stage`` rows for a version that is committed later."""

    def __init__(self, store: Store, name: str, schema: str, keys: list[str], rows_a_bucket: int = 1_000_000, least: int = 4) -> None:
        self.store, self.name, self.schema, self.keys, self.rows, self.least = store, name, schema, keys, rows_a_bucket, least

    @property
    def n(self) -> int:
        return self.store.sizes.get(self.name, self.least)

    @property
    def places(self) -> dict[int, str]:
        return self.store.places.get(self.name, {})

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        paths = [p for b, p in self.places.items() if only is None or b in set(only)]
        return self.store.spark.read.schema(self.schema).parquet(*paths) if paths else self.store.spark.createDataFrame([], self.schema)

    def stage(self, rows: DataFrame, folder: str, n: int | None = None, **measures: Column) -> tuple[dict[int, str], dict]:
        """Write ``rows``, each to its bucket of ``n``. Returns the places of the buckets that have rows, and ``rows`` and other measures of what was written.

        One task writes one bucket, so ``n`` bounds what a task holds: about ``rows_a_bucket`` rows.
        """
        n = n or self.n
        seen = Observation()
        rows = rows.withColumn(BUCKET, bucket_of(n, self.keys)).observe(seen, F.count("*").alias("rows"), *[c.alias(k) for k, c in measures.items()])
        rows.repartition(n, BUCKET).write.partitionBy(BUCKET).parquet(f"{folder}/{self.name}")
        names = self.store._names(f"{folder}/{self.name}")
        places = {int(x.split("=")[1]): f"{folder}/{self.name}/{x}" for x in names if x.startswith(f"{BUCKET}=")}
        return places, seen.get if places else {"rows": 0, **dict.fromkeys(measures, 0)}  # a plan known to be empty is not measured

    def grown(self, rows: int) -> int:
        """The number of buckets for so many rows: that of now, doubled until a bucket is within its bound."""
        n = self.n
        while rows > n * self.rows:
            n *= 2
        return n

    def merged(self, places: dict[int, str], touched: Iterable[int]) -> dict[int, str]:
        """All places after the ``touched`` buckets went to ``places`` or, having no rows left, nowhere."""
        return {**{b: p for b, p in self.places.items() if b not in set(touched)}, **places}


def upsert_into(table: Table, batch: DataFrame, order: list[str], number: int | None = None) -> bool:
    """Merge ``batch`` into ``table``: of the rows of a key the greatest by ``order``, then by all other columns, stays.

    Only buckets of keys in the batch are read and written. ``number``: a batch with a number that is not above the last
    one taken is a repeat and changes nothing; the result then is false. Rows with a null key are a key of their own.
    """
    from worklens.sources.tables import latest_rows

    store = table.store
    if number is not None and number <= store.state.get("number", -1):
        return False
    folder = store.folder()
    fresh = Table(store, f"{table.name}-new", table.schema, table.keys)
    new, seen = fresh.stage(latest_rows(batch.select(*store.spark.createDataFrame([], table.schema).columns), table.keys, order), folder, table.n)
    n = table.grown(store.state.get(f"rows-{table.name}", 0) + seen["rows"])
    arrived = store.spark.read.schema(table.schema).parquet(*new.values()) if new else store.spark.createDataFrame([], table.schema)
    touched = list(new) if n == table.n else list(table.places)
    old = table.read(touched)
    places, rows = table.stage(latest_rows(old.unionByName(arrived), table.keys, order), folder, n)
    kept = table.merged(places, touched if n == table.n else table.places)
    count = rows["rows"] + (store.state.get(f"rows-{table.name}", 0) - _rows(old) if n == table.n and touched else 0)
    state = {**store.state, f"rows-{table.name}": count, **({} if number is None else {"number": number})}
    store.commit(state, {**store.places, table.name: kept}, {**store.sizes, table.name: n})
    return True


def _rows(df: DataFrame) -> int:
    return df.count()  # from the footers of the files
