"""Incremental sync as a stream: batches of rows are merged into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from worklens.sources.buckets import Store, Table, upsert_into


def synced(spark: SparkSession, target: str, schema: StructType, keys: list[str]) -> Table:
    """The table that ``sync`` keeps in ``target``."""
    return Table(Store(spark, target), "rows", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), keys)


def sync(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Read parquet files that arrive in ``source`` and keep in ``target`` the greatest row of each key by ``order``.

    Every batch rewrites the hash buckets that it has keys of, and no others. A batch that is repeated after a failure
    is known by its number and changes nothing. Runs until all files that are there have been taken.
    """

    def merge(batch: DataFrame, number: int) -> None:
        upsert_into(synced(spark, target, schema, keys), batch, order, number)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, late: str, length: str, by: str) -> DataFrame:
    """(window start, by, n) over a stream or table; rows later than ``late`` behind the newest are dropped by a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
