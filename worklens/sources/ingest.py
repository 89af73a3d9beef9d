"""From a wiki's pages and a tracker's JSON to stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.functions import text
from worklens.functions.markup import markdown_of
from worklens.sources import store

_NAMED = "struct<name: string>"
ISSUE = (
    f"key string, fields struct<summary: string, description: string, issuetype: {_NAMED}, priority: {_NAMED}, status: {_NAMED}, labels: array<string>, components: array<{_NAMED}>, "
    "assignee: struct<displayName: string>, created: string, updated: string, resolutiondate: string{more}>"
)
CHANGES = "key string, changelog struct<histories: array<struct<id: string, created: string, author: struct<displayName: string, accountId: string>, items: array<struct<field: string, fromString: string, toString: string>>>>>"
PAGE = "id string, title string, spaceKey string, status string, labels array<string>, body string, parentId string, authorId string, createdAt string, updatedAt string, url string"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of JSON files, one record each; files and folders as Spark names them."""
    return spark.read.text(path)


def tickets_of(raw: DataFrame, points: tuple[str, ...] = ()) -> DataFrame:
    """Tickets of (value) records: names out of their objects, missing lists empty, the first of the fields ``points`` that is not null.

    A record that cannot be read, or has no key, gives no row.
    """
    more = "".join(f", `{p}`: double" for p in points)
    r = raw.select(F.from_json("value", ISSUE.format(more=more)).alias("r")).select("r.*").where("key is not null")
    none = F.array().cast("array<string>")
    at = lambda c: F.to_timestamp(F.col(f"fields.{c}"))
    given = F.coalesce(*[F.col(f"fields.`{p}`") for p in points], F.lit(None).cast("double")).cast("int")
    return r.select(
        F.col("key").alias("issue_key"), F.coalesce("fields.summary", F.lit("")).alias("summary"), "fields.description", F.coalesce("fields.issuetype.name", F.lit("Unknown")).alias("issue_type"),
        F.coalesce("fields.priority.name", F.lit("Unknown")).alias("priority"), given.alias("story_points"), F.coalesce("fields.labels", none).alias("labels"),
        F.coalesce(F.transform("fields.components", lambda c: c["name"]), none).alias("components"), F.coalesce("fields.status.name", F.lit("Unknown")).alias("status"),
        F.col("fields.assignee.displayName").alias("assignee"), at("created").alias("created"), at("updated").alias("updated"), at("resolutiondate").alias("resolution_date"),
    )


def changes_of(raw: DataFrame) -> DataFrame:
    """(issue_key, id, created, author_name, author_id, field, from_value, to_value): a row for each item of each entry of the records' logs."""
    r = raw.select(F.from_json("value", CHANGES).alias("r")).select("r.key", F.explode("r.changelog.histories").alias("h")).where("key is not null")
    each = r.select("key", "h.id", "h.created", "h.author", F.explode("h.items").alias("i"))
    return each.select(F.col("key").alias("issue_key"), "id", "created", F.col("author.displayName").alias("author_name"), F.col("author.accountId").alias("author_id"), "i.field", F.col("i.fromString").alias("from_value"), F.col("i.toString").alias("to_value"))


def enriched(tickets: DataFrame, changes: DataFrame) -> DataFrame:
    """``tickets`` with their changes nested in order of time and id as ``changelog``, an empty list where there are none."""
    row = F.struct("created", "id", "field", "from_value", "to_value")
    nested = changes.groupBy("issue_key").agg(F.array_sort(F.collect_list(row)).alias("changelog"))
    kind = nested.schema["changelog"].dataType.simpleString()
    return tickets.join(nested, "issue_key", "left").withColumn("changelog", F.coalesce("changelog", F.array().cast(kind)))


def pages_of(raw: DataFrame, source: str) -> DataFrame:
    """Pages of (value) records of a wiki, in the columns of the store; HTML bodies become Markdown."""
    r = raw.select(F.from_json("value", PAGE).alias("r")).select("r.*").where("id is not null")
    at = lambda c: F.to_timestamp(F.col(c))
    return r.select("id", F.col("spaceKey").alias("space_key"), "title", "url", markdown_of(F.coalesce("body", F.lit(""))).alias("content"), F.to_json(F.coalesce("labels", F.array().cast("array<string>"))).alias("labels"), F.col("parentId").alias("parent_id"), F.col("authorId").alias("author_id"), at("createdAt").alias("created_at"), at("updatedAt").alias("updated_at"), F.lit(source).alias("source"))


def wanted(body: Column, labels: Column, include: list[str] = [], exclude: list[str] = []) -> Column:  # noqa: B006
    """Whether a page is to be indexed: it has a body, one of ``include`` if any are given, and none of ``exclude``; without regard to case."""
    tags = F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.lower)
    ok = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)\s", "") != ""
    for names, sign in ((include, True), (exclude, False)):
        if names:
            hit = F.arrays_overlap(tags, F.array(*[F.lit(n.lower()) for n in names]))
            ok = ok & F.coalesce(hit if sign else ~hit, F.lit(not sign))
    return ok


def crawled(pages: DataFrame, known: DataFrame, include: list[str] = [], exclude: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """The pages of a crawl that are to be stored, with their type and cleaned content, and their chunks.

    ``pages``: (id, title, content, labels as JSON, updated_at, ...); ``known``: (id, updated_at) of stored ones. A page that
    is not wanted, or has its stored stamp, is passed over. Narrow but for the comparison of stamps.
    """
    from worklens.operators import sections

    labels = F.from_json("labels", "array<string>")
    new = store.needs_update(pages.where(wanted(F.col("content"), labels, include, exclude)), known, "id", "updated_at")
    typed = new.withColumn("page_type", text.page_type(F.col("title"), labels, F.col("content"))).withColumn("content", text.strip_boilerplate(F.col("content")))
    return typed, sections.chunk_pages(typed, "id", "content")
