"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklens.functions import dates, markup, text
from worklens.operators import hierarchy as tree
from worklens.operators import search, sections, similarity, stats, timeline
from worklens.operators.history import snapshot_history, versions
from worklens.streaming import sync
from worklens.sources import store
from worklens.sources.tables import blank_to_null, latest_rows, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_query = query


def _current_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_rows(load(spark, sf_dir, "pages").select("id", "indexed_at", "parent_id"), ["id"], ["indexed_at"])


def _tree(spark: SparkSession, sf_dir: str) -> tree.Hierarchy:
    return tree.hierarchy(_current_links(spark, sf_dir), "id", "parent_id")


_LINKS = """with recursive cur as (
  select id, nullif(regexp_replace(parent_id, '^\\s+|\\s+$', '', 'g'), '') as parent from (select *, row_number() over (partition by id order by indexed_at desc) as rn from pages) where rn = 1
),
link as (select a.id, a.parent from cur a join cur b on a.parent = b.id),
up as (select id, parent as anc from link union select up.id, link.parent from up join link on up.anc = link.id)
"""


@_query(_LINKS + "select id as page_id, anc as ancestor_id from up")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and each page above it."""
    return tree.ancestors(_tree(spark, sf_dir)).toDF("page_id", "ancestor_id")


@_query(
    _LINKS
    + """, looped as (select id from up where id = anc),
below as (select distinct id from up where anc in (select id from looped)),
deep as (select id, count(*) as depth from up group by 1)
select cur.id as page_id, coalesce(deep.depth, 0)::int as depth,
  coalesce((select min(u.anc) from up u where u.id = cur.id and u.anc not in (select id from link)), cur.id) as root_id
from cur left join deep on deep.id = cur.id where cur.id not in (select id from below)"""
)
def p1_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and root of every page that is neither on nor below a loop."""
    return tree.levels(_current_links(spark, sf_dir), "id", "parent_id").select(F.col("id").alias("page_id"), "depth", F.col("root").alias("root_id"))


@_query(
    _LINKS
    + """, looped as (select id, min(anc) as least from up where id in (select id from up where id = anc) group by id),
opened as (select id, parent from link where id not in (select least from looped)),
way as (
  select id, 0 as depth, id as root, id as path from cur where id not in (select id from opened)
  union all select o.id, way.depth + 1, way.root, way.path || ' > ' || o.id from way join opened o on o.parent = way.id
)
select id as page_id, depth::int as depth, root, path, id in (select id from looped) as on_loop from way"""
)
def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root, depth, root and loop mark of every page."""
    return tree.paths(_tree(spark, sf_dir)).select(F.col("id").alias("page_id"), "depth", "root", F.array_join("path", " > ").alias("path"), "on_loop")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of changelogs, one for each id, with keys, fields and values in one spelling and the instant of ``created``."""
    logs = load(spark, sf_dir, "changelogs").select("id", "cached_at", "issue_key", "field", "from_value", "to_value", "created").where("id is not null")
    one = latest_rows(logs, ["id"], ["cached_at"])
    low = lambda c: F.coalesce(F.lower(blank_to_null(F.col(c))), F.lit(""))
    return one.select(
        "id",
        F.upper(blank_to_null(F.col("issue_key"))).alias("issue_key"),
        F.lower(blank_to_null(F.col("field"))).alias("field"),
        low("from_value").alias("from_value"),
        low("to_value").alias("to_value"),
        F.expr("try_cast(trim(created) as timestamp)").alias("at"),
    )


_HISTORY = """with one as (
  select id, upper(regexp_replace(issue_key, '^\\s+|\\s+$', '', 'g')) as issue_key, lower(regexp_replace(field, '^\\s+|\\s+$', '', 'g')) as field,
    lower(regexp_replace(coalesce(from_value, ''), '^\\s+|\\s+$', '', 'g')) as f, lower(regexp_replace(coalesce(to_value, ''), '^\\s+|\\s+$', '', 'g')) as t,
    regexp_replace(regexp_replace(created, 'Z$', '+00:00'), '([+-]\\d\\d)(\\d\\d)$', '\\1:\\2')::timestamptz as moment
  from (select *, row_number() over (partition by id order by cached_at desc) as rn from changelogs) where rn = 1
),
entry as (select issue_key, field, moment, f, t, min(id) as id from one group by all),
marked as (select *, t <> coalesce(lag(t) over w, f) as begins from entry window w as (partition by issue_key, field order by moment, id)),
version as (select *, lead(id) over w as next_id, lead(moment) over w as next_at from marked where begins window w as (partition by issue_key, field order by moment, id))
"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(changes(spark, sf_dir), ["issue_key", "field"], "at", "id", "to_value", before="from_value")


@_query(_HISTORY + "select issue_key, field, id as open_id, coalesce(next_id, 'open') as close_id from version")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of a field of an issue, with the entries that begin and end it."""
    return _versions(spark, sf_dir).select("issue_key", "field", "open_id", F.coalesce("close_id", F.lit("open")).alias("close_id"))


@_query(_HISTORY + "select issue_key, field, t as value, epoch_us(moment) as valid_from_us, epoch_us(next_at) as valid_to_us from version")
def p4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with its value and the period in which it was valid, in microseconds since 1970."""
    return _versions(spark, sf_dir).select("issue_key", "field", "value", F.unix_micros("valid_from").alias("valid_from_us"), F.unix_micros("valid_to").alias("valid_to_us"))


@_query(
    """with s as (select distinct id, indexed_at, title, parent_id from pages),
m as (select *, row_number() over w = 1 or title is distinct from lag(title) over w or parent_id is distinct from lag(parent_id) over w as begins from s window w as (partition by id order by indexed_at))
select id, title, parent_id, epoch_us(indexed_at) as valid_from_us, epoch_us(lead(indexed_at) over (partition by id order by indexed_at)) as valid_to_us from m where begins"""
)
def p4_page_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of title and parent of every page, from all its crawls as snapshots."""
    pages = load(spark, sf_dir, "pages").select("id", "indexed_at", "title", "parent_id")
    out = snapshot_history(pages, ["id"], "indexed_at", ["title", "parent_id"])
    return out.select("id", "title", "parent_id", F.unix_micros("valid_from").alias("valid_from_us"), F.unix_micros("valid_to").alias("valid_to_us"))


# Operators over pages, chunks and other kept tables.

_PAGES = "with cur as (select * from (select *, row_number() over (partition by id order by indexed_at desc) as rn from pages) where rn = 1)\n"
_TICKETS = "with cur as (select * from (select *, row_number() over (partition by issue_key order by updated desc) as rn from tickets) where rn = 1)\n"


def pages_now(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return latest_rows(pages.select(*dict.fromkeys(["id", "indexed_at", *(cols or pages.columns)])), ["id"], ["indexed_at"])


def tickets_now(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return latest_rows(load(spark, sf_dir, "tickets").select(*dict.fromkeys(["issue_key", "updated", *cols])), ["issue_key"], ["updated"])


@_query(_PAGES + "select id, title, page_type, substr(content, 1, 300) as preview from cur")
def s04_page_summaries(spark, d):
    return pages_now(spark, d, "title", "page_type", "content").select("id", "title", "page_type", F.substring("content", 1, 300).alias("preview"))


@_query(_PAGES + "select id, title, page_type from cur where page_type = 'runbook'")
def s03_pages_by_type(spark, d):
    return pages_now(spark, d, "title", "page_type").where("page_type = 'runbook'").select("id", "title", "page_type").orderBy("title", "id")


@_query(
    """with cut as (select id, indexed_at, title, date_trunc('day', indexed_at) as day from pages),
mid as (select quantile_disc(epoch_us(indexed_at), 0.5) as m from pages),
o as (select *, row_number() over (partition by id order by indexed_at desc, title desc) as rn from cut, mid where epoch_us(indexed_at) <= m),
n as (select *, row_number() over (partition by id order by indexed_at desc, title desc) as rn from cut, mid where epoch_us(indexed_at) > m)
select id, epoch_us(indexed_at) as indexed_us, title from n where rn = 1
union all select id, epoch_us(indexed_at), title from o where rn = 1 and id not in (select id from n)"""
)
def s05_upsert_pages(spark, d):
    pages = load(spark, d, "pages").select("id", "indexed_at", "title")
    mid = pages.agg(F.expr("percentile_disc(0.5) within group (order by unix_micros(indexed_at))").alias("mid"))
    marked = pages.join(F.broadcast(mid)).withColumn("newer", F.unix_micros("indexed_at") > F.col("mid"))  # one row
    table = latest_rows(marked.where("not newer").select(*pages.columns), ["id"], ["indexed_at"])
    return store.upsert(table, marked.where("newer").select(*pages.columns), ["id"]).select("id", F.unix_micros("indexed_at").alias("indexed_us"), "title")


@_query(_PAGES + ", meet as (select id, content from cur where page_type = 'meeting') select page_id, chunk_index, content from (select distinct page_id, chunk_index, content from chunks) where page_id not in (select id from meet) union all select id, 0, content from meet")
def s06_replace_chunks(spark, d):
    chunks = load(spark, d, "chunks").select("page_id", "chunk_index", "content").distinct()
    batch = pages_now(spark, d, "page_type", "content").where("page_type = 'meeting'").select(F.col("id").alias("page_id"), F.lit(0).alias("chunk_index"), "content")
    return store.replace_children(chunks, "page_id", batch).select("page_id", "chunk_index", "content")


@_query(_PAGES + ", gone as (select id from cur where page_type = 'meeting') select (select count(*) from gone) as n_deleted, (select count(*) from chunks where page_id not in (select id from gone)) as chunks_left")
def s09_delete_cascade(spark, d):
    _, left, deleted = store.delete_where(pages_now(spark, d, "page_type"), F.col("page_type") == "meeting", load(spark, d, "chunks").select("page_id"), "id", "page_id")
    return deleted.join(left.agg(F.count("*").alias("chunks_left")), how="cross")  # one row each


@_query("select board_id, id, state, row_number() over (partition by board_id order by start_date desc nulls last, id) as place from sprints")
def s10_sprints_by_board(spark, d):
    w = Window.partitionBy("board_id").orderBy(F.desc_nulls_last("start_date"), "id")
    return load(spark, d, "sprints").select("board_id", "id", "state", F.row_number().over(w).alias("place"))


@_query(_PAGES + "select id, case when json_array_length(labels) > 0 then array_to_string(labels::json::varchar[], ', ') else 'none' end as labels from cur")
def s24_labels(spark, d):
    return pages_now(spark, d, "labels").select("id", text.json_labels(F.col("labels")).alias("labels"))


@_query(_PAGES + "select id, (epoch_us(timestamp '2025-01-01') - epoch_us(updated_at)) // 86400000000 as days_ago from cur where updated_at < timestamp '2024-07-01'")
def f02_stale_pages(spark, d):
    asof = F.unix_micros(F.lit("2025-01-01").cast("timestamp"))
    return pages_now(spark, d, "updated_at").where("updated_at < timestamp '2024-07-01'").select("id", ((asof - F.unix_micros("updated_at")) / 86_400_000_000).cast("bigint").alias("days_ago"))


@_query(_PAGES + "select id, title from cur where indexed_at > (select quantile_disc(indexed_at, 0.9) from pages)")
def f03_changed_since(spark, d):
    since = load(spark, d, "pages").agg(F.expr("percentile_disc(0.9) within group (order by unix_micros(indexed_at))").alias("since"))
    return pages_now(spark, d, "title").join(F.broadcast(since)).where(F.unix_micros("indexed_at") > F.col("since")).select("id", "title")  # one row


@_query(
    """with r as (select id, updated_at, row_number() over (partition by id order by indexed_at desc) as n, row_number() over (partition by id order by indexed_at) as o from pages),
new as (select id, updated_at from r where n = 1), old as (select id, updated_at from r where o = 1)
select new.id from new join old using (id) where new.updated_at is null or new.updated_at is distinct from old.updated_at"""
)
def f04_needs_update(spark, d):
    pages = load(spark, d, "pages").select("id", "indexed_at", "updated_at")
    ends = pages.groupBy("id").agg(F.max(F.struct("indexed_at", "updated_at")).alias("n"), F.min(F.struct("indexed_at", "updated_at")).alias("o"))
    return store.needs_update(ends.select("id", "n.updated_at"), ends.select("id", "o.updated_at"), "id", "updated_at").select("id")


@_query(_PAGES + ", s as (select id, space_key, length(content) as n, sum(length(content)) over (partition by space_key order by id rows unbounded preceding) as upto from cur) select space_key, id, least(n, 20000 - (upto - n)) as chars from s where upto - n < 20000 - 100")
def f14_character_budget(spark, d):
    w = Window.partitionBy("space_key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    s = pages_now(spark, d, "space_key", "content").select("id", "space_key", F.length("content").alias("n")).withColumn("upto", F.sum("n").over(w))
    return s.where("upto - n < 20000 - 100").select("space_key", "id", F.expr("least(n, 20000 - (upto - n))").alias("chars"))


@_query(_PAGES + "select case when grouping(page_type) = 0 then 'type' when grouping(space_key) = 0 then 'space' when grouping(source) = 0 then 'source' else 'all' end as kind, coalesce(page_type, space_key, source, '') as name, count(*) as n from cur group by grouping sets ((page_type), (space_key), (source), ())")
def a01_statistics(spark, d):
    return stats.counts_by(pages_now(spark, d, "page_type", "space_key", "source"), {"type": "page_type", "space": "space_key", "source": "source"})


# Sprints.

_SPRINTS = """with one as (select distinct * from sprint_issues),
v as (select sprint_id, sum(coalesce(story_points, 0)) as committed, sum(case when lower(status_category) = 'done' then coalesce(story_points, 0) else 0 end) as completed,
  count(*) as issues, count(case when lower(status_category) = 'done' then 1 end) as done_issues from one group by 1)
"""


def _velocity(spark, d):
    done = F.lower("status_category") == "done"
    points = F.coalesce("story_points", F.lit(0))
    return load(spark, d, "sprint_issues").distinct().groupBy("sprint_id").agg(
        F.sum(points).alias("committed"), F.sum(F.when(done, points).otherwise(0)).alias("completed"), F.count("*").alias("issues"), F.count(F.when(done, 1)).alias("done_issues")
    )


@_query(_SPRINTS + "select sprint_id, committed, completed, committed - completed as carried, case when issues = 0 then 0 else floor(100.0 * done_issues / issues + 0.5) end::int as done_percent from v")
def a03_velocity(spark, d):
    return _velocity(spark, d).select("sprint_id", "committed", "completed", (F.col("committed") - F.col("completed")).alias("carried"), stats.percent(F.col("done_issues"), F.col("issues")).alias("done_percent"))


@_query(
    _SPRINTS
    + """, x as (select board_id, completed, row_number() over (partition by board_id order by start_date, id) - 1 as i from v join sprints on id = sprint_id where start_date is not null)
select board_id, count(completed) as n, round(case when count(completed) <= 1 then 0 else regr_slope(completed, i) end, 6) as slope,
  round(case when count(completed) <= 1 then max(completed)::double else regr_intercept(completed, i) end, 6) as intercept from x group by 1"""
)
def a04_velocity_trend(spark, d):
    s = load(spark, d, "sprints").where("start_date is not null").select(F.col("id").alias("sprint_id"), "board_id", "start_date")
    w = Window.partitionBy("board_id").orderBy("start_date", "sprint_id")
    return stats.trend(_velocity(spark, d).join(s, "sprint_id").withColumn("i", F.row_number().over(w) - 1), ["board_id"], "i", "completed")


@_query("with one as (select distinct * from sprint_issues) select sprint_id, coalesce(assignee, 'unassigned') as assignee, sum(coalesce(story_points, 0)) as points, count(*) as issues, round(sum(coalesce(story_points, 0)) * 1.0 / nullif(sum(sum(coalesce(story_points, 0))) over (partition by sprint_id), 0), 6) as share from one group by 1, 2")
def a10_capacity(spark, d):
    one = load(spark, d, "sprint_issues").distinct().groupBy("sprint_id", F.coalesce("assignee", F.lit("unassigned")).alias("assignee"))
    out = one.agg(F.sum(F.coalesce("story_points", F.lit(0))).alias("points"), F.count("*").alias("issues"))
    total = F.sum("points").over(Window.partitionBy("sprint_id"))
    return out.withColumn("share", F.round(F.try_divide(F.col("points"), total), 6))


@_query("with one as (select distinct * from sprint_issues) select issue_type, coalesce(lower(status_category), 'none') as category, count(*) as n, sum(coalesce(story_points, 0)) as points from one group by 1, 2")
def a16_progress(spark, d):
    return load(spark, d, "sprint_issues").distinct().groupBy("issue_type", F.coalesce(F.lower("status_category"), F.lit("none")).alias("category")).agg(F.count("*").alias("n"), F.sum(F.coalesce("story_points", F.lit(0))).alias("points"))


# Ticket statistics.

_SPREAD = "count(*) as n, quantile_cont({v}, 0.25) as p25, quantile_cont({v}, 0.5) as median, quantile_cont({v}, 0.75) as p75, quantile_disc({v}, 0.9) as p90, round(avg({v}), 6) as mean, round(stddev_pop({v}), 6) as sd"


@_query(_TICKETS + "select lower(trim(issue_type)) as issue_type, " + _SPREAD.format(v="story_points") + " from cur where story_points > 0 group by 1")
def a21_points_by_type(spark, d):
    t = tickets_now(spark, d, "issue_type", "story_points").where("story_points > 0").select(F.lower(F.trim("issue_type")).alias("issue_type"), "story_points")
    return stats.spread_of(t, ["issue_type"], "story_points")


_BUSINESS = "case when resolution_date <= created then 0 else greatest(1, (select count(*) from range(0, 4000) r(i) where created::date + i::int <= resolution_date::date and isodow(created::date + i::int) <= 5)) end"


@_query(_TICKETS + f", b as (select lower(trim(issue_type)) as issue_type, {_BUSINESS}::int as days from cur where resolution_date is not null and created is not null) select issue_type, " + _SPREAD.format(v="days") + " from b group by 1")
def a26_duration_by_type(spark, d):
    t = tickets_now(spark, d, "issue_type", "created", "resolution_date").select(F.lower(F.trim("issue_type")).alias("issue_type"), dates.business_days(F.col("created"), F.col("resolution_date")).alias("days"))
    return stats.spread_of(t, ["issue_type"], "days")


@_query(_TICKETS + f"select issue_key, {_BUSINESS}::int as days from cur where resolution_date is not null and created is not null")
def d01_business_days(spark, d):
    return tickets_now(spark, d, "created", "resolution_date").select("issue_key", dates.business_days(F.col("created"), F.col("resolution_date")).alias("days")).where("days is not null")


_TOP = """, x as (select issue_key, lower(trim(unnest({c}))) as item from cur), c as (select item, count(*) as count from x where item <> '' group by 1)
select item, count, row_number() over (order by count desc, item) as rank from c qualify rank <= 10"""


def _top(spark, d, col):
    t = tickets_now(spark, d, col).select(F.explode(col).alias("item")).select(F.lower(F.trim("item")).alias("item")).where("item <> ''")
    return stats.top_n(t.withColumn("g", F.lit(1)), ["g"], "item", 10).select("item", "count", "rank")


@_query(_TICKETS + _TOP.format(c="labels"))
def a22_top_labels(spark, d):
    return _top(spark, d, "labels")


@_query(_TICKETS + _TOP.format(c="components"))
def a23_top_components(spark, d):
    return _top(spark, d, "components")


@_query(_TICKETS + "select lower(trim(issue_type)) as issue_type, lower(trim(priority)) as priority, count(*) as n, floor(100.0 * count(*) / sum(count(*)) over () + 0.5)::int as percent from cur group by 1, 2")
def a28_type_and_priority(spark, d):
    n = tickets_now(spark, d, "issue_type", "priority").groupBy(F.lower(F.trim("issue_type")).alias("issue_type"), F.lower(F.trim("priority")).alias("priority")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).withColumn("percent", stats.percent(F.col("n"), F.col("total"))).drop("total")


@_query(
    _TICKETS
    + """, x as (select coalesce(assignee, '') as a, unnest(case when len(coalesce(components, [])) = 0 then ['unassigned'] else components end) as c from cur where assignee is not null),
n as (select lower(trim(c)) as component, a as assignee, count(*) as count from x where trim(c) <> '' group by 1, 2),
r as (select *, row_number() over (partition by component order by count desc, assignee) as rank, round(count * 1.0 / sum(count) over (partition by component), 6) as share from n)
select component, assignee, count, rank, share from r where rank <= 5"""
)
def a27_owners(spark, d):
    none = F.array(F.lit("unassigned"))
    t = tickets_now(spark, d, "assignee", "components").where("assignee is not null").select("assignee", F.explode(F.when(F.coalesce(F.size("components"), F.lit(0)) <= 0, none).otherwise(F.col("components"))).alias("c"))
    n = t.select("assignee", F.lower(F.trim("c")).alias("component")).where("component <> ''").groupBy("component", "assignee").agg(F.count("*").alias("count"))
    w = Window.partitionBy("component")
    out = n.withColumn("share", F.round(F.col("count") / F.sum("count").over(w), 6)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("count"), "assignee")))
    return out.where("rank <= 5").select("component", "assignee", "count", "rank", "share")


@_query(
    _TICKETS
    + """, h as (select issue_key, lower(trim(issue_type)) as issue_type, list_distinct(list_transform(regexp_extract_all(coalesce(description, ''), '(?m)^#{1,3}[ \\t]+([^\\r\\n]+)', 1), lambda x: lower(trim(x)))) as hs from cur),
n as (select issue_type, count(*) as tickets from h group by 1),
x as (select issue_type, unnest(hs) as heading from h)
select issue_type, heading, count(*) as n, floor(100.0 * count(*) / tickets + 0.5)::int as percent from x join n using (issue_type) group by issue_type, heading, tickets"""
)
def a31_headings_by_type(spark, d):
    t = tickets_now(spark, d, "issue_type", "description").select(F.lower(F.trim("issue_type")).alias("issue_type"), F.regexp_extract_all(F.coalesce("description", F.lit("")), F.lit(r"(?m)^#{1,3}[ \t]+([^\r\n]+)"), F.lit(1)).alias("hs"))
    total = t.groupBy("issue_type").agg(F.count("*").alias("tickets"))
    x = t.select("issue_type", F.explode(F.array_distinct(F.transform("hs", lambda h: F.lower(F.trim(h))))).alias("heading")).groupBy("issue_type", "heading").agg(F.count("*").alias("n"))
    return x.join(total, "issue_type").select("issue_type", "heading", "n", stats.percent(F.col("n"), F.col("tickets")).alias("percent"))


# Timelines of the status field.

_STATUS = _HISTORY + ", st as (select * from entry where field = 'status')\n"


def _status(spark, d):
    e = changes(spark, d).where("field = 'status' and issue_key is not null and at is not null")
    return e.groupBy("issue_key", "at", "from_value", "to_value").agg(F.min("id").alias("id"))


@_query(_STATUS + """, w as (select issue_key, row_number() over p as place, epoch_us(moment) - epoch_us(lag(moment) over p) as micros, lag(t) over p as value from st window p as (partition by issue_key order by moment, id))
select value, count(*) as n, sum(micros)::bigint as micros, max(micros) as longest from w where micros >= 0 group by 1""")
def w01_time_in_status(spark, d):
    s = timeline.stays(_status(spark, d), "issue_key", "at", "id", "from_value", "to_value")
    return s.groupBy("value").agg(F.count("*").alias("n"), F.sum("micros").alias("micros"), F.max("micros").alias("longest"))


@_query(_STATUS + """, cur as (select * from (select *, row_number() over (partition by issue_key order by updated desc) as rn from tickets) where rn = 1),
born as (select upper(regexp_replace(issue_key, '^\\s+|\\s+$', '', 'g')) as issue_key, min(created) as born from cur group by 1),
w as (select st.issue_key, case when row_number() over p = 1 then f else lag(t) over p end as value, epoch_us(moment) - epoch_us(coalesce(lag(moment) over p, born)) as micros from st left join born on st.issue_key = born.issue_key window p as (partition by st.issue_key order by moment, id))
select value, count(*) as n, sum(micros)::bigint as micros, max(micros) as longest from w where micros >= 0 group by 1""")
def w01_time_in_status_from_creation(spark, d):
    """As the reference counts it: the first stay of a ticket begins with its creation."""
    born = tickets_now(spark, d, "created").groupBy(F.upper(blank_to_null(F.col("issue_key"))).alias("issue_key")).agg(F.min("created").alias("born"))
    s = timeline.stays(_status(spark, d).join(born, "issue_key", "left"), "issue_key", "at", "id", "from_value", "to_value", created="born")
    return s.groupBy("value").agg(F.count("*").alias("n"), F.sum("micros").alias("micros"), F.max("micros").alias("longest"))


@_query(_STATUS + """, q as (select issue_key, first(f order by moment, id) || ' > ' || string_agg(t, ' > ' order by moment, id) as sequence, count(*) as steps from st group by 1)
select sequence, count(*) as n, count(*) * 100.0 / sum(count(*)) over () >= 1 as common from q where steps >= 1 group by 1""")
def w02_status_sequences(spark, d):
    q = timeline.sequences(_status(spark, d), "issue_key", "at", "id", "from_value", "to_value").groupBy("sequence").agg(F.count("*").alias("n"))
    return q.join(F.broadcast(q.agg(F.sum("n").alias("total")))).select("sequence", "n", (F.col("n") * 100.0 / F.col("total") >= 1).alias("common"))


@_query(_STATUS + """, m as (select issue_key, t in ('done', 'closed', 'resolved') as term, moment, id from st),
b as (select issue_key, not term and coalesce(max(term::int) over (partition by issue_key order by moment, id rows between unbounded preceding and 1 preceding), 0) = 1 as back from m)
select issue_key, bool_or(back) as returned from b group by 1""")
def w04_reopened(spark, d):
    return timeline.returned(_status(spark, d), "issue_key", "at", "id", "to_value", F.col("to_value").isin("done", "closed", "resolved"))


@_query(_STATUS + """, c as (select issue_key, min(moment) filter (t = 'in progress') as a, max(moment) filter (t in ('done', 'closed', 'resolved')) as z from st group by 1),
k as (select issue_key, (epoch_us(z) - epoch_us(a)) // 1000000 as seconds from c where z >= a)
select count(*) as n, quantile_disc(seconds, 0.5) as p50, quantile_disc(seconds, 0.75) as p75, quantile_disc(seconds, 0.9) as p90, sum(seconds)::bigint as total from k""")
def a09_cycle_time(spark, d):
    done = F.col("to_value").isin("done", "closed", "resolved")
    c = _status(spark, d).groupBy("issue_key").agg(F.min(F.when(F.col("to_value") == "in progress", F.col("at"))).alias("a"), F.max(F.when(done, F.col("at"))).alias("z"))
    k = c.where("z >= a").select(F.expr("(unix_micros(z) - unix_micros(a)) div 1000000").alias("seconds"))
    return k.agg(F.count("*").alias("n"), *[stats.nearest_rank("seconds", p).alias(f"p{round(p * 100)}") for p in (0.5, 0.75, 0.9)], F.sum("seconds").alias("total"))


# Similarity, search and text.

_STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_TOKENS = f"list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({{c}}, ''), '[^a-zA-Z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 2 and not list_contains({_STOPS}, x)))"


@_query(_TICKETS + ", s as (select issue_key, " + _TOKENS.format(c="summary") + """ as t from cur), w as (select issue_key, len(t) as n, unnest(t) as w from s),
p as (select a.issue_key as key_a, b.issue_key as key_b, a.n as na, b.n as nb, count(*) as k from w a join w b on a.w = b.w and a.issue_key < b.issue_key group by all)
select key_a, key_b, round(k * 1.0 / (na + nb - k), 6) as similarity from p where k * 1.0 / (na + nb - k) > 0.6""")
def j03_similar_summaries(spark, d):
    sets = tickets_now(spark, d, "summary").select("issue_key", text.tokens(F.col("summary")).alias("t"))
    return similarity.similar_pairs(sets, "issue_key", "t", 0.6, strict=True).withColumn("similarity", F.round("similarity", 6))


@_query(_TICKETS + ", s as (select issue_key, " + _TOKENS.format(c="summary") + """ as t from cur), w as (select issue_key, len(t) as n, unnest(t) as w from s),
p as (select a.issue_key as key_a, b.issue_key as key_b, a.n as na, b.n as nb, count(*) as k from w a join w b on a.w = b.w and a.issue_key < b.issue_key group by all)
select key_a, key_b, round(k * 1.0 / (na + nb - k), 6) as similarity from p where k * 1.0 / (na + nb - k) > 0.4""")
def j03_duplicates(spark, d):
    """The reference's pairwise duplicates: all pairs above 0.4."""
    sets = tickets_now(spark, d, "summary").select("issue_key", text.tokens(F.col("summary")).alias("t"))
    return similarity.similar_pairs(sets, "issue_key", "t", 0.4, strict=True).withColumn("similarity", F.round("similarity", 6))


@_query(_TICKETS + ", s as (select issue_key, " + _TOKENS.format(c="summary") + """ as t from cur), q as (select ['clean', 'federated', 'message', 'broker', 'cache'] as q)
select issue_key, round(len(list_intersect(t, q)) * 1.0 / (len(t) + 5 - len(list_intersect(t, q))), 6) as similarity from s, q where len(list_intersect(t, q)) * 1.0 / (len(t) + 5 - len(list_intersect(t, q))) >= 0.3""")
def j04_similar_to_draft(spark, d):
    sets = tickets_now(spark, d, "summary").select("issue_key", text.tokens(F.col("summary")).alias("t"))
    return similarity.similar_to(sets, "issue_key", "t", ["clean", "federated", "message", "broker", "cache"], 0.3).withColumn("similarity", F.round("similarity", 6))


@_query(_TICKETS + "select issue_key, list_sort(" + _TOKENS.format(c="summary") + ") as words from cur")
def t01_tokens(spark, d):
    return tickets_now(spark, d, "summary").select("issue_key", F.array_sort(text.tokens(F.col("summary"))).alias("words"))


SEARCHES = {"a": "rollout plan", "b": "the cache AND (runbook)", "c": "postmortem-decision", "d": "***"}

_BM25 = _PAGES + """, w as (select id, unnest(regexp_split_to_array(lower(title) || ' ' || lower(content), '[^0-9a-z]+')) as word from cur),
l as (select id, count(*) as len from w where word <> '' group by 1),
n as (select count(*) as n, (select sum(len) from l) * 1.0 / count(*) as avg from cur),
q(query, word, need) as (values ('a', 'rollout', 2), ('a', 'plan', 2), ('b', 'the', 3), ('b', 'cache', 3), ('b', 'runbook', 3), ('c', 'postmortem', 2), ('c', 'decision', 2)),
tf as (select id, word, count(*) as tf from w where word in (select word from q) group by 1, 2),
df as (select word, count(*) as df from tf group by 1),
h as (select query, id, count(*) as have, max(need) as need, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) as score
  from tf join df using (word) join q using (word) join l using (id), n group by 1, 2)
"""


def _searched(spark, d):
    return search.ranked(pages_now(spark, d, "title", "content"), "id", ["title", "content"], SEARCHES)


@_query(_BM25 + "select query, id from h where have = need")
def x03_all_words(spark, d):
    return _searched(spark, d).select("query", "id")


@_query(_BM25 + "select query, id, round(score, 3) as score from h where have = need")
def x04_ranked(spark, d):
    return _searched(spark, d).select("query", "id", F.round("score", 3).alias("score"))


@_query()
def x05_snippets(spark, d):
    hits = _searched(spark, d).where("query = 'a' and rank <= 10")
    return hits.join(pages_now(spark, d, "content"), "id").select("id", "rank", search.snippet(F.col("content"), search.query_words(SEARCHES["a"])).alias("snippet"))


@_query(
    _PAGES
    + """, c as (select distinct id, page_id, breadcrumb, heading, content from chunks),
hit as (select page_id from c where regexp_matches(lower(content), '(^|[^0-9a-z])rollout([^0-9a-z]|$)') and regexp_matches(lower(content), '(^|[^0-9a-z])plan([^0-9a-z]|$)'))
select distinct cur.id, cur.title from hit join cur on cur.id = hit.page_id"""
)
def x07_pages_of_chunk_hits(spark, d):
    chunks = load(spark, d, "chunks").groupBy("id").agg(F.max(F.struct("page_id", "content")).alias("c")).select("id", "c.page_id", "c.content")
    hits = search.ranked(chunks, "id", ["content"], {"a": SEARCHES["a"]}).join(chunks.select("id", "page_id"), "id").select("page_id").distinct()
    return pages_now(spark, d, "title").join(hits.withColumnRenamed("page_id", "id"), "id").select("id", "title")


# The same over the set query rows: every row whose id (of a ticket, its number) is divisible by 50, against all rows.

_TITLE = """list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce(title, ''), '[*"()^+-]', ' ', 'g'), '\\b(?:near|and|or|not)\\b', ' ', 'gi')), '[^0-9a-z]+'), lambda x: x <> ''))"""
_ASKED = "q0 as (select id as query, " + _TITLE + " as words from cur where try_cast(id as bigint) % 50 = 0),\nq as (select query, len(words) as need, unnest(words) as word from q0),\n"

_BM25_ROWS = _PAGES + ", " + _ASKED + """w as (select id, unnest(regexp_split_to_array(lower(coalesce(title, '')) || ' ' || lower(coalesce(content, '')), '[^0-9a-z]+')) as word from cur),
l as (select id, count(*) as len from w where word <> '' group by 1),
n as (select count(*) as n, (select sum(len) from l) * 1.0 / count(*) as avg from cur),
tf as (select id, word, count(*) as tf from w where word in (select word from q) group by 1, 2),
df as (select word, count(*) as df from tf group by 1),
h as (select query, id, count(*) as have, max(need) as need, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) as score
  from tf join df using (word) join q using (word) join l using (id), n group by 1, 2)
"""


@_query(_TICKETS + ", s as (select issue_key, " + _TOKENS.format(c="summary") + """ as t from cur), q as (select issue_key as query, t as q from s where try_cast(regexp_extract(issue_key, '-(\\d+)$', 1) as bigint) % 50 = 0)
select query, issue_key, round(len(list_intersect(t, q)) * 1.0 / (len(t) + len(q) - len(list_intersect(t, q))), 6) as similarity from s, q where len(t) > 0 and len(q) > 0 and len(list_intersect(t, q)) * 1.0 / (len(t) + len(q) - len(list_intersect(t, q))) >= 0.3""")
def j04_similar_to_rows(spark, d):
    sets = tickets_now(spark, d, "summary").select("issue_key", text.tokens(F.col("summary")).alias("t"))
    asked = sets.where(r"try_cast(regexp_extract(issue_key, '-(\\d+)$', 1) as bigint) % 50 = 0").select(F.col("issue_key").alias("query"), F.col("t").alias("tokens"))
    return similarity.similar_to(sets, "issue_key", "t", asked, 0.3).withColumn("similarity", F.round("similarity", 6))


def _asked(spark, d):
    return pages_now(spark, d, "title").where("try_cast(id as bigint) % 50 = 0").select(F.col("id").alias("query"), F.col("title").alias("text"))


def _searched_rows(spark, d):
    return search.ranked(pages_now(spark, d, "title", "content"), "id", ["title", "content"], _asked(spark, d))


@_query(_BM25_ROWS + "select query, id from h where have = need")
def x03_all_words_of_rows(spark, d):
    return _searched_rows(spark, d).select("query", "id")


@_query(_BM25_ROWS + "select query, id, round(score, 3) as score from h where have = need")
def x04_ranked_for_rows(spark, d):
    return _searched_rows(spark, d).select("query", "id", F.round("score", 3).alias("score"))


@_query()
def x05_snippets_for_rows(spark, d):
    hits = _searched_rows(spark, d).where("rank <= 10").join(_asked(spark, d), "query")
    return hits.join(pages_now(spark, d, "content"), "id").select("query", "id", "rank", search.snippet(F.col("content"), search.query_words_of(F.col("text"))).alias("snippet"))


@_query(
    _PAGES
    + """, c as (select distinct id, page_id, heading, content from chunks),
q0 as (select id as query, """
    + _TITLE.replace("title", "heading")
    + """ as words from c where id % 50 = 0),
q as (select query, len(words) as need, unnest(words) as word from q0),
w as (select distinct id, page_id, unnest(regexp_split_to_array(lower(coalesce(content, '')), '[^0-9a-z]+')) as word from c),
hit as (select query, w.id, page_id from q join w using (word) group by query, w.id, page_id having count(*) = max(need))
select distinct query, cur.id, cur.title from hit join cur on cur.id = hit.page_id"""
)
def x07_pages_of_chunk_hits_for_rows(spark, d):
    chunks = load(spark, d, "chunks").groupBy("id").agg(F.max(F.struct("page_id", "content", "heading")).alias("c")).select("id", "c.*")
    asked = chunks.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("heading").alias("text"))
    hits = search.ranked(chunks, "id", ["content"], asked).join(chunks.select("id", "page_id"), "id").select("query", F.col("page_id").alias("id")).distinct()
    return pages_now(spark, d, "title").join(hits, "id").select("query", "id", "title")


@_query()
def t04_markdown(spark, d):
    return pages_now(spark, d, "content").select("id", markup.markdown_of("content").alias("markdown"))


@_query(_PAGES + r"""select id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\|?[ \t]*Created by[^|\n]*\d{4}[ \t]*\|?', '', 'gi'),
  'Last (?:updated|modified|edited)[^\n]*\n', '', 'gi'), '\|\s*\|\s*\|\s*\n', '', 'g'), '\{(?:status|toc|panel|info|warning|note|tip|expand|jira)[^}]*\}', '', 'gi'), '\n{3,}', e'\n\n', 'g'), '^[\s\p{Z}\x{85}\x{0B}]+|[\s\p{Z}\x{85}\x{0B}]+$', '', 'g') as body from cur""")
def t05_boilerplate(spark, d):
    return pages_now(spark, d, "content").select("id", text.strip_boilerplate(F.col("content")).alias("body"))


@_query(
    _PAGES
    + r""", x as (select id, lower(title) as t, list_transform(labels::json::varchar[], lambda y: lower(y)) as l, lower(substr(content, 1, 500)) as h from cur)
select id, case
  when regexp_matches(t, 'adr[-\s]?\d+|architecture decision|decision record') or list_has_any(l, ['adr', 'architecture-decision', 'decision-record']) or (contains(h, '## status') and contains(h, '## context') and contains(h, '## decision')) then 'adr'
  when regexp_matches(t, 'design doc|technical design|rfc') or list_has_any(l, ['design', 'design-doc', 'technical-design', 'rfc']) then 'design'
  when regexp_matches(t, 'runbook|playbook') or list_has_any(l, ['runbook', 'playbook', 'operations', 'incident']) then 'runbook'
  when regexp_matches(t, 'meeting\s*(?:notes|minutes)|\d{4}[-/]\d{2}[-/]\d{2}.*meeting') or list_has_any(l, ['meeting', 'meeting-notes', 'minutes']) then 'meeting'
  when regexp_matches(t, 'specification|requirements|\bprd\b') or list_has_any(l, ['spec', 'specification', 'requirements', 'prd']) then 'spec'
  else 'other' end as kind from x"""
)
def t06_page_types(spark, d):
    return pages_now(spark, d, "title", "labels", "content").select("id", text.page_type(F.col("title"), F.from_json("labels", "array<string>"), F.col("content")).alias("kind"))


@_query()
def t09_chunks(spark, d):
    return sections.chunk_pages(pages_now(spark, d, "content"), "id", "content")


@_query(_TICKETS + r"""select issue_key, case when len(regexp_extract_all(coalesce(description, ''), '- \[[ x]\]')) >= 2 then 'checkbox'
  when len(regexp_extract_all(coalesce(description, ''), '(?i)\b(?:given|when|then)\b')) >= 3 then 'given-when-then'
  when len(regexp_extract_all(coalesce(description, ''), '(?m)^\d+\.\s+')) >= 2 then 'numbered'
  when length(coalesce(description, '')) > 50 then 'prose' else 'none' end as form from cur""")
def t13_criteria_format(spark, d):
    return tickets_now(spark, d, "description").select("issue_key", text.criteria_format(F.col("description")).alias("form"))


@_query("select user_id, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def a02_event_counts(spark, d):
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@_query("select epoch_us(time_bucket(interval '1 hour', ts::timestamp)) as start_us, event_type, count(*) as n from events group by 1, 2")
def g04_windowed_counts(spark, d):
    out = sync.windowed_counts(load(spark, d, "events"), "ts", "10 minutes", "1 hour", "event_type")
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n")
