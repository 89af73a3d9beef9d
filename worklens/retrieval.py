"""Searches, keyed stores and ingest as queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklens.catalogue import _PAGES, _TICKETS, _TOKENS, pages_now, query, tickets_now
from worklens.functions import doctree, text
from worklens.operators import search, similarity, stats
from worklens.reports import _ENTRIES, _POINTS, entries, low
from worklens.sources import ingest, store
from worklens.sources.tables import latest_rows, load

# Searches.

TEXT = "rollout plan"
_HIT = """, w as (select id, unnest(regexp_split_to_array(lower(title) || ' ' || lower(content), '[^0-9a-z]+')) as word from cur),
hit as (select id from w where word in ('rollout', 'plan') group by id having count(distinct word) = 2)
"""


def _pages_index(spark, d) -> DataFrame:
    return search.postings(pages_now(spark, d, "title", "content"), "id", ["title", "content"])


def filtered(hits: DataFrame, rows: DataFrame, source: str | None = None, page_type: str | None = None, space: str | None = None) -> DataFrame:
    """``hits`` of rows that have the given source, type and space; a filter that is None lets all pass."""
    for c, v in (("source", source), ("page_type", page_type), ("space_key", space)):
        rows = rows if v is None else rows.where(F.col(c) == v)
    return hits.join(rows.select("id"), "id", "left_semi")


@query(
    _PAGES
    + _HIT
    + """, f(a, b, c) as (select * from (values (null), ('confluence')) s(x), (values (null), ('design')) t(y), (values (null), ('PLAT')) u(z))
select concat_ws('/', coalesce(a, '*'), coalesce(b, '*'), coalesce(c, '*')) as filters, cur.id from hit join cur using (id), f where (a is null or source = a) and (b is null or page_type = b) and (c is null or space_key = c)"""
)
def f01_filtered_search(spark, d):
    """One search under each of the eight combinations of filters by source, type and space."""
    rows = pages_now(spark, d, "source", "page_type", "space_key")
    hits = search.ranked(pages_now(spark, d, "title", "content"), "id", ["title", "content"], {"q": TEXT}).select("id")
    out = [filtered(hits, rows, a, b, c).select(F.lit(f"{a or '*'}/{b or '*'}/{c or '*'}").alias("filters"), "id") for a in (None, "confluence") for b in (None, "design") for c in (None, "PLAT")]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


_PLAIN = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^0-9a-z]+'), lambda x: x <> '')"


@query(
    _PAGES
    + ", q as (select id as query, array_to_string("
    + _PLAIN.format(c="title")
    + "[:2], ' ') as p from cur where try_cast(id as bigint) % 50 = 0 and len("
    + _PLAIN.format(c="title")
    + ") > 1), b as (select id, ' ' || array_to_string("
    + _PLAIN.format(c="title")
    + ", ' ') || ' | ' || array_to_string("
    + _PLAIN.format(c="content")
    + """, ' ') || ' ' as t from cur) select query, id from q join b on contains(b.t, ' ' || p || ' ')"""
)
def x03_phrases(spark, d):
    """The first two words of each queried title, written as one run (``a_b``): rows in which they follow one another."""
    words = search.words_of(F.col("title"))
    asked = pages_now(spark, d, "title").where("try_cast(id as bigint) % 50 = 0").where(F.size(words) > 1).select(F.col("id").alias("query"), F.array_join(F.slice(words, 1, 2), "_").alias("text"))
    return search.matches(pages_now(spark, d, "title", "content"), "id", ["title", "content"], asked).select("query", F.col("key").alias("id"))


@query(
    """with c as (select id, max_by(page_id, (page_id, content)) as page_id, max_by(content, (page_id, content)) as content from chunks group by id),
w as (select id, unnest(regexp_split_to_array(lower(coalesce(content, '')), '[^0-9a-z]+')) as word from c),
l as (select id, count(*) as len from w where word <> '' group by 1), n as (select (select count(*) from c) as n, (select sum(len) from l) * 1.0 / (select count(*) from c) as avg),
tf as (select id, word, count(*) as tf from w where word in ('rollout', 'plan') group by 1, 2), df as (select word, count(*) as df from tf group by 1),
h as (select id, count(*) as have, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) as score from tf join df using (word) join l using (id), n group by 1),
r as (select id, row_number() over (order by score desc, id) as rank from h where have = 2 qualify rank <= 5),
cur as (select * from (select *, row_number() over (partition by id order by indexed_at desc) as rn from pages) where rn = 1)
select r.rank, r.id, cur.id as page_id, cur.title from r join c using (id) join cur on cur.id = c.page_id"""
)
def k01_best_chunks(spark, d):
    """The five best chunks of a search (K01) with their pages (J02)."""
    chunks = load(spark, d, "chunks").groupBy("id").agg(F.max(F.struct("page_id", "content")).alias("c")).select("id", "c.*")
    hits = search.ranked(chunks, "id", ["content"], {"q": TEXT}, 5).join(chunks.select("id", "page_id"), "id")
    return hits.join(pages_now(spark, d, "title").withColumnRenamed("id", "page_id"), "page_id").select("rank", "id", "page_id", "title")


_WORDS_OF = "list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({c}, '[*\"()^+-]', ' ', 'g'), '\\b(?:near|and|or|not)\\b', ' ', 'gi')), '[^0-9a-z]+'), lambda x: x <> ''))"


@query(
    _PAGES
    + ", q0 as (select id as query, "
    + _WORDS_OF.format(c="coalesce(title, '')")
    + """ as ws from cur where try_cast(id as bigint) % 50 = 0), q as (select query, len(ws) as need, unnest(ws) as word from q0),
c as (select distinct id, unnest(regexp_split_to_array(lower(heading || ' ' || breadcrumb || ' ' || content), '[^0-9a-z]+')) as word from (select id, coalesce(max(heading), '') as heading, coalesce(max(breadcrumb), '') as breadcrumb, coalesce(max(content), '') as content from chunks group by id)),
p as (select distinct id, unnest(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(content, '')), '[^0-9a-z]+')) as word from cur),
ch as (select query, id::varchar as key from q join c using (word) group by query, id having count(*) = max(need)), ph as (select query, id as key from q join p using (word) group by query, id having count(*) = max(need))
select query, 'chunk' as tier, key from ch union all select query, 'page', key from ph where query not in (select query from ch)"""
)
def x07_two_tiers(spark, d):
    """Each queried title among chunks, and among pages where no chunk has all its words."""
    asked = pages_now(spark, d, "title").where("try_cast(id as bigint) % 50 = 0").select(F.col("id").alias("query"), F.col("title").alias("text"))
    chunks = load(spark, d, "chunks").groupBy("id").agg(*[F.max(c).alias(c) for c in ("heading", "breadcrumb", "content")])
    in_chunks = search.ranked(chunks, "id", ["heading", "breadcrumb", "content"], asked).withColumnRenamed("id", "key")
    in_pages = search.ranked(pages_now(spark, d, "title", "content"), "id", ["title", "content"], asked).withColumnRenamed("id", "key")
    return search.two_tier(in_chunks, in_pages).select("query", "tier", "key")


@query()
def x08_context(spark, d):
    """Passages for each ticket whose number is divisible by 50: by keywords, by two keywords that follow one another, by its first words."""
    chunks, place = load(spark, d, "chunks"), ["page_id", "breadcrumb", "heading"]
    titles = pages_now(spark, d, "title").select(F.col("id").alias("page_id"), F.col("title").alias("page_title"))
    # Joined before the repeats of a chunk are reduced, so that the texts are partitioned by chunk when they are searched.
    known = chunks.join(titles.select("page_id", F.lit(True).alias("titled")), "page_id", "left")
    rows = known.groupBy("id").agg(F.max(F.struct(*place, "content", "titled")).alias("c")).where("c.titled").select("id", "c.*")
    places = chunks.groupBy("id").agg(F.max(F.struct(*place)).alias("c")).select(F.col("id").alias("key"), "c.*").join(titles, "page_id")
    asked = tickets_now(spark, d, "summary").where(r"try_cast(regexp_extract(issue_key, '-(\\d+)$', 1) as bigint) % 50 = 0").select(F.col("issue_key").alias("query"), F.col("summary").alias("text"))
    return search.context(lambda searches: search.search_rows(rows, "id", ["heading", "breadcrumb", "content"], searches, kind="string"), places, asked)


@query(
    _TICKETS
    + ", s as (select issue_key, "
    + _TOKENS.format(c="summary")
    + """ as t from cur), q as (select issue_key as query, t as q, list_transform(list_sort(list_transform(t, lambda w: struct_pack(l := -length(w), w := w))), lambda x: x.w)[:3] as k from s where try_cast(regexp_extract(issue_key, '-(\\d+)$', 1) as bigint) % 50 = 0),
m as (select query, issue_key, len(list_intersect(t, q)) * 1.0 / (len(t) + len(q) - len(list_intersect(t, q))) as s from s, q where len(k) > 0 and list_has_all(t, k)),
r as (select query, issue_key, round(s, 6) as similarity, row_number() over (partition by query order by round(s, 6) desc, issue_key) as rank from m where s >= 0.3)
select query, issue_key, similarity, rank from r where rank <= 20"""
)
def e09_duplicate_candidates(spark, d):
    """For each ticket whose number is divisible by 50 the 20 most similar among those that hold its three longest keywords."""
    sets = tickets_now(spark, d, "summary").select("issue_key", text.tokens(F.col("summary")).alias("t"))
    asked = sets.where(r"try_cast(regexp_extract(issue_key, '-(\\d+)$', 1) as bigint) % 50 = 0").select(F.col("issue_key").alias("query"), F.col("t").alias("tokens"))
    return similarity.best_by_keywords(sets, "issue_key", "t", asked, 0.3, 3, 20)


@query(
    _PAGES
    + """, c as (select id as cid, max_by(page_id, (page_id, breadcrumb, heading, content)) as page_id, max_by(breadcrumb, (page_id, breadcrumb, heading, content)) as b, max_by(heading, (page_id, breadcrumb, heading, content)) as h, max_by(content, (page_id, breadcrumb, heading, content)) as content from chunks group by id),
w as (select distinct cid, unnest(regexp_split_to_array(lower(coalesce(content, '')), '[^0-9a-z]+')) as word from c),
hit as (select o, cid from w join (values (1, 'rollout'), (2, 'cache'), (3, 'runbook')) q(o, word) using (word)),
r as (select o, cid, title, coalesce(nullif(b, ''), h, '') as location, row_number() over (partition by title, coalesce(nullif(b, ''), h, '') order by o, cid) as n from hit join c using (cid) join cur on cur.id = c.page_id)
select o as no, cid as id, title, location from r where n = 1"""
)
def u03_first_seen(spark, d):
    """Hits of three searches one after the other, of those with one page title and place only the first."""
    chunks = load(spark, d, "chunks").groupBy("id").agg(F.max(F.struct("page_id", "breadcrumb", "heading", "content")).alias("c")).select("id", "c.*")
    words = search.words_of(F.col("content"))
    no = F.filter(F.array(*[F.when(F.array_contains(words, w), i) for i, w in ((1, "rollout"), (2, "cache"), (3, "runbook"))]), lambda x: x.isNotNull())
    hits = chunks.select("id", "page_id", F.coalesce(F.nullif("breadcrumb", F.lit("")), "heading", F.lit("")).alias("location"), F.explode(no).alias("no"))
    titled = hits.join(pages_now(spark, d, "title").select(F.col("id").alias("page_id"), "title"), "page_id")
    return titled.groupBy("title", "location").agg(F.min(F.struct("no", "id")).alias("f")).select("f.no", "f.id", "title", "location")


# Stores.


@query(_PAGES + "select id, title, space_key from cur where id in (select min(id) from cur union all select max(id) from cur)")
def s02_pages_by_id(spark, d):
    """The pages of given ids, here of the least and the greatest."""
    pages = pages_now(spark, d, "title", "space_key")
    ids = pages.agg(F.array(F.min("id"), F.max("id")).alias("ids")).select(F.explode("ids").alias("id")).distinct()
    return store.lookup(pages, ids, ["id"]).select("id", "title", "space_key")


@query(_PAGES + "select id, title, row_number() over (order by title, id) as place from cur where page_type = 'runbook' and space_key = 'PLAT'")
def s03_pages_by_type_and_space(spark, d):
    rows = store.where_given(pages_now(spark, d, "title", "page_type", "space_key"), page_type="runbook", space_key="PLAT")
    return rows.select("id", "title", F.row_number().over(Window.orderBy("title", "id")).alias("place"))  # the pages of one type and space


@query(_PAGES + "select 'type' as filters, id, substr(content, 1, 300) as preview from cur where page_type = 'adr' union all select 'type+space', id, substr(content, 1, 300) from cur where page_type = 'adr' and space_key = 'PLAT' union all select 'source+type', id, substr(content, 1, 300) from cur where page_type = 'adr' and source = 'import'")
def s04_filtered_summaries(spark, d):
    rows = pages_now(spark, d, "page_type", "space_key", "source", "content")
    out = None
    for name, given in (("type", {}), ("type+space", {"space_key": "PLAT"}), ("source+type", {"source": "import"})):
        part = store.where_given(rows, page_type="adr", **given).select(F.lit(name).alias("filters"), "id", F.substring("content", 1, 300).alias("preview"))
        out = part if out is None else out.unionByName(part)
    return out


@query("select page_id, id, row_number() over (partition by page_id order by chunk_index, id) as place from (select distinct page_id, id, chunk_index from chunks)")
def s07_chunks_in_order(spark, d):
    w = Window.partitionBy("page_id").orderBy("chunk_index", "id")
    return load(spark, d, "chunks").select("page_id", "id", "chunk_index").distinct().select("page_id", "id", F.row_number().over(w).alias("place"))


@query("""with x as (select space_key as key, max_by(title, (indexed_at, title)) as value from pages group by 1) select key, value from x""")
def s08_settings(spark, d):
    """Settings by key, the last value set in force: here of each space the title seen last."""
    given = load(spark, d, "pages").select(F.col("space_key").alias("key"), "indexed_at", F.col("title").alias("value"))
    return store.settings(given, "key", "value", "indexed_at")


@query("""with old as (select id, board_id, state, cached_at from sprints where state <> 'future'), new as (select id, board_id, 'closed' as state, cached_at from sprints where state = 'active' union all select id, board_id, state, cached_at from sprints where state = 'future')
select id, board_id, state from new union all select id, board_id, state from old where id not in (select id from new)""")
def s10_upsert_sprints(spark, d):
    """Sprints after a batch in which running ones have ended and coming ones are new."""
    s = load(spark, d, "sprints").select("id", "board_id", "state", "cached_at")
    batch = s.where("state = 'active'").withColumn("state", F.lit("closed")).unionByName(s.where("state = 'future'"))
    return store.upsert(s.where("state <> 'future'"), batch, ["id"]).select("id", "board_id", "state")


@query("select board_id, id, row_number() over (partition by board_id order by start_date desc nulls last, id) as place from sprints where state = 'closed'")
def s10_closed_sprints(spark, d):
    w = Window.partitionBy("board_id").orderBy(F.desc_nulls_last("start_date"), "id")
    return store.where_given(load(spark, d, "sprints"), state="closed").select("board_id", "id", F.row_number().over(w).alias("place"))


_LOGS = "with one as (select * from (select *, row_number() over (partition by id order by cached_at desc) as rn from changelogs) where rn = 1), k as (select max(issue_key) as k from one)\n"


def _logs(spark, d) -> DataFrame:
    return latest_rows(load(spark, d, "changelogs").select("id", "cached_at", "issue_key", "field", "created"), ["id"], ["cached_at"])


@query(_LOGS + "select id, field, created from one where issue_key = (select k from k) and lower(trim(field)) = 'status'")
def s11_changes_of_field(spark, d):
    """The entries of one issue, here the greatest key, and one field."""
    logs = _logs(spark, d)
    return store.lookup(logs, logs.agg(F.max("issue_key").alias("issue_key")), ["issue_key"]).where(low("field") == "status").select("id", "field", "created").orderBy("created", "id")


@query(_LOGS + "select (select count(*) from one where issue_key = (select k from k)) as n_deleted, (select count(*) from one where issue_key <> (select k from k)) as n_left")
def s11_delete_of_issue(spark, d):
    logs = _logs(spark, d)
    gone = logs.agg(F.max("issue_key").alias("issue_key"))
    left = logs.join(F.broadcast(gone), "issue_key", "left_anti").agg(F.count("*").alias("n_left"))
    return store.lookup(logs, gone, ["issue_key"]).agg(F.count("*").alias("n_deleted")).join(F.broadcast(left))  # one row each


_RULES = _POINTS.replace("\n", "") + ", r as (select 'points' as category, 'median' as rule_key, issue_type, median(v)::varchar as rule_value, count(*) as n from p group by issue_type union all select 'points', 'median', null, median(v)::varchar, count(*) from p)\n"


def _rules(spark, d) -> DataFrame:
    p = tickets_now(spark, d, "issue_type", "story_points").where("story_points > 0").select(low("issue_type").alias("issue_type"), "story_points")
    r = p.groupingSets([[F.col("issue_type")], []], F.col("issue_type")).agg(F.median("story_points").cast("string").alias("rule_value"), F.count("*").alias("n"))
    return r.select(F.lit("points").alias("category"), F.lit("median").alias("rule_key"), "issue_type", "rule_value", "n")


@query(_RULES + "select category, rule_key, issue_type, rule_value, n from r where issue_type is distinct from 'spike' union all select 'points', 'median', 'spike', '1.0', 0")
def s12_upsert_rules(spark, d):
    """Rules by category, key and type, the type of rules for all types being null, after a batch for one type."""
    batch = spark.createDataFrame([("points", "median", "spike", "1.0", 0)], "category string, rule_key string, issue_type string, rule_value string, n bigint")
    return store.upsert(_rules(spark, d), batch, ["category", "rule_key", "issue_type"])


@query(_RULES + "select rule_key, issue_type, rule_value, n from r where category = 'points' and (issue_type = 'bug' or issue_type is null)")
def s13_rules_for_type(spark, d):
    """The rules of a category for one type, with those for all types."""
    return store.where_given(_rules(spark, d), category="points").where("issue_type = 'bug' or issue_type is null").select("rule_key", "issue_type", "rule_value", "n")


@query("""select board_id, max_by(id, (cached_at, id)) as id from sprints group by 1""")
def s14_latest_of_log(spark, d):
    """An appended log's latest row of each board."""
    s = load(spark, d, "sprints").select("board_id", "cached_at", "id")
    return latest_rows(store.append(s.where("state = 'closed'"), s.where("state <> 'closed'")), ["board_id"], ["cached_at", "id"]).select("board_id", "id")


@query(_RULES + """select 'points' as category, issue_type as key, '{"median":"' || rule_value || '","n":' || n || '}' as data from r where issue_type is not null""")
def s15_insights(spark, d):
    """Insights as JSON under category and key, replaced as a whole by a later batch (N01)."""
    r = _rules(spark, d).where("issue_type is not null")
    data = F.to_json(F.struct(F.col("rule_value").alias("median"), "n"))
    new = r.select("category", F.col("issue_type").alias("key"), data.alias("data"))
    return store.upsert(new.withColumn("data", F.lit("{}")), new, ["category", "key"])


# Filters over pages.


@query(_PAGES + "select id, (epoch_us(timestamp '2025-01-01') - epoch_us(updated_at)) // 86400000000 as days_ago, row_number() over (order by updated_at, id) as place from cur where updated_at < timestamp '2024-07-01' and page_type = 'design' and space_key = 'PLAT'")
def f02_stale_designs(spark, d):
    """Stale pages of one type and space, the stalest first."""
    rows = store.where_given(pages_now(spark, d, "updated_at", "page_type", "space_key"), page_type="design", space_key="PLAT").where("updated_at < timestamp '2024-07-01'")
    ago = ((F.unix_micros(F.lit("2025-01-01").cast("timestamp")) - F.unix_micros("updated_at")) / 86_400_000_000).cast("bigint")
    return rows.select("id", ago.alias("days_ago"), F.row_number().over(Window.orderBy("updated_at", "id")).alias("place"))  # the pages of one type and space


@query(_PAGES + "select id, epoch_us(indexed_at) as indexed_us from cur where indexed_at > (select quantile_disc(indexed_at, 0.9) from pages) and source = 'confluence' order by indexed_at desc, id")
def f03_changed_since_of_source(spark, d):
    """What has been indexed since a moment, of one source, the latest first (G02)."""
    since = load(spark, d, "pages").agg(F.expr("percentile_disc(0.9) within group (order by unix_micros(indexed_at))").alias("since"))
    rows = store.where_given(pages_now(spark, d, "source"), source="confluence").join(F.broadcast(since)).where(F.unix_micros("indexed_at") > F.col("since"))  # one row
    return rows.select("id", F.unix_micros("indexed_at").alias("indexed_us")).orderBy(F.desc("indexed_us"), "id")


_TAGS = "list_transform(labels::json::varchar[], lambda x: lower(x))"


@query(_PAGES + f"select id from cur where regexp_replace(content, '\\s', '', 'g') <> '' and list_has_any({_TAGS}, ['cdn', 'frontend', 'audit']) and not list_has_any({_TAGS}, ['regression'])")
def f05_to_index(spark, d):
    """Pages with a body, one of some labels and none of others."""
    rows = pages_now(spark, d, "content", "labels")
    return rows.where(ingest.wanted(F.col("content"), F.from_json("labels", "array<string>"), ["cdn", "frontend", "audit"], ["regression"])).select("id")


@query(_PAGES + ", s as (select id, space_key, row_number() over (partition by space_key order by id) as place, length(content) as n from cur qualify place <= 20), u as (select *, sum(n) over (partition by space_key order by place rows unbounded preceding) as upto from s) select space_key, id, place, least(n, 20000 - (upto - n)) as chars from u where upto - n < 19900")
def f14_budgeted_list(spark, d):
    """Of each space the first 20 pages, as far as 20,000 characters go (K08, W10).

    The first 20 are chosen before their texts are gathered, so a space of any size is no task of its own.
    """
    ranked = stats.first_n(pages_now(spark, d, "space_key", "content").select("space_key", "id", F.length("content").alias("n")), ["space_key"], ["id"], 20)
    upto = F.sum("n").over(Window.partitionBy("space_key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("upto", upto).where("upto - n < 19900").select("space_key", "id", "place", F.expr("least(n, 20000 - (upto - n))").alias("chars"))


# Ingest.


@query(_TICKETS + "select issue_key, summary, lower(trim(issue_type)) as issue_type, story_points, list_sort(" + _ENTRIES.format(c="labels") + ") as labels, coalesce(assignee, 'unassigned') as assignee from cur")
def s21_projected_tickets(spark, d):
    """Tickets out of a tracker's nested JSON, which is made of the tickets here."""
    t = tickets_now(spark, d, "summary", "issue_type", "story_points", "labels", "assignee")
    name = lambda c: F.struct(F.col(c).alias("name"))
    raw = t.select(F.to_json(F.struct(F.col("issue_key").alias("key"), F.struct("summary", name("issue_type").alias("issuetype"), F.col("story_points").alias("customfield_2"), "labels", F.when(F.col("assignee").isNotNull(), F.struct(F.col("assignee").alias("displayName"))).alias("assignee")).alias("fields"))).alias("value"))
    out = ingest.tickets_of(raw, points=("customfield_1", "customfield_2"))
    return out.select("issue_key", "summary", low("issue_type").alias("issue_type"), "story_points", F.array_sort(entries("labels")).alias("labels"), F.coalesce("assignee", F.lit("unassigned")).alias("assignee"))


@query(_LOGS + "select issue_key, id, created, field from one where issue_key is not null and id is not null")
def s22_flattened_changes(spark, d):
    """Entries of a tracker's nested logs, which are made of the changelogs here, a row for each item."""
    items = _logs(spark, d).where("issue_key is not null and id is not null").groupBy("issue_key").agg(F.collect_list(F.struct("id", "created", F.array(F.struct("field")).alias("items"))).alias("histories"))
    raw = items.select(F.to_json(F.struct(F.col("issue_key").alias("key"), F.struct("histories").alias("changelog"))).alias("value"))
    return ingest.changes_of(raw).select("issue_key", "id", "created", "field")


@query()
def h09_crawled(spark, d):
    """Pages from their source to chunks: converted, filtered, classified, cleaned and cut; those that have not changed are left as they are."""
    pages = pages_now(spark, d, "title", "space_key", "content", "labels", "updated_at")
    known = pages.where("id % 2 = 0").select("id", "updated_at")
    return ingest.crawled(pages, known)[1]


@query()
def t10_document_trees(spark, d):
    """The contents of pages as trees of nodes, and the text of those (T11)."""
    trees = pages_now(spark, d, "content").select("id", doctree.tree_json("content").alias("tree"))
    return trees.select("id", "tree", doctree.tree_text("tree").alias("text"))


@query(
    _TICKETS
    + r"""select issue_key, len(regexp_extract_all(x, '(?m)^#{1,3}[ \t]+[^\r\n]+')) as headings, len(regexp_extract_all(x, '(?m)^\*\*[^*\n]+?:?\*\*[ \t]*$')) as bold, len(regexp_extract_all(x, '- \[[ xX]\]')) as boxes,
  len(regexp_extract_all(x, '(?i)\b(?:given|when|then)\b')) as steps, len(regexp_extract_all(x, '(?m)^[ \t]*[-*][ \t]+')) as bullets, regexp_matches(coalesce(summary, ''), '^\[[^\]]+\]') as tagged,
  regexp_matches(x, '(?i)acceptance criteria') as criteria, regexp_matches(x, '(?i)\b(?:because|so that|in order to|context|background)\b') as reasons from (select *, coalesce(description, '') as x from cur)"""
)
def t12_features(spark, d):
    """What is found in the description of each ticket."""
    x = F.coalesce("description", F.lit(""))
    return tickets_now(spark, d, "summary", "description").select(
        "issue_key",
        text.count_of(x, r"(?m)^#{1,3}[ \t]+[^\r\n]+").alias("headings"),
        text.count_of(x, r"(?m)^\*\*[^*\n]+?:?\*\*[ \t]*$").alias("bold"),
        text.count_of(x, r"- \[[ xX]\]").alias("boxes"),
        text.count_of(x, r"(?i)\b(?:given|when|then)\b").alias("steps"),
        text.count_of(x, r"(?m)^[ \t]*[-*][ \t]+").alias("bullets"),
        F.coalesce("summary", F.lit("")).rlike(r"^\[[^\]]+\]").alias("tagged"),
        x.rlike("(?i)acceptance criteria").alias("criteria"),
        x.rlike(r"(?i)\b(?:because|so that|in order to|context|background)\b").alias("reasons"),
    )


@query(
    _TICKETS
    + ", b as (select issue_key, summary from cur where lower(trim(status)) = 'to do' order by created, issue_key limit 50), s as (select issue_key, "
    + _TOKENS.format(c="summary")
    + """ as t from b)
select x.issue_key, coalesce(list_sort(list(y.issue_key) filter (y.issue_key is not null)), []) as duplicates from s x left join s y on x.issue_key <> y.issue_key and len(list_intersect(x.t, y.t)) * 1.0 / greatest(1, len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) > 0.4 group by 1"""
)
def h01_backlog(spark, d):
    """The first 50 tickets to be done, each with those of them that are similar."""
    first = tickets_now(spark, d, "summary", "status", "created").where(low("status") == "to do").orderBy("created", "issue_key").limit(50)
    pairs = similarity.similar_pairs(first.select("issue_key", text.tokens(F.col("summary")).alias("t")), "issue_key", "t", 0.4, strict=True)
    both = pairs.select(F.col("key_a").alias("issue_key"), F.col("key_b").alias("other")).union(pairs.select("key_b", "key_a"))
    near = both.groupBy("issue_key").agg(F.array_sort(F.collect_list("other")).alias("duplicates"))
    return first.select("issue_key").join(near, "issue_key", "left").select("issue_key", F.coalesce("duplicates", F.array().cast("array<string>")).alias("duplicates"))


@query(_TICKETS + ", l as (select distinct upper(trim(issue_key)) as k from changelogs where issue_key is not null) select issue_key, status from cur where upper(trim(issue_key)) not in (select k from l)")
def h13_without_activity(spark, d):
    """Tickets of which no change is known."""
    seen = load(spark, d, "changelogs").select(F.upper(F.trim("issue_key")).alias("k")).distinct()
    t = tickets_now(spark, d, "status")
    return t.join(seen, F.upper(F.trim("issue_key")) == F.col("k"), "left_anti").select("issue_key", "status")
