"""Reports over tickets, sprints and pages, each a query with its SQL; they are put together from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklens.catalogue import _BUSINESS, _PAGES, _SPRINTS, _STATUS, _TICKETS, _status, _velocity, pages_now, query, tickets_now
from worklens.functions import dates, text
from worklens.operators import stats, timeline
from worklens.sources.tables import blank_to_null, load

DONE, BUSY = ("done", "closed", "resolved"), "in progress"  # parameters of the reports, not of the operators


def low(c: str) -> Column:
    return F.lower(F.trim(c))


def entries(c: str) -> Column:
    """The distinct entries of a list in one spelling, without blanks."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


_ENTRIES = "list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: lower(trim(x))), lambda x: x <> ''))"

# Sprints.


@query(
    _SPRINTS
    + """, b as (select sprint_id, count(*) filter (lower(trim(issue_type)) = 'bug') as bugs from one group by 1)
select sprint_id, v.issues, bugs, case when v.issues = 0 then 0 else floor(100.0 * bugs / v.issues + 0.5) end::int as bug_percent,
  case when committed > 0 then floor(100.0 * completed / committed + 0.5) else 0 end::int as completion_percent, committed - completed as carried from v join b using (sprint_id)"""
)
def a13_velocity_metrics(spark, d):
    """Completion by points, bugs and carry-over of each sprint."""
    one = load(spark, d, "sprint_issues").distinct()
    bugs = one.groupBy("sprint_id").agg(F.count_if(low("issue_type") == "bug").alias("bugs"))
    v = _velocity(spark, d).join(bugs, "sprint_id")
    done = F.when(F.col("committed") > 0, stats.percent(F.col("completed"), F.col("committed"))).otherwise(0)
    return v.select("sprint_id", "issues", "bugs", stats.percent(F.col("bugs"), F.col("issues")).alias("bug_percent"), done.alias("completion_percent"), (F.col("committed") - F.col("completed")).alias("carried"))


_CLOSED = """, last as (select board_id, id, start_date, row_number() over (partition by board_id order by start_date desc nulls last, id desc) as place from sprints where state = 'closed' qualify place <= 5)
"""


def last_sprints(spark, d, n: int = 5) -> DataFrame:
    """The ``n`` most recent closed sprints of each board, by their start; ties by id."""
    w = Window.partitionBy("board_id").orderBy(F.desc_nulls_last("start_date"), F.desc("id"))
    return load(spark, d, "sprints").where("state = 'closed'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


@query(
    _SPRINTS
    + _CLOSED
    + """, x as (select board_id, id, place, coalesce(committed, 0) as committed, coalesce(completed, 0) as completed, row_number() over (partition by board_id order by start_date, id) - 1 as i from last left join v on v.sprint_id = last.id)
select board_id, count(*) as n, round(avg(completed), 6) as mean, sum(committed - completed) as carried, round(case when count(*) <= 1 then 0 else regr_slope(completed, i) end, 6) as slope,
  max(completed) filter (place = 1) as latest from x group by 1"""
)
def h15_velocity_report(spark, d):
    """Of each board's last five closed sprints: mean points, carry-over, trend and the latest. A sprint without issues counts with 0 points."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    x = last_sprints(spark, d).join(_velocity(spark, d), F.col("id") == F.col("sprint_id"), "left").select("board_id", "id", "place", "start_date", zero("committed"), zero("completed"))
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("board_id").orderBy("start_date", "id")) - 1)
    mean = x.groupBy("board_id").agg(F.round(F.avg("completed"), 6).alias("mean"), F.sum(F.col("committed") - F.col("completed")).alias("carried"), F.max(F.when(F.col("place") == 1, F.col("completed"))).alias("latest"))
    return stats.trend(x, ["board_id"], "i", "completed").drop("intercept").join(mean, "board_id")


@query("with w" + _CLOSED.replace(", last", "", 1).replace(" as (", " as (", 1) + "select board_id, id, place from w")
def k04_last_sprints(spark, d):
    return last_sprints(spark, d).select("board_id", "id", "place")


@query(
    _SPRINTS
    + _CLOSED
    + """, m as (select board_id, avg(coalesce(completed, 0)) as mean from last left join v on v.sprint_id = last.id group by 1)
select s.id as sprint_id, coalesce(committed, 0) as points, round(case when m.mean = 0 then 'inf'::double else coalesce(committed, 0) / m.mean end, 6) as ratio from sprints s join m using (board_id) left join v on v.sprint_id = s.id where s.state in ('active', 'future')"""
)
def a10_capacity_ratio(spark, d):
    """The points of running and coming sprints as a share of the board's mean velocity; infinite if that is 0."""
    done = last_sprints(spark, d).join(_velocity(spark, d), F.col("id") == F.col("sprint_id"), "left").groupBy("board_id").agg(F.avg(F.coalesce("completed", F.lit(0))).alias("mean"))
    open_ = load(spark, d, "sprints").where("state in ('active', 'future')").select("id", "board_id").join(done, "board_id").join(_velocity(spark, d).withColumnRenamed("sprint_id", "id"), "id", "left")
    points = F.coalesce("committed", F.lit(0))
    return open_.select(F.col("id").alias("sprint_id"), points.alias("points"), F.round(F.when(F.col("mean") == 0, float("inf")).otherwise(F.try_divide(points, F.col("mean"))), 6).alias("ratio"))


@query("""select 0 as part, id from sprints where state = 'active' union all select 1, id from sprints where state = 'future'""")
def u02_open_sprints(spark, d):
    """Running sprints, then coming ones."""
    s = load(spark, d, "sprints")
    return s.where("state = 'active'").select(F.lit(0).alias("part"), "id").unionByName(s.where("state = 'future'").select(F.lit(1).alias("part"), "id"))


@query(
    """with one as (select distinct * from sprint_issues)
select sprint_id, coalesce(issue_type, 'none') as issue_type, count(*) as n, floor(100.0 * count(*) / sum(count(*)) over (partition by sprint_id) + 0.5)::int as percent, round(avg(story_points) filter (story_points > 0), 6) as mean_points
from one group by 1, 2"""
)
def a25_sprint_composition(spark, d):
    """The mix of types of each sprint and the mean of the points that are given."""
    n = load(spark, d, "sprint_issues").distinct().groupBy("sprint_id", F.coalesce("issue_type", F.lit("none")).alias("issue_type"))
    n = n.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("story_points") > 0, F.col("story_points"))), 6).alias("mean_points"))
    return n.withColumn("percent", stats.percent(F.col("n"), F.sum("n").over(Window.partitionBy("sprint_id"))))


@query(
    """with one as (select distinct * from sprint_issues)
select sprint_id, status, coalesce(assignee, 'unassigned') as assignee, count(*) as n, sum(coalesce(story_points, 0)) as points, list_sort(list(issue_key)) as issues from one group by 1, 2, 3"""
)
def a33_sprint_detail(spark, d):
    """The issues of each sprint by status and assignee. A sprint's issues are bounded by what a team can plan."""
    one = load(spark, d, "sprint_issues").distinct().groupBy("sprint_id", "status", F.coalesce("assignee", F.lit("unassigned")).alias("assignee"))
    return one.agg(F.count("*").alias("n"), F.sum(F.coalesce("story_points", F.lit(0))).alias("points"), F.array_sort(F.collect_list("issue_key")).alias("issues"))


@query(
    """with one as (select distinct * from sprint_issues)
select sprint_id, count(*) as n, count(*) filter (lower(status_category) = 'done') as done, coalesce(sum(story_points) filter (lower(status_category) = 'done'), 0) as done_points, coalesce(sum(story_points), 0) as points,
  floor(100.0 * count(*) filter (lower(status_category) = 'done') / count(*) + 0.5)::int as percent, coalesce(list_sort(list(issue_key) filter (status_category is null or lower(status_category) <> 'done')), []) as remaining from one group by 1"""
)
def a16_group_progress(spark, d):
    """How far the issues of a group (here a sprint) are, by count and points, and which remain."""
    done = F.coalesce(F.lower("status_category") == "done", F.lit(False))
    points = F.coalesce("story_points", F.lit(0))
    out = load(spark, d, "sprint_issues").distinct().groupBy("sprint_id").agg(
        F.count("*").alias("n"), F.count_if(done).alias("done"), F.sum(F.when(done, points).otherwise(0)).alias("done_points"), F.sum(points).alias("points"), F.array_sort(F.collect_list(F.when(~done, F.col("issue_key")))).alias("remaining")
    )
    return out.withColumn("percent", stats.percent(F.col("done"), F.col("n")))


@query(
    _TICKETS
    + """, one as (select distinct sprint_id, issue_key from sprint_issues)
select o.sprint_id, count(*) as n, count(*) filter (c.created > s.start_date) as added, floor(100.0 * count(*) filter (c.created > s.start_date) / count(*) + 0.5)::int as percent
from one o join sprints s on s.id = o.sprint_id left join cur c using (issue_key) where s.start_date is not null group by 1"""
)
def f08_scope_creep(spark, d):
    """The issues of each sprint that were made after it had begun. An unknown issue counts among all, not among those added."""
    s = load(spark, d, "sprints").where("start_date is not null").select(F.col("id").alias("sprint_id"), "start_date")
    x = load(spark, d, "sprint_issues").select("sprint_id", "issue_key").distinct().join(F.broadcast(s), "sprint_id").join(tickets_now(spark, d, "created"), "issue_key", "left")  # one row a sprint
    n = x.groupBy("sprint_id").agg(F.count("*").alias("n"), F.count_if(F.col("created") > F.col("start_date")).alias("added"))
    return n.withColumn("percent", stats.percent(F.col("added"), F.col("n")))


@query("""select id, case when end_date is not null then greatest(0, ceil((epoch_us(end_date) - epoch_us(timestamp '2024-06-03 12:00:00')) / 86400000000.0)) end::bigint as days_left,
  case when end_date > start_date then greatest(0, least(100, floor(100.0 * (epoch_us(timestamp '2024-06-03 12:00:00') - epoch_us(start_date)) / nullif(epoch_us(end_date) - epoch_us(start_date), 0) + 0.5))) end::int as elapsed, strftime(start_date::timestamp, '%Y-%m-%d') as starts from sprints""")
def d03_sprint_clock(spark, d):
    """Days left and share elapsed of each sprint at a given moment, and the day on which it starts."""
    now = F.lit("2024-06-03 12:00:00").cast("timestamp")
    left, part = dates.days_left(F.col("end_date"), now), dates.elapsed_percent(F.col("start_date"), F.col("end_date"), now)
    return load(spark, d, "sprints").select("id", left.alias("days_left"), part.alias("elapsed"), F.date_format("start_date", "yyyy-MM-dd").alias("starts"))


# Tickets.

_POINTS = _TICKETS + ", p as (select lower(trim(issue_type)) as issue_type, story_points as v from cur where story_points > 0), h as (select issue_type, v, count(*) as n from p group by all)\n"


@query(_POINTS + "select issue_type, list(v || ': ' || n || ' (' || floor(100.0 * n / total + 0.5)::int || ' %)' order by v) as histogram, round(greatest(0, 1 - sd / mean) * least(1, total / 30.0), 6) as confidence from (select h.*, sum(n) over (partition by issue_type) as total, (select stddev_pop(v) from p where p.issue_type = h.issue_type) as sd, (select avg(v) from p where p.issue_type = h.issue_type) as mean from h) group by issue_type, total, sd, mean")
def a21_points_histogram(spark, d):
    """How often each number of points is given in each type, in order, and how far that can be relied on."""
    p = tickets_now(spark, d, "issue_type", "story_points").where("story_points > 0").select(low("issue_type").alias("issue_type"), "story_points")
    n = p.groupBy("issue_type", "story_points").agg(F.count("*").alias("n"))
    whole = p.groupBy("issue_type").agg(F.count("*").alias("total"), F.stddev_pop("story_points").alias("sd"), F.avg("story_points").alias("mean"))
    row = F.struct("story_points", F.concat("story_points", F.lit(": "), "n", F.lit(" ("), stats.percent(F.col("n"), F.col("total")), F.lit(" %)")).alias("line"))
    sure = F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean")) * F.least(F.lit(1.0), F.col("total") / 30.0)
    return n.join(whole, "issue_type").groupBy("issue_type").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]).alias("histogram"), F.round(F.first(sure), 6).alias("confidence"))


def _usage(spark, d, c: str) -> DataFrame:
    t = tickets_now(spark, d, c).select(entries(c).alias("e"))
    return t.agg(F.count("*").alias("tickets"), stats.percent(F.count_if(F.size("e") > 0), F.count("*")).alias("used_percent"), F.round(F.avg(F.size("e")), 6).alias("mean_entries"))


_USAGE = _TICKETS + "select count(*) as tickets, floor(100.0 * count(*) filter (len(e) > 0) / count(*) + 0.5)::int as used_percent, round(avg(len(e)), 6) as mean_entries from (select " + _ENTRIES + " as e from cur)"


@query(_USAGE.format(c="labels"))
def a22_label_usage(spark, d):
    return _usage(spark, d, "labels")


@query(_USAGE.format(c="components"))
def a23_component_usage(spark, d):
    return _usage(spark, d, "components")


_SHARE = _TICKETS + ", x as (select issue_key, unnest(" + _ENTRIES + ") as item from cur) select item, count(*) as n, floor(100.0 * count(*) / (select count(*) from cur) + 0.5)::int as percent from x group by 1"


def _share(spark, d, c: str) -> DataFrame:
    t = tickets_now(spark, d, c).select(entries(c).alias("e"))
    n = t.select(F.explode("e").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(t.agg(F.count("*").alias("all")))).select("item", "n", stats.percent(F.col("n"), F.col("all")).alias("percent"))  # one row


@query(_SHARE.format(c="labels"))
def a22_label_shares(spark, d):
    """The share of tickets that hold each label."""
    return _share(spark, d, "labels")


@query(_SHARE.format(c="components"))
def a23_component_shares(spark, d):
    return _share(spark, d, "components")


_DAYS = _TICKETS + f", b as (select lower(trim(issue_type)) as issue_type, story_points, {_BUSINESS}::int as days from cur where resolution_date is not null and created is not null)\n"


@query(
    _DAYS
    + """, g as (select issue_type, count(*) as n, median(days) as median_days, count(*) filter (story_points > 0) as pointed, median(days) filter (story_points > 0) as d, median(story_points) filter (story_points > 0) as p,
  avg(days / story_points) filter (story_points > 0) as mean, stddev_pop(days / story_points) filter (story_points > 0) as sd from b group by 1 having count(*) >= 3)
select issue_type, n, median_days, case when pointed < 2 then 0 else floor(d / p * 100 + 0.5) / 100 end as days_per_point, case when pointed < 2 or mean = 0 then 0 else floor(greatest(0, least(1, 1 - sd / mean)) * 100 + 0.5) / 100 end as accuracy from g"""
)
def a26_estimation(spark, d):
    """Business days and days per point of each type with three resolved tickets or more, and how even those are."""
    t = tickets_now(spark, d, "issue_type", "story_points", "created", "resolution_date").select(low("issue_type").alias("issue_type"), "story_points", dates.business_days(F.col("created"), F.col("resolution_date")).alias("days")).where("days is not null")
    given = F.when(F.col("story_points") > 0, F.col("story_points"))
    ratio = F.col("days") / given
    g = t.groupBy("issue_type").agg(
        F.count("*").alias("n"), F.median("days").alias("median_days"), F.count(given).alias("pointed"), F.median(F.when(given.isNotNull(), F.col("days"))).alias("dm"), F.median(given).alias("pm"), F.avg(ratio).alias("mean"), F.stddev_pop(ratio).alias("sd")
    ).where("n >= 3")
    per = F.when(F.col("pointed") < 2, 0.0).otherwise(stats.two_places(F.col("dm") / F.col("pm")))
    even = F.when((F.col("pointed") < 2) | (F.col("mean") == 0), 0.0).otherwise(stats.two_places(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(F.col("sd"), F.col("mean"))))))
    return g.select("issue_type", "n", "median_days", per.alias("days_per_point"), even.alias("accuracy"))


def _by_component(df: DataFrame) -> DataFrame:
    """A row for each component of a ticket; one of "unassigned" for a ticket without."""
    e = entries("components")
    return df.withColumn("component", F.explode(F.when(F.size(e) == 0, F.array(F.lit("unassigned"))).otherwise(e)))


_COMPONENT = "unnest(case when len(" + _ENTRIES.format(c="components") + ") = 0 then ['unassigned'] else " + _ENTRIES.format(c="components") + " end) as component"


@query(
    _TICKETS
    + f""", x as (select {_COMPONENT}, assignee, {_BUSINESS}::int as days, resolution_date is not null and created is not null as known from cur where assignee is not null),
n as (select component, assignee, count(*) as n, round(avg(days) filter (known), 6) as mean_days from x group by 1, 2),
r as (select *, sum(n) over (partition by component) as total, row_number() over (partition by component order by n desc, assignee) as place from n)
select component, assignee, n, mean_days, round(n * 1.0 / total, 6) as share, place from r where total >= 3 and place <= 5"""
)
def a27_ownership(spark, d):
    """The five assignees with most tickets of each component that has three or more, with their mean business days."""
    x = _by_component(tickets_now(spark, d, "assignee", "components", "created", "resolution_date").where("assignee is not null"))
    n = x.groupBy("component", "assignee").agg(F.count("*").alias("n"), F.round(F.avg(dates.business_days(F.col("created"), F.col("resolution_date"))), 6).alias("mean_days"))
    w = Window.partitionBy("component")
    n = n.withColumn("total", F.sum("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "assignee")))
    return n.where("total >= 3 and place <= 5").select("component", "assignee", "n", "mean_days", F.round(F.col("n") / F.col("total"), 6).alias("share"), "place")


_LABEL_PAIRS = _TICKETS + """, x as (select issue_key, unnest(""" + _ENTRIES.format(c="labels") + """) as l from cur), f as (select l, count(*) as n from x group by 1),
pair as (select a.l as label_a, b.l as label_b, count(*) as n from x a join x b on a.issue_key = b.issue_key and a.l < b.l group by 1, 2 having count(*) >= 3),
rated as (select label_a, label_b, pair.n, round(pair.n * 1.0 / least(fa.n, fb.n), 6) as rate from pair join f fa on fa.l = label_a join f fb on fb.l = label_b)
"""


def label_pairs(spark, d, least: int = 3) -> DataFrame:
    """(label_a, label_b, n, rate): labels that stand together on ``least`` tickets or more; the rate is by the rarer one."""
    t = tickets_now(spark, d, "labels").select(F.array_sort(entries("labels")).alias("e"))
    n = t.select(F.explode("e").alias("l")).groupBy("l").agg(F.count("*").alias("f"))
    each = t.select("e", F.posexplode("e").alias("i", "label_a")).where("i + 1 < size(e)")
    pairs = each.select("label_a", F.explode(F.expr("slice(e, i + 2, size(e))")).alias("label_b")).groupBy("label_a", "label_b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out = pairs.join(n.toDF("label_a", "fa"), "label_a").join(n.toDF("label_b", "fb"), "label_b")
    return out.select("label_a", "label_b", "n", F.round(F.col("n") / F.least("fa", "fb"), 6).alias("rate"))


@query(_LABEL_PAIRS + "select label_a, label_b, n, rate, row_number() over (order by round(rate, 2) desc, n desc, label_a, label_b) as place from rated where rate > 0.3 qualify place <= 20")
def a29_label_pairs(spark, d):
    """The twenty pairs of labels that most often stand together, among those above a rate of 0.3."""
    order = [F.desc(F.round("rate", 2)), F.desc("n"), F.asc("label_a"), F.asc("label_b")]
    top = label_pairs(spark, d).where("rate > 0.3").orderBy(*order).limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # twenty rows


@query(
    _LABEL_PAIRS
    + """, t as (select issue_key, """
    + _ENTRIES.format(c="labels")
    + """ as e from cur), o as (select label_a as l, label_b as other, n, rate from rated where rate >= 0.5 and n >= 5 union all select label_b, label_a, n, rate from rated where rate >= 0.5 and n >= 5)
select issue_key, other as label, max(rate) as rate from (select issue_key, e, unnest(e) as l from t) join o using (l) where not list_contains(e, other) group by 1, 2"""
)
def j09_label_expansion(spark, d):
    """Labels that tickets do not hold although they nearly always stand together with one they hold."""
    strong = label_pairs(spark, d).where("rate >= 0.5 and n >= 5")
    each = strong.select(F.col("label_a").alias("l"), F.col("label_b").alias("label"), "rate").unionByName(strong.select(F.col("label_b").alias("l"), F.col("label_a").alias("label"), "rate"))
    t = tickets_now(spark, d, "labels").select("issue_key", entries("labels").alias("e"))
    return t.select("issue_key", "e", F.explode("e").alias("l")).join(each, "l").where(~F.array_contains("e", F.col("label"))).groupBy("issue_key", "label").agg(F.max("rate").alias("rate"))


@query(
    _STATUS
    + f""", cur as (select * from (select *, row_number() over (partition by issue_key order by updated desc) as rn from tickets) where rn = 1),
m as (select issue_key, t in ('done', 'closed', 'resolved') as term, moment, id from st),
b as (select issue_key, not term and coalesce(max(term::int) over (partition by issue_key order by moment, id rows between unbounded preceding and 1 preceding), 0) = 1 as back from m),
r as (select issue_key, bool_or(back) as returned from b group by 1),
x as (select upper(trim(issue_key)) as issue_key, {_COMPONENT} from cur)
select component, count(*) as n, count(*) filter (returned) as reopened, round(count(*) filter (returned) * 1.0 / count(*), 6) as rate from x join r using (issue_key) group by 1 having count(*) >= 5"""
)
def a30_rework(spark, d):
    """The share of tickets that left a terminal status again, of each component with five tickets with a history or more."""
    back = timeline.returned(_status(spark, d), "issue_key", "at", "id", "to_value", F.col("to_value").isin(*DONE))
    x = _by_component(tickets_now(spark, d, "components").withColumn("issue_key", F.upper(F.trim("issue_key")))).join(back, "issue_key")
    n = x.groupBy("component").agg(F.count("*").alias("n"), F.count_if("returned").alias("reopened")).where("n >= 5")
    return n.withColumn("rate", F.round(F.col("reopened") / F.col("n"), 6))


_ITEMS = r"""len(regexp_extract_all(coalesce(description, ''), '(?m)^\s*(?:[-*]\s+(?:\[[ xX]\]\s*)?|\d+\.\s+)\S'))"""


@query(
    _TICKETS
    + r""", x as (select lower(trim(issue_type)) as issue_type, issue_key, case when len(regexp_extract_all(coalesce(description, ''), '- \[[ x]\]')) >= 2 then 'checkbox'
  when len(regexp_extract_all(coalesce(description, ''), '(?i)\b(?:given|when|then)\b')) >= 3 then 'given-when-then'
  when len(regexp_extract_all(coalesce(description, ''), '(?m)^\d+\.\s+')) >= 2 then 'numbered'
  when length(coalesce(description, '')) > 50 then 'prose' else 'none' end as form, """
    + _ITEMS
    + r""" as items, list_distinct(list_transform(list_concat(regexp_extract_all(coalesce(description, ''), '(?m)^#{1,3}[ \t]+([^\r\n]+)', 1), regexp_extract_all(coalesce(description, ''), '(?m)^\*\*([^*\n]+?):?\*\*[ \t]*$', 1)), lambda y: lower(trim(y)))) as hs from cur),
n as (select issue_type, count(*) as n, round(avg(items) filter (items > 0), 6) as mean_items from x group by 1 having count(*) >= 5),
f as (select issue_type, form, row_number() over (partition by issue_type order by count(*) desc, form) as r from x group by 1, 2),
h as (select issue_type, heading from (select issue_type, unnest(hs) as heading from x) join n using (issue_type) group by issue_type, heading, n having count(*) > 0.3 * n)
select n.issue_type, n, mean_items, form, coalesce((select list_sort(list(heading)) from h where h.issue_type = n.issue_type), []) as headings from n join f on f.issue_type = n.issue_type and r = 1"""
)
def a31_templates(spark, d):
    """How the descriptions of each type with five tickets or more are made: usual headings, form of criteria, number of items."""
    body = F.coalesce("description", F.lit(""))
    heads = F.array_distinct(F.transform(text.headings(body), lambda h: F.lower(F.trim(h))))
    x = tickets_now(spark, d, "issue_type", "description").select(low("issue_type").alias("issue_type"), text.criteria_format(body).alias("form"), text.list_items(body).alias("items"), heads.alias("hs"))
    n = x.groupBy("issue_type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("items") > 0, F.col("items"))), 6).alias("mean_items")).where("n >= 5")
    form = stats.top_n(x, ["issue_type"], "form", 1).select("issue_type", "form")
    usual = x.select("issue_type", F.explode("hs").alias("heading")).groupBy("issue_type", "heading").agg(F.count("*").alias("k")).join(n.select("issue_type", "n"), "issue_type").where("k > 0.3 * n")
    usual = usual.groupBy("issue_type").agg(F.array_sort(F.collect_list("heading")).alias("headings"))
    return n.join(form, "issue_type").join(usual, "issue_type", "left").withColumn("headings", F.coalesce("headings", F.array().cast("array<string>")))


# Timelines.

_BORN = """, cur as (select * from (select *, row_number() over (partition by issue_key order by updated desc) as rn from tickets) where rn = 1),
born as (select upper(regexp_replace(issue_key, '^\\s+|\\s+$', '', 'g')) as issue_key, min(created) as born, max(resolution_date) as resolved, max(lower(trim(issue_type))) as issue_type from cur group by 1)
"""


def _born(spark, d) -> DataFrame:
    t = tickets_now(spark, d, "created", "resolution_date", "issue_type")
    return t.groupBy(F.upper(blank_to_null(F.col("issue_key"))).alias("issue_key")).agg(F.min("created").alias("born"), F.max("resolution_date").alias("resolved"), F.max(low("issue_type")).alias("issue_type"))


_CYCLE = (
    _STATUS
    + _BORN
    + """, e as (select issue_key, min_by(moment, (moment, id)) filter (t = 'in progress') as a, max_by(moment, (moment, id)) filter (t in ('done', 'closed', 'resolved')) as z from st group by 1),
k as (select issue_key, issue_type, (epoch_us(z) - epoch_us(born)) / 3600000000.0 as lead, (epoch_us(z) - epoch_us(coalesce(a, born))) / 3600000000.0 as cycle from e join born using (issue_key) where z is not null)
"""
)


def cycle_times(spark, d) -> DataFrame:
    """(issue_key, issue_type, lead, cycle) in hours: from the creation, or the first entry into progress, to the last end. Without one into progress the lead."""
    first = F.min_by("at", F.struct("at", "id"))
    e = _status(spark, d).groupBy("issue_key").agg(
        F.min_by("at", F.when(F.col("to_value") == BUSY, F.struct("at", "id"))).alias("a"), F.max_by("at", F.when(F.col("to_value").isin(*DONE), F.struct("at", "id"))).alias("z"), first.alias("f"), F.count_if(F.col("to_value").isin(*DONE)).alias("n"), F.count_if(F.col("to_value") == BUSY).alias("m")
    )
    e = e.where("n > 0").withColumn("a", F.when(F.col("m") > 0, F.col("a"))).join(_born(spark, d), "issue_key")
    return e.select("issue_key", "issue_type", dates.hours_between(F.col("born"), F.col("z")).alias("lead"), dates.hours_between(F.coalesce("a", "born"), F.col("z")).alias("cycle"))


@query(_CYCLE + "select issue_key, issue_type, round(lead, 4) as lead, round(cycle, 4) as cycle from k")
def w05_cycle_and_lead(spark, d):
    return cycle_times(spark, d).select("issue_key", "issue_type", F.round("lead", 4).alias("lead"), F.round("cycle", 4).alias("cycle"))


@query(_CYCLE + "select coalesce(issue_type, 'all') as issue_type, count(*) as n, round(quantile_disc(cycle, 0.5), 4) as p50, round(quantile_disc(cycle, 0.75), 4) as p75, round(quantile_disc(cycle, 0.9), 4) as p90, round(avg(cycle), 4) as mean from k group by grouping sets ((issue_type), ())")
def a09_cycle_report(spark, d):
    """Cycle times of all issues and of each type, in hours."""
    k = cycle_times(spark, d)
    out = k.groupingSets([[F.col("issue_type")], []], F.col("issue_type"))
    at = [F.round(F.expr(f"percentile_disc({p}) within group (order by cycle)"), 4).alias(f"p{round(p * 100)}") for p in (0.5, 0.75, 0.9)]
    return out.agg(F.count("*").alias("n"), *at, F.round(F.avg("cycle"), 4).alias("mean")).withColumn("issue_type", F.coalesce("issue_type", F.lit("all")))


@query(_STATUS + _BORN + """, l as (select issue_key, max(moment) as last from st group by 1)
select issue_key, (epoch_us(coalesce(resolved, last)) - epoch_us(born))::bigint as micros from l join born using (issue_key) where epoch_us(coalesce(resolved, last)) > epoch_us(born)""")
def w03_total_lead(spark, d):
    """From the creation to the resolution, or to the last change of status; only where that is later."""
    last = _status(spark, d).groupBy("issue_key").agg(F.max("at").alias("last")).join(_born(spark, d), "issue_key")
    return last.select("issue_key", (F.unix_micros(F.coalesce("resolved", "last")) - F.unix_micros("born")).alias("micros")).where("micros > 0")


@query(_STATUS + """select issue_key, epoch_us(min(moment) filter (t = 'in progress')) as started_us, epoch_us(min(moment) filter (t in ('done', 'closed'))) as ended_us from st group by 1""")
def w06_first_start_and_end(spark, d):
    first = lambda *v: F.unix_micros(F.min(F.when(F.col("to_value").isin(*v), F.col("at"))))
    return _status(spark, d).groupBy("issue_key").agg(first(BUSY).alias("started_us"), first("done", "closed").alias("ended_us"))


_WORKFLOW = _STATUS + _BORN + """, w as (select st.issue_key, coalesce(case when row_number() over p = 1 then f else lag(t) over p end, 'unknown') as value, epoch_us(moment) - epoch_us(coalesce(lag(moment) over p, born)) as micros
  from st left join born on st.issue_key = born.issue_key window p as (partition by st.issue_key order by moment, id)),
days as (select value, count(*) as n, avg(micros) / 86400000000.0 as days from w where micros >= 0 group by 1)
"""


def stays_by_status(spark, d) -> DataFrame:
    s = timeline.stays(_status(spark, d).join(_born(spark, d), "issue_key", "left"), "issue_key", "at", "id", "from_value", "to_value", created="born")
    return s.groupBy("value").agg(F.count("*").alias("n"), (F.avg("micros") / 86_400_000_000).alias("days"))


@query(_WORKFLOW + "select value, n, round(days, 1) as days, days = max(days) over () as bottleneck from days")
def a24_days_in_status(spark, d):
    """Mean days in each status, the first stay counted from the creation, and which status holds longest."""
    s = stays_by_status(spark, d)
    return s.join(F.broadcast(s.agg(F.max("days").alias("most")))).select("value", "n", F.round("days", 1).alias("days"), (F.col("days") == F.col("most")).alias("bottleneck"))  # one row


@query(_STATUS + """, q as (select issue_key, first(f order by moment, id) || ' > ' || string_agg(t, ' > ' order by moment, id) as sequence from st group by 1),
c as (select sequence, count(*) as n from q group by 1) select sequence, n, round(n * 1.0 / (select sum(n) from c), 6) as confidence from c order by n desc, sequence limit 1""")
def a24_usual_path(spark, d):
    """The most frequent sequence of statuses and its share."""
    q = timeline.sequences(_status(spark, d), "issue_key", "at", "id", "from_value", "to_value").groupBy("sequence").agg(F.count("*").alias("n"))
    best = q.orderBy(F.desc("n"), "sequence").limit(1)
    return best.join(F.broadcast(q.agg(F.sum("n").alias("total")))).select("sequence", "n", F.round(F.col("n") / F.col("total"), 6).alias("confidence"))


@query(
    _TICKETS.replace("with cur", _STATUS.strip() + ", cur", 1).replace("\n)\n", "\n)\n")
    + """select upper(trim(c.issue_key)) as issue_key, c.status, coalesce(list(epoch_us(moment) || ' ' || f || ' > ' || t order by moment, id) filter (st.id is not null), []) as changes
from cur c left join st on st.issue_key = upper(trim(c.issue_key)) group by 1, 2"""
)
def j06_tickets_with_changes(spark, d):
    """Tickets with the changes of their status nested in order; an empty list where there are none. An issue's changes are bounded by its own life."""
    row = F.struct("at", "id", "from_value", "to_value")
    nested = _status(spark, d).groupBy("issue_key").agg(F.array_sort(F.collect_list(row)).alias("c"))
    t = tickets_now(spark, d, "status").select(F.upper(F.trim("issue_key")).alias("issue_key"), "status")
    line = F.transform("c", lambda x: F.concat(F.unix_micros(x["at"]), F.lit(" "), x["from_value"], F.lit(" > "), x["to_value"]))
    return t.join(nested, "issue_key", "left").select("issue_key", "status", F.coalesce(line, F.array().cast("array<string>")).alias("changes"))


# Small ones.


@query(_TICKETS + "select issue_key, regexp_matches(issue_key, '^[A-Z][A-Z0-9_]+-\\d+$') as valid from cur")
def t19_valid_keys(spark, d):
    return tickets_now(spark, d).select("issue_key", F.col("issue_key").rlike(r"^[A-Z][A-Z0-9_]+-\d+$").alias("valid"))


_KEYWORDS = "list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '[\\s,.:;()\\-/]+'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: length(x) > 2 and not list_contains([" + ", ".join(f"'{w}'" for w in [*text.STOP_WORDS, *text.KEYWORD_STOPS]) + "], x)))"


@query(_TICKETS + "select issue_key, list_sort(" + _KEYWORDS.format(c="summary") + ") as keywords from cur")
def t03_keywords(spark, d):
    return tickets_now(spark, d, "summary").select("issue_key", F.array_sort(text.keywords(F.col("summary"))).alias("keywords"))


@query(_TICKETS + ", k as (select issue_key, unnest(" + _KEYWORDS.format(c="summary") + ") as w from cur), r as (select *, row_number() over (partition by issue_key order by length(w) desc, w) as place from k) select issue_key, list(w order by place) as longest from r where place <= 3 group by 1")
def k03_longest_keywords(spark, d):
    """The three longest keywords, the longest first, ties in alphabetical order."""
    k = tickets_now(spark, d, "summary").select("issue_key", text.longest(text.keywords(F.col("summary")), 3).alias("longest"))
    return k.where(F.size("longest") > 0)


@query(_TICKETS + "select issue_key, case when length(summary) > 50 then substr(summary, 1, 50) || '…' else summary end as summary, substr(coalesce(description, ''), 1, 200) as lead, strftime(created::timestamp, '%Y-%m-%d') as day from cur")
def f13_shortened(spark, d):
    """Tickets as a list shows them: a summary of at most 50 characters, the first 200 of the description, the day of creation (D04)."""
    return tickets_now(spark, d, "summary", "description", "created").select("issue_key", text.shortened(F.col("summary"), 50).alias("summary"), F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("lead"), F.date_format("created", "yyyy-MM-dd").alias("day"))


@query(_TICKETS + ", r as (select issue_key, list(c order by moment, id, c) as c from (select upper(trim(issue_key)) as issue_key, id, created as moment, field || ': ' || coalesce(to_value, '') as c from (select distinct id, issue_key, created, field, to_value from changelogs)) group by 1) select issue_key, c[greatest(1, len(c) - 4):] as latest from r".replace(_TICKETS, "with x as (select 1)"))
def k05_latest_entries(spark, d):
    """The last five entries of each issue's log, as written, in order of their text of ``created``."""
    e = load(spark, d, "changelogs").select("id", "issue_key", "created", "field", "to_value").distinct()
    row = F.struct("created", "id", F.concat_ws(": ", "field", F.coalesce("to_value", F.lit(""))).alias("c"))
    log = e.groupBy(F.upper(F.trim("issue_key")).alias("issue_key")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return log.select("issue_key", F.transform(F.slice("r", F.greatest(F.lit(1), F.size("r") - 4), F.lit(5)), lambda x: x["c"]).alias("latest"))


@query(_TICKETS + ", o as (select issue_key, row_number() over (order by created, issue_key) as place, count(*) over () as n from cur) select place, issue_key from o where place = 1 or place = n")
def k07_first_and_last(spark, d):
    """The first and the last ticket of the backlog and their places."""
    t = tickets_now(spark, d, "created")
    order = ["created", "issue_key"]
    first = t.orderBy(*order).limit(1).select(F.lit(1).cast("bigint").alias("place"), "issue_key")
    last = t.orderBy(*[F.desc(c) for c in order]).limit(1).join(F.broadcast(t.agg(F.count("*").alias("place")))).select("place", "issue_key")
    return first.unionByName(last)


@query(_TICKETS + """, known as (select distinct lower(trim(unnest(components))) as c from cur where lower(trim(issue_type)) = 'story')
select issue_key, list_sort(list(c)) as unknown from (select issue_key, unnest(""" + _ENTRIES.format(c="components") + """) as c from cur) where c not in (select c from known where c is not null) group by 1""")
def u05_unknown_components(spark, d):
    """Components of tickets that no story has."""
    t = tickets_now(spark, d, "components", "issue_type").select("issue_key", low("issue_type").alias("issue_type"), F.explode(entries("components")).alias("c"))
    known = t.where("issue_type = 'story'").select("c").distinct()
    return t.join(known, "c", "left_anti").groupBy("issue_key").agg(F.array_sort(F.collect_list("c")).alias("unknown"))


@query(_TICKETS + ", c as (select lower(trim(issue_type)) as issue_type, lower(trim(priority)) as p, count(*) as n from cur where priority is not null group by 1, 2) select issue_type, string_agg(p || '=' || n, ', ' order by p) as priorities from c group by 1")
def p01_priorities_of_types(spark, d):
    """Each type's priorities and how often they are given, through a map, written out in order."""
    n = tickets_now(spark, d, "issue_type", "priority").where("priority is not null").groupBy(low("issue_type").alias("issue_type"), low("priority").alias("p")).agg(F.count("*").alias("n"))
    m = n.groupBy("issue_type").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("m"))
    lines = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("issue_type", F.array_join(lines, ", ").alias("priorities"))


@query(_PAGES + "select 'type' as kind, page_type as name, count(*) as n from cur group by 2 union all select 'pages', '', count(*) from cur union all select 'chunks', '', (select count(distinct id) from chunks)")
def h14_store_statistics(spark, d):
    """Pages by type, all pages and all chunks."""
    pages = stats.counts_by(pages_now(spark, d, "page_type"), {"type": "page_type"}).withColumn("kind", F.when(F.col("kind") == "all", "pages").otherwise(F.col("kind")))
    return pages.unionByName(load(spark, d, "chunks").agg(F.lit("chunks").alias("kind"), F.lit("").alias("name"), F.count_distinct("id").alias("n")))
