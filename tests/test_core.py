import datetime as dt
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from worklens import catalogue, reports, retrieval  # noqa: F401
from worklens.functions import dates, markup, text
from worklens.operators import search, sections, similarity, stats, timeline
from worklens.sources import buckets, store
from worklens.streaming import sync


def test_every_query_runs_and_matches_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in "pages chunks tickets changelogs sprints sprint_issues documents events".split():
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    for name, q in catalogue.QUERIES.items():
        df = q(spark, d)
        n = df.count()
        if name in catalogue.ORACLE:
            cur = con.execute(catalogue.ORACLE[name])
            assert sorted(c[0] for c in cur.description) == sorted(df.columns), name
            assert len(cur.fetchall()) == n, name


def test_html_to_markdown():
    h = markup.html_to_markdown
    assert h("<h2>A <i>b</i></h2><p>x &amp; y &copy;</p>") == "## A b\nx & y &copy;"
    assert h("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>") == "| a | b |\n| --- | --- || 1 | 2 |"
    assert h('<a href="u">u</a> <a href="v">t</a><br/><b>w</b><script>x</script>') == "u [t](v)\n**w**"
    assert h("") == "" and h(None) is None and h("a < b & c") == "a < b & c"
    assert h("<h1 class='x'>One <code>f()</code> <a href=\"u\">two</a></h1><p>a<br>b</p>") == "# One `f()` two\na\nb"
    assert h("<ul><li>one</li><li><em>two</em></li></ul>") == "- one\n- *two*"
    assert h("<b>open <i>shut</i>") == "open *shut*" and h('<b class="c">x</b>') == "x" and h("<strong>x</strong>") == "**x**"
    assert h("<pre><b>x</b>\n y</pre>") == "```\nx\n y\n```"
    assert h("<tr><TD>no</TD><td>a <b>b</b></td></tr>") == "| a b |" and h("<tr><td> </td></tr>") == "|  |"
    assert h('<ac:structured-macro ac:name="toc"><p>gone</p></ac:structured-macro>kept<style>p {}</style>') == "kept"
    assert h("&lt;b&gt; &nbsp;&#39;&#x27;&eacute;&#233;") == "<b>  ''&eacute;&#233;"


def test_business_days(spark):
    rows = [("2024-01-01", "2024-01-05", 5), ("2024-01-05", "2024-01-08", 2), ("2024-01-06", "2024-01-07", 1), ("2024-01-01", "2024-01-01", 0), (None, "2024-01-01", None)]
    df = spark.createDataFrame(rows, "a string, b string, n int").select(dates.business_days(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("got"), "n")
    assert all(r["got"] == r["n"] for r in df.collect())


def test_statistics(spark):
    df = spark.createDataFrame([("g", i) for i in range(1, 11)] + [("one", 4), ("one", None)], "g string, v int")
    r = {x["g"]: x for x in stats.spread_of(df, ["g"], "v").collect()}
    assert r["g"]["p90"] == 9 and r["g"]["median"] == 5.5 and r["one"]["sd"] == 0
    t = {x["g"]: x for x in stats.trend(df.withColumn("x", F.col("v")), ["g"], "x", "v").collect()}
    assert t["g"]["slope"] == pytest.approx(1) and t["one"]["slope"] == 0 and t["one"]["intercept"] == 4
    top = stats.top_n(spark.createDataFrame([("g", x) for x in ["b", "a", "b", "a", "c", None]], "g string, i string"), ["g"], "i", 2).orderBy("rank").collect()
    assert [(x["i"], x["count"]) for x in top] == [("a", 2), ("b", 2)]


def test_timeline(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([("a", at(1), "1", "new", "open"), ("a", at(3), "2", "open", "done"), ("a", at(4), "3", "done", "open"), ("b", at(1), "4", None, "done")], "k string, at timestamp, id string, f string, t string")
    s = {(r["k"], r["value"], r["micros"]) for r in timeline.stays(df, "k", "at", "id", "f", "t").collect()}
    assert s == {("a", "open", 7_200_000_000), ("a", "done", 3_600_000_000)}
    assert {r["k"]: r["sequence"] for r in timeline.sequences(df, "k", "at", "id", "f", "t").collect()} == {"a": "new > open > done > open", "b": "unknown > done"}
    assert {r["k"]: r["returned"] for r in timeline.returned(df, "k", "at", "id", "t", F.col("t") == "done").collect()} == {"a": True, "b": False}


def test_similar_pairs_against_all_pairs(spark):
    random.seed(3)
    sets = {f"k{i}": random.sample("abcdefghijkl", random.randint(0, 7)) for i in range(120)}
    got = {(r[0], r[1]) for r in similarity.similar_pairs(spark.createDataFrame(list(sets.items()), "k string, t array<string>"), "k", "t", 0.5).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) >= 0.5 * len(set(sets[a]) | set(sets[b]))}
    assert got == want


def test_search(spark):
    assert search.query_words('say "a" NOT b-c*') == ["say", "a", "b", "c"]
    docs = spark.createDataFrame([(1, "red fox", None), (2, "red red", "fox fox dog"), (3, None, "dog")], "id int, title string, body string")
    hits = search.ranked(docs, "id", ["title", "body"], {"q": "red fox", "none": "***"}).collect()
    assert {r["id"] for r in hits} == {1, 2}
    assert search.ranked(docs.limit(0), "id", ["title"], {"q": "x"}).count() == 0


def test_sections_and_chunks():
    md = "# Top\n" + "a" * 60 + "\n## Mid\n" + "b" * 60 + "\n### Deep\n" + "c" * 60 + "\n```\n# no heading\n```\n"
    got = sections.chunks(md)
    assert [c[0] for c in got] == ["Top", "Top > Mid", "Top > Mid > Deep"] and "# no heading" in got[2][3]
    assert len(sections.chunks("# A\n" + "a" * 60 + "\n# B\ntiny")) == 1
    big = sections.chunks("# A\n" + "\n\n".join("p" * 900 for _ in range(5)))
    assert [c[1] for c in big] == ["A (1/3)", "A (2/3)", "A (3/3)"]
    assert sections.chunks("") == [] and sections.chunks(None) == []


def test_store(spark):
    t = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    up = store.upsert(t, spark.createDataFrame([("a", 5), ("a", 4), (None, 9), ("c", 1)], "k string, v int"), ["k"])
    assert {(r[0], r[1]) for r in up.collect()} == {("a", 5), (None, 9), ("b", 3), ("c", 1)}
    left, kids, n = store.delete_where(t, F.col("v") > 2, spark.createDataFrame([("a",), ("b",)], "p string"), "k", "p")
    assert left.count() == 2 and [r[0] for r in kids.collect()] == ["a"] and n.first()[0] == 1


def test_stream_sync_by_buckets(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", 1, "x") for i in range(40)], "k string, v int, s string")
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    batches = (df, df.where("k = 'k7'").withColumn("v", F.lit(7)), df.where("k = 'k7'").withColumn("v", F.lit(3)).union(df.limit(0)))
    places = []
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(src)
        sync.sync(spark, src, df.schema, target, str(tmp_path / "cp"), ["k"], ["v"]).awaitTermination()
        places.append(dict(sync.synced(spark, target, df.schema, ["k"]).places))
    table = sync.synced(spark, target, df.schema, ["k"])
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {(f"k{i}", 7 if i == 7 else 1) for i in range(40)}
    assert len(places[0]) > 1 and sum(places[0][b] != places[1][b] for b in places[0]) == 1
    assert not buckets.upsert_into(table, df.withColumn("v", F.lit(99)), ["v"], table.store.state["number"])
    first, second = sync.synced(spark, target, df.schema, ["k"]), sync.synced(spark, target, df.schema, ["k"])
    assert buckets.upsert_into(first, df.where("k = 'k1'").withColumn("v", F.lit(5)), ["v"])
    with pytest.raises(RuntimeError):
        buckets.upsert_into(second, df, ["v"])
    again = buckets.Table(buckets.Store(spark, target), "rows", "k string, v int, s string", ["k"], rows_a_bucket=5)
    assert buckets.upsert_into(again, df.withColumn("k", F.concat("k", F.lit("x"))), ["v"])
    assert again.n > 4 and again.read().count() == 80 == again.store.state["rows-rows"]
    assert len([x for x in os.listdir(target) if x.startswith("v")]) <= 6


def test_windowed_counts_as_a_stream_drop_late_rows(spark, tmp_path):
    src, at = str(tmp_path / "events"), lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    seen = []
    query = None
    for rows in ([(at(1), "a"), (at(1, 5), "a"), (at(2), "b")], [(at(6), "a")], [(at(1, 7), "a"), (at(6, 1), "a")], [(at(12), "z")]):
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("ts timestamp, kind string").parquet(src)
        counts = sync.windowed_counts(stream, "ts", "30 minutes", "1 hour", "kind")
        query = counts.writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(seen) == [(at(1), "a", 2), (at(2), "b", 1), (at(6), "a", 2)]
