import datetime as dt

import pytest

from worklens import catalogue, retrieval  # noqa: F401
from worklens.operators import search

AT = dt.datetime(2024, 1, 1)
DOCS = [("1", "Red fox", "jumps over a.b now"), ("2", "Blue", "red fox a b red"), ("3", None, ""), ("4", "b", "a and b"), ("5", "a b", "b c d"), ("6", "z", "a b c d")]
ASKED = [("p", "a.b"), ("w", "a b"), ("t", "red_fox"), ("n", "***"), ("x", "nothing"), ("l", "a_b_c"), ("m", "b.c.d a"), ("again", "b a"), ("r", "red red fox")]


def shuffled(spark) -> int:
    """Records that all stages until now have written for exchanges."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """150 pages, chunks and tickets with the same words, each of them also a query: 22,500 pairs for each search."""
    d = str(tmp_path_factory.mktemp("tables"))
    n = range(1, 151)
    spark.createDataFrame([(str(50 * i), f"Event bus {i}", f"The event bus of {i}", AT) for i in n], "id string, title string, content string, indexed_at timestamp").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i, str(50 * i), "", "Steps", "slow event bus " + "x " * (i % 7)) for i in n], "id bigint, page_id string, breadcrumb string, heading string, content string").write.parquet(f"{d}/chunks.parquet")
    spark.createDataFrame([(f"A-{50 * i}", "Slow event bus", AT) for i in n], "issue_key string, summary string, updated timestamp").write.parquet(f"{d}/tickets.parquet")
    return d


def test_f1_context_exchanges_no_pairs(spark, tables):
    before = shuffled(spark)
    got = catalogue.QUERIES["x08_context"](spark, tables).collect()
    assert len(got) == 150 * 10 and {r["place"] for r in got} == set(range(1, 11))
    assert len({(r["place"], r["key"]) for r in got}) == 10  # the same ten for all tickets
    assert shuffled(spark) - before < 8_000


def test_f1_search_of_rows_is_search(spark):
    docs = spark.createDataFrame(DOCS, "id string, title string, body string")
    asked = spark.createDataFrame(ASKED, "query string, text string")
    index = search.postings(docs, "id", ["title", "body"])
    for limit in (None, 1, 2):
        want = sorted(map(tuple, search.search(index, asked, limit).collect()))
        assert sorted(map(tuple, search.search_rows(docs, "id", ["title", "body"], asked, limit).collect())) == want
    assert {q for q, *_ in want} == {"p", "w", "t", "l", "m", "again", "r"}
    assert search.search_rows(docs.limit(0), "id", ["title", "body"], asked, 1).count() == search.search_rows(docs, "id", ["title", "body"], asked.limit(0), 1).count() == 0


def test_f1_queries_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "id string, title string, body string")
    asked = spark.createDataFrame(ASKED, "query string, text string")
    whole = sorted(map(tuple, search.search_rows(docs, "id", ["title", "body"], asked, 2).collect()))
    monkeypatch.setattr(search, "AT_ONCE", 200)
    assert sorted(map(tuple, search.search_rows(docs, "id", ["title", "body"], asked, 2).collect())) == whole


def test_f2_phrases_exchange_no_pairs(spark, tables):
    before = shuffled(spark)
    got = catalogue.QUERIES["x03_phrases"](spark, tables)
    assert got.columns == ["query", "id"] and got.distinct().count() == 22_500
    before = shuffled(spark)
    catalogue.QUERIES["x03_phrases"](spark, tables).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 22_500


def test_f2_matches_are_those_of_search(spark):
    docs = spark.createDataFrame(DOCS, "id string, title string, body string")
    asked = spark.createDataFrame(ASKED, "query string, text string")
    want = sorted((r["query"], r["key"]) for r in search.search(search.postings(docs, "id", ["title", "body"]), asked).collect())
    assert sorted(map(tuple, search.matches(docs, "id", ["title", "body"], asked).collect())) == want
