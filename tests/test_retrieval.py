import datetime as dt
import json

from pyspark.sql import functions as F

from worklens.functions import doctree
from worklens.operators import search, sections
from worklens.sources import ingest, store


def test_document_tree_and_text():
    md = "# A **b**\n\ntext `c` [d](http://e) http://f\n---\n- one\n  1. deep\n- two\n- [x] done\n- [ ] open\n```py\nx = 1\n```"
    tree = doctree.tree_of(md)
    kinds = [n["type"] for n in tree["content"]]
    assert kinds == ["heading", "paragraph", "rule", "bulletList", "taskList", "codeBlock"]
    assert tree["content"][0]["content"][1] == {"type": "text", "text": "b", "marks": [{"type": "strong"}]}
    assert [n.get("marks", [{}])[0].get("type") for n in tree["content"][1]["content"]] == [None, "code", None, "link", None, "link"]
    assert tree["content"][3]["content"][0]["content"][1]["type"] == "orderedList" and tree["content"][5]["attrs"] == {"language": "py"}
    text = doctree.text_of(tree)
    assert text.startswith("# A b\ntext c d http://f\n- one\n- deep\n") and "- [x] done\n- [ ] open\n" in text and "```\nx = 1\n```\n" in text
    assert doctree.text_of(None) == doctree.text_of("x") == "" and doctree.tree_of(None)["content"] == []


def test_chunks_of_sections():
    md = "# Guide\n\n" + "a" * 60 + "\n\n## Part\n\n" + "b" * 70 + "\n\n### Tiny\n\nshort\n\n## Next\n\n```\n# no heading\n```\n" + "c" * 50
    got = sections.chunks(md)
    assert [(c, h, n) for c, h, n, _ in got] == [("Guide", "Guide", 1), ("Guide > Part", "Part", 2), ("Guide > Next", "Next", 2)]
    assert got[0][3] == "a" * 60 and got[1][3] == "…" + "a" * 60 + "\n\n---\n\n" + "b" * 70 + "\n\n## Tiny\nshort"
    assert "# no heading" in got[2][3] and got[2][3].startswith("…" + "b" * 70)
    long = sections.chunks("# L\n\n" + "\n\n".join("x" * 900 for _ in range(4)))
    assert [h for _, h, _, _ in long] == ["L (1/2)", "L (2/2)"] and all(len(t) <= 2000 for *_, t in long)
    assert sections.chunks(None) == sections.chunks("") == [] and [h for _, h, _, _ in sections.chunks("# only")] == ["only"]


def test_ingest_of_nested_json(spark):
    records = [
        {"key": "A-1", "fields": {"summary": "one", "issuetype": {"name": "Bug"}, "components": [{"name": "web"}], "labels": None, "p2": 3, "assignee": {"displayName": "x"}, "created": "2024-01-01T00:00:00.000+0100"},
         "changelog": {"histories": [{"id": "2", "created": "t2", "items": [{"field": "status", "fromString": "a", "toString": "b"}, {"field": "points", "toString": "3"}]}]}},
        {"key": "A-2", "fields": {}},
        {"fields": {"summary": "no key"}},
    ]
    raw = spark.createDataFrame([(json.dumps(r),) for r in records] + [("{broken",), (None,)], "value string")
    t = {r["issue_key"]: r for r in ingest.tickets_of(raw, ("p1", "p2")).collect()}
    assert set(t) == {"A-1", "A-2"} and t["A-1"]["story_points"] == 3 and t["A-1"]["components"] == ["web"] and t["A-1"]["labels"] == []
    assert t["A-1"]["created"] == dt.datetime(2023, 12, 31, 23) and t["A-2"]["issue_type"] == "Unknown" and t["A-2"]["assignee"] is None
    changes = ingest.changes_of(raw)
    assert sorted((r["issue_key"], r["id"], r["field"], r["to_value"]) for r in changes.collect()) == [("A-1", "2", "points", "3"), ("A-1", "2", "status", "b")]
    logs = {r["issue_key"]: [c["field"] for c in r["changelog"]] for r in ingest.enriched(ingest.tickets_of(raw), changes).collect()}
    assert logs == {"A-1": ["points", "status"], "A-2": []}


def test_crawl(spark):
    body = "<h1>Runbook</h1><p>" + "steps " * 20 + "</p>"
    rows = [("1", "Runbook x", body, ["Ops"]), ("2", "Kept", body, ["ops"]), ("3", "Blank", "  ", ["ops"]), ("4", "Old", body, ["ops", "archived"]), ("5", "Other", body, None)]
    raw = spark.createDataFrame([(json.dumps({"id": i, "title": t, "body": b, "labels": labels, "updatedAt": "2024-01-01T00:00:00Z"}),) for i, t, b, labels in rows], "value string")
    pages = ingest.pages_of(raw, "wiki")
    known = pages.where("id = '2'").select("id", "updated_at")
    stored, chunks = ingest.crawled(pages, known, ["ops"], ["archived"])
    assert [(r["id"], r["page_type"]) for r in stored.collect()] == [("1", "runbook")]
    assert [(r["id"], r["breadcrumb"]) for r in chunks.collect()] == [("1", "Runbook")]


DOCS = [("1", "Red fox", "jumps over a.b now"), ("2", "Blue", "red fox a b red"), ("3", "Fox", "red"), ("4", None, ""), ("5", "b", "a and b")]


def test_phrases_limits_and_empty_rows(spark):
    docs = spark.createDataFrame(DOCS, "id string, title string, body string")
    asked = spark.createDataFrame([("p", "a.b"), ("w", "a b"), ("t", "red_fox"), ("n", "***"), ("x", "nothing")], "query string, text string")
    index = search.postings(docs, "id", ["title", "body"])
    got = {}
    for r in search.search(index, asked).collect():
        got.setdefault(r["query"], set()).add(r["key"])
    assert got == {"p": {"1", "2"}, "w": {"1", "2", "5"}, "t": {"1", "2"}}
    assert [r["rank"] for r in search.search(index, asked.where("query = 'w'"), 2).collect()] == [1, 2]
    loose = {r["query"]: r for r in search.ranked(docs, "id", ["title", "body"], {"w": "a b"}, 1).collect()}
    exact = {(r["query"], r["key"]): r["score"] for r in search.search(index, asked, phrases=False).collect()}
    assert exact["w", loose["w"]["id"]] == loose["w"]["score"]
    assert search.search(search.postings(docs.limit(0), "id", ["title", "body"]), asked).count() == 0


def test_kept_index_follows_changes(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id string, title string, body string")
    index = search.Index(spark, str(tmp_path / "index"), "id", ["title", "body"], rows_a_bucket=8)
    index.rebuild(docs.where("id < '4'"))
    index.update(spark.createDataFrame([("3", "Wolf", "grey"), ("4", None, ""), ("5", "b", "a and b")], docs.schema), spark.createDataFrame([("2",)], "id string"))
    now = spark.createDataFrame([DOCS[0], ("3", "Wolf", "grey"), *DOCS[3:]], docs.schema)
    again = search.Index(spark, str(tmp_path / "index"), "id", ["title", "body"])
    assert sorted(map(str, again.postings.collect())) == sorted(map(str, search.postings(now, "id", ["title", "body"]).collect()))
    assert again.store.state["rows"] == again.postings.count()
    again.rebuild(docs)
    assert again.postings.select("key").distinct().count() == 5


def test_context_and_tiers(spark):
    chunks = spark.createDataFrame([("1", "P", "A > B", "h", "alpha beta"), ("2", "P", "A > B", "h", "alpha"), ("3", "Q", "", "h", "beta gamma"), ("4", "Q", None, None, "gamma")], "key string, page_title string, breadcrumb string, heading string, body string")
    texts = spark.createDataFrame([("q", "alpha beta-gamma"), ("none", "the")], "query string, text string")
    got = search.context(search.postings(chunks, "key", ["body"]), chunks, texts).orderBy("place").collect()
    assert [(r["query"], r["page_title"], r["location"]) for r in got] == [("q", "P", "A > B"), ("q", "Q", "h"), ("q", "Q", "")]
    hit = lambda *rows: spark.createDataFrame(list(rows), "query string, key string, rank int")
    tiers = search.two_tier(hit(("a", "c1", 1)), hit(("a", "p1", 1), ("b", "p2", 1)))
    assert sorted(tuple(r) for r in tiers.collect()) == [("a", "chunk", "c1", 1), ("b", "page", "p2", 1)]


def test_snippets(spark):
    df = spark.createDataFrame([("one two three Four five six seven eight nine",), ("four",), ("nothing",), (None,)], "t string")
    got = [r[0] for r in df.select(search.snippet(F.col("t"), ["four"], 8)).collect()]
    assert got == ["one two three **Four** five six…", "**four**", "", None] or got[:3] == ["one two three **Four** five six…", "**four**", ""]


def test_stores(spark):
    t = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 3)], "k string, t string, v int")
    assert store.lookup(t, t.where("v = 2"), ["k"]).count() == 2 and store.where_given(t, k="a", t=None).count() == 2
    assert {(r["k"], r["t"]): r["v"] for r in store.upsert(t, t.where("v = 1").withColumn("v", F.lit(9)), ["k", "t"]).collect()} == {("a", None): 9, ("a", "x"): 2, (None, "x"): 3}
    assert [tuple(r) for r in store.settings(spark.createDataFrame([("k", "a", 1), ("k", "b", 2), (None, "c", 3)], "k string, v string, at int"), "k", "v", "at").collect()] == [("k", "b")]
