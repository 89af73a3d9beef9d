"""Findings of the review: each test fails on the code before its change."""

import random

from tests.llm.test_pairs import brute, joined
from worklens.llm.cooccurrence import PairTable
from worklens.llm.near_tickets import components


def test_similarity_join_finds_sets_of_a_common_form(spark):
    random.seed(5)
    form, rare = {f"f{i}" for i in range(40)}, [f"w{i}" for i in range(6000)]
    sets = {f"a{i:03}": form | set(random.sample(rare, 10)) for i in range(120)}
    sets |= {f"b{i:03}": set(random.sample(rare, 50)) for i in range(240)}
    want = brute(sets, 0.6)
    got, _ = joined(spark, sets)
    assert len(want) > 7000 and got <= want and len(got) >= 0.97 * len(want)


def test_long_chains_in_any_order_are_one_component(spark):
    random.seed(7)
    ids = random.sample(range(10_000), 500)
    links = [(min(p), max(p)) for p in zip(ids, ids[1:])] + [(20_000, 20_001)]
    nodes = spark.createDataFrame([(i,) for i in [*ids, 20_000, 20_001, 20_002]], "cid bigint")
    root = {r["cid"]: r["root"] for r in components(nodes, spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert root == {i: min(ids) for i in ids} | {20_000: 20_000, 20_001: 20_000, 20_002: 20_002}


def test_affected_pairs_are_those_that_changed(spark):
    table, full = PairTable(spark), {}
    for batch in ([("1", ["a", "b"]), ("2", ["c", "d"]), ("3", ["e", "f"])], [("1", ["a", "c"]), ("2", ["b", "d"])], []):
        table.apply(spark.createDataFrame(batch, "basket_id string, items array<string>"))
        before, full = full, {(r["item_a"], r["item_b"]): (r["n_both"], r["n_a"], r["n_b"]) for r in table.scores().collect()}
        affected = {(r["item_a"], r["item_b"]) for r in table.scores(affected_only=True).collect()}
        assert affected == {p for p in full if full[p] != before.get(p)}
