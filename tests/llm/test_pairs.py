import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from worklens.llm.cooccurrence import PairTable, ticket_items
from worklens.llm.near_tickets import components
from worklens.llm.simjoin import _in_blocks, classes, sign, similar_classes, tokens_of


def truth(baskets):
    one, two = Counter(), Counter()
    for items in baskets.values():
        s = sorted({x for x in items or [] if x is not None})
        one.update(s)
        two.update(itertools.combinations(s, 2))
    return {(a, b): (k, one[a], one[b], len(baskets)) for (a, b), k in two.items()}


def counts(df):
    return {(r["item_a"], r["item_b"]): (r["n_both"], r["n_a"], r["n_b"], r["n_baskets"]) for r in df.collect()}


@pytest.mark.parametrize("rows_a_bucket,block", [(1_000_000, 512), (3, 2)])
def test_pair_table_follows_changes(spark, tmp_path, rows_a_bucket, block):
    random.seed(1)
    now, before = {}, {}
    for number in range(3):
        table = PairTable(spark, str(tmp_path / "pairs"), rows_a_bucket, block)  # opened again for every batch
        batch = {f"t{random.randint(0, 40)}": random.choice([None, [], random.choices(["a", "b", "c", "d", "e", None], k=7)]) for _ in range(25)}
        gone = random.sample(sorted(now), 5) if now else []
        now = {k: v for k, v in (now | batch).items() if k not in gone}
        rows = spark.createDataFrame([(k, v, "x") for k, v in batch.items()], "basket_id string, items array<string>, n string")
        removed = spark.createDataFrame([(k,) for k in gone], "basket_id string")
        assert table.apply(rows, removed, number) and not table.apply(rows, removed, number)
        got = counts(PairTable(spark, str(tmp_path / "pairs"), rows_a_bucket, block).scores())
        assert got == truth(now) and table.total == len(now)
        assert counts(table.scores(affected_only=True)) == {p: v for p, v in got.items() if v[:3] != before.get(p, ())[:3]}
        before = got
    assert table.apply(spark.createDataFrame([], "basket_id string, items array<string>"))
    assert table.total == len(now) and counts(table.scores()) == got and not counts(table.scores(affected_only=True))


def test_item_spelling(spark):
    df = spark.createDataFrame([("k", [" Web  App ", "web_app", "WEB--app", " ", None, "x\t_-y"], None)], "issue_key string, labels array<string>, components array<string>")
    items = ticket_items(df).first()["items"]
    assert [i for i in items if i] == ["l:web-app"] * 3 + ["l:x-y"]


def brute(sets, least):
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def joined(spark, sets, **more):
    """Pairs of keys that the join finds; members. Of each class the least key stands for it."""
    df = spark.createDataFrame([(k, " ".join(sorted(v))) for k, v in sets.items()], "key string, text string")
    reps, members = classes(sign(df, ["key"], "text", least_len=1))
    texts = lambda asked: df.join(asked.withColumnRenamed("rep", "key"), "key").select("cid", "h", "g", "text")
    key = {r["cid"]: r["rep"] for r in reps.select("cid", "rep").collect()}
    return {tuple(sorted((key[a], key[b]))) for a, b in similar_classes(reps, texts, 0.6, least_len=1, **more).collect()}, members


def test_similarity_join_finds_edited_sets(spark):
    random.seed(9)
    sets = {}
    for i in range(120):
        base = {f"w{random.randint(0, 3000)}" for _ in range(30)} | {"the", "and", "for"}
        sets[f"a{i:03}"] = base
        edited = set(random.sample(sorted(base), 26)) | {f"x{random.randint(0, 3000)}" for _ in range(3)}
        sets[f"b{i:03}"] = edited
    want = brute(sets, 0.6)
    for more in ({}, {"limit": 8}, {"limit": 4, "most_rows": 20}, {"limit": 2, "most_rows": 3, "most": 2}):
        got, _ = joined(spark, sets, **more)
        assert got <= want and len(got) >= 0.97 * len(want)


def test_copies_and_a_dense_group(spark):
    random.seed(2)
    common = {f"c{i}" for i in range(40)}
    sets = {f"k{i:03}": common | {f"u{i}"} for i in range(90)} | {f"z{i}": set(common) for i in range(3)}
    got, members = joined(spark, sets, limit=8, most=10, most_rows=20)
    assert members.count() == len(sets) and members.select("cid").distinct().count() == 91
    keys = sorted(k for k in sets if k not in ("z1", "z2"))
    assert got == set(itertools.combinations(keys, 2))


def test_blocks_give_every_pair(spark):
    df = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 1), (2, 2)], "node bigint, cid bigint")
    held = {}
    for r in _in_blocks(df, 7).collect():
        held.setdefault(r["node"], set()).add(r["cid"])
    got = {p for v in held.values() for p in itertools.combinations(sorted(v), 2)}
    assert got == set(itertools.combinations(range(40), 2)) and len(held) == 16


def test_empty_and_words(spark):
    df = spark.createDataFrame([(1, "Ab abC ABC x1y \u00e9-zzz"), (2, "zzz x1y.abc"), (3, None), (4, ""), (5, "x" * 300_000 + " zzz")], "k int, t string")
    got = {r["k"]: (sorted(r["tokens"]), r["h"], r["g"]) for r in tokens_of(df, ["k"], "t").collect()}
    assert got[1] == got[2] and len(got[1][0]) == 3 and got[3][0] == got[4][0] == [] and len(set(got[5][0]) & set(got[1][0])) == 1
    named = {r["k"]: (r["h"], r["g"], r["n"]) for r in sign(df, ["k"], "t").collect()}
    assert {k: v[:2] for k, v in named.items()} == {k: v[1:] for k, v in got.items()} and named[1][2] == 3
    empty = sign(df.where("k > 9").select(F.col("k").cast("string").alias("key"), "t"), ["key"], "t")
    reps, _ = classes(empty)
    assert similar_classes(reps, lambda asked: asked.select("cid", "h", "g", F.lit("").alias("text")), 0.6).count() == 0


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(30)], "cid bigint")
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(25, 27)], "a bigint, b bigint")
    root = {r["cid"]: r["root"] for r in components(nodes, links).collect()}
    assert {root[i] for i in range(21)} == {0} and root[27] == 25 and root[29] == 29


def test_recall_does_not_hang_on_how_frequent_the_common_words_are(spark):
    for n, pool in ((4000, 200), (20_000, 60)):
        random.seed(1)
        words, sets, want = [f"common{i}" for i in range(pool)], {}, set()
        own = (f"own{i}" for i in itertools.count())
        for i in range(n // 2):
            shared = [random.sample(words, 20) for _ in "ab"]
            if i < 2000:
                shared[1] = shared[0]
                want.add((f"a{i:05}", f"b{i:05}"))
            for name, s in zip("ab", shared):
                sets[f"{name}{i:05}"] = set(s) | {next(own) for _ in range(6)}
        got, _ = joined(spark, sets)
        assert len(got & want) >= 0.99 * len(want)
