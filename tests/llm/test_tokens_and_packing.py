import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from worklens.llm import bpe, packing

SCHEMA = "doc_id bigint, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_match_the_library(spark, reference):
    random.seed(7)
    bits = list("  \n\t''''sdtmlrvex1289!.-aZ 　é́日語ßΩ²½\U0001f600​\x00\x1c") + ["'ll", "'re", "<|endoftext|>", "﻿", "\r\n"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 40))) for _ in range(1500)]
    texts += ["", " ", "a" * 20000, " " * 3000 + "x", "'" * 999, "ab" * 9000, "語" * 4000, None, "same", "same"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = {r["doc_id"]: r for r in bpe.encode_documents(df, offsets=True).collect()}
    assert len(rows) == len(texts)
    for i, (t, want) in enumerate(zip(texts, reference([t or "" for t in texts]))):
        assert rows[i]["ids"] == want
        ends = rows[i]["byte_ends"]
        assert len(ends) == len(want) and (not ends or ends[-1] == len((t or "").encode()))
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.encode_documents(df, lengths_only=True).collect()}
    assert counts == {k: len(r["ids"]) for k, r in rows.items()}


def test_empty_table_and_null_ids(spark):
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = bpe.encode_documents(spark.createDataFrame([(None, "hi", "", ""), (None, None, "", "")], SCHEMA)).collect()
    assert sorted(len(r["ids"]) for r in rows) == [0, 1]


def test_plan_places_every_item_once():
    random.seed(5)
    for top in (3, 10, 60):
        counts = Counter(random.randint(1, top) for _ in range(400))
        plan = packing.plan_containers(counts, 60)
        used = Counter()
        for chosen, times in plan:
            assert sum(chosen) <= 60
            for k in chosen:
                used[k] += times
        assert used == counts
        assert sum(t for _, t in plan) <= -(-sum(k * n for k, n in counts.items()) // 60) + 2


def test_containers(spark):
    random.seed(6)
    sizes = [random.choice([7, 7, 7, 30, 55, 100, 101, 250]) for _ in range(3000)] + [0, None, -3]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)], "id bigint, size int, container_id int")
    rows = packing.pack(df, "id", "size", 100, buckets=8).collect()
    load, parts = Counter(), Counter()
    for r in rows:
        load[r["container_id"]] += r["part_size"]
        parts[r["id"]] += r["part_size"]
        assert r["part_start"] == 100 * r["part_no"]
    assert max(load.values()) <= 100
    assert parts == {i: n for i, n in enumerate(sizes) if n and n > 0}
    assert len(load) <= -(-sum(parts.values()) // 100) * 1.05
    assert packing.pack(df.limit(0), "id", "size").count() == 0


def test_decoding_gives_the_texts_back(spark):
    rows = [(1, "Ünï code\r\n \U0001f600  x"), (None, "plain"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    from worklens.llm.bpe import decode_documents, encode_documents

    got = sorted((str(r["doc_id"]), r["text"]) for r in decode_documents(encode_documents(df)).collect())
    assert got == sorted((str(i), t or "") for i, t in rows)
    cut = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert decode_documents(cut).first()["text"] == ""
