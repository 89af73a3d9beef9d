import pytest

from worklens.llm.language import document_stretches, judge, named_language, segments, stretches, train
from worklens.sources.tables import load

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return train(spark, load(spark, D, "lang_samples"))


def test_held_out_sentences(spark):
    rows = load(spark, D, "lang_samples").orderBy("sample_id").collect()
    df = load(spark, D, "lang_samples")
    wrong = total = 0
    for fold in range(2):
        m = train(spark, df.where(f"sample_id % 4 <> {fold}"))
        for r in rows:
            if r["sample_id"] % 4 == fold:
                for _, _, _, k, c in judge(m, [r["text"]]):
                    total += 1
                    wrong += m.languages[k] != r["lang"]
                    assert 0 < c <= 1
    assert wrong <= 0.02 * total


def test_labels():
    assert [named_language(x) for x in ("en_GB", "German", "por", "pt-BR", "ger", " FR ", "und", "", None, "xx", "n/a")] == ["en", "de", "pt", "pt", "de", "fr", None, None, None, None, None]
    assert named_language("sv-SE") is None and named_language("sv-SE", frozenset({"sv", "en"})) == "sv"


def test_segments_skip_what_has_no_language():
    t = "# Heading that is long enough to count\n```\ncode that is long enough to count here\n```\n| a table row that is long enough |\n2025-02-08T09:07:06.023Z WARN [a] rc=983 too long\n- [ ] This item is long enough to count.\nShort. This sentence is also long enough to be one."
    assert [t[a:b] for a, b in segments(t)] == ["This item is long enough to count.", "This sentence is also long enough to be one."]


def test_mixed_document_and_edges(spark, model):
    de = "Danke an alle für die Geduld, wir melden uns morgen mit einem neuen Stand."
    fr = "MERCI DE NE PAS DEPLACER LA VALIDATION, LORSQUE DEUX PERSONNES ENREGISTRENT."
    rows = [(1, f"{de} {de}\n\n- {fr}", "de-AT", 1), (2, None, None, 1), (3, "", "en", 1), (4, "  \n ", "en", 1), (None, de, None, 1), (5, (de + " ") * 3000, "xx", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, named int")
    got = [(r["doc_id"], r["lang"], r["named"]) for r in stretches(df, model).orderBy("doc_id", "stretch_no").collect()]
    assert got == [(None, "de", False), (1, "de", True), (1, "fr", False), (5, "de", False)]
    assert stretches(df.limit(0), model).count() == 0


def test_stretches_lie_in_their_texts(spark):
    for r in document_stretches(spark, D).join(load(spark, D, "documents").select("doc_id", "text"), "doc_id").collect():
        assert 0 <= r["start"] < r["end"] <= len(r["text"]) and 0 <= r["confidence"] <= 1
