import random
from collections import Counter

import pytest

from tests.llm.brute import blocks
from worklens.llm import splitting
from worklens.llm.splitting import find_large_blocks, large_blocks_of_files, pieces_of_files, split_items, split_text

PARTS = ["\n", "\r\n", "\r", "\n\n", "# h", "## x\n", "text é語", "```", "~~~", " ```py", "  ~~~", " ", "\t", " ", "#nohead", "\n \n", "word word. ", "###### x", "####### y", "``", "\n```\n", "\n~~~\n"]


def texts(n, most=25):
    random.seed(n)
    return ["".join(random.choice(PARTS) for _ in range(random.randint(0, most))) for _ in range(n)]


def test_blocks_match_line_by_line(spark):
    all_texts = [*texts(3000), "", None, "x" * 70000]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(all_texts)], "id int, content string, block_no int")
    got = {(r["id"], r["block_no"]) for r in find_large_blocks(df, ["id"], "content", 10).collect()}
    assert got == {(i, k + 1) for i, t in enumerate(all_texts) for k, n in enumerate(blocks(t or "")) if n > 10}
    assert find_large_blocks(df.limit(0), ["id"], "content").count() == 0


@pytest.mark.parametrize("limit,overlap", [(20, 5), (50, 10), (2000, 100)])
def test_pieces_are_whole_and_bounded(limit, overlap):
    for t in [*texts(400), "a" * 5000, "語" * 4100, " ".join(["word"] * 3000)]:
        pieces = split_text(t, limit, overlap)
        assert "".join(t[new:end] for _, new, end, _ in pieces) == t
        for i, (start, new, end, _) in enumerate(pieces):
            assert end - start <= limit and end > new
            assert start == (max(0, new - overlap) if i else 0)


def test_pieces_prefer_headings():
    t = "# A\n" + "one two. " * 100 + "\n\n# B\n" + "three. " * 100
    p = split_text(t, 1000, 50)
    assert t[p[1][1] :].startswith("# B") and p[1][3] == "B"


def test_split_items(spark):
    df = spark.createDataFrame([("a", "Crumb", "x. " * 900, 1), ("b", None, "short", 2), ("c", "", None, 3)], "id string, breadcrumb string, content string, piece int")
    rows = split_items(df, ["id"], "content", "breadcrumb").collect()
    assert {r["id"] for r in rows} == {"a"} and all(r["breadcrumb"] == "Crumb" for r in rows)
    assert sorted(r["piece_no"] for r in rows) == [0, 1]


AWKWARD = ["", None, " " * 70 + "```\nx\n" + " " * 70 + "\n# h\n```\nend. of it", "x" * 400, "a\r\n" * 60, "\u00a0" * 60 + "\n\u00a0x", "# " + "t" * 90 + "\n" + "y. " * 50, "\r" * 30 + "\n" * 9, "\U0001f600" * 80]


@pytest.mark.parametrize("range_bytes,per_task,limit,overlap", [(16, 3, 20, 5), (64, 1024, 50, 10)])
def test_ranges_of_rows_change_nothing(spark, monkeypatch, range_bytes, per_task, limit, overlap):
    monkeypatch.setattr(splitting, "SUPER", per_task)
    rows = [(i if i % 7 else None, "Crumb" if i % 2 else " ", t, 3) for i, t in enumerate([*texts(30, 60), *AWKWARD])]
    df = spark.createDataFrame(rows, "id int, crumb string, content string, block_no int")
    want = Counter((rows[i][0], k + 1) for i in range(len(rows)) for k, n in enumerate(blocks(rows[i][2] or "")) if n > limit)
    assert Counter((r["id"], r["block_no"]) for r in find_large_blocks(df, ["id"], "content", limit, range_bytes).collect()) == want
    whole, cut = (Counter(map(tuple, split_items(df, ["id"], "content", "crumb", limit, overlap, **more).collect())) for more in ({}, {"range_bytes": range_bytes}))
    assert cut == whole


@pytest.mark.parametrize("range_bytes,per_task", [(16, 3), (100000, 3)])
def test_files_by_ranges(spark, tmp_path, monkeypatch, range_bytes, per_task):
    monkeypatch.setattr(splitting, "SUPER", per_task)
    paths, want, pieces = [], set(), set()
    for i, t in enumerate([*texts(5, 120), *filter(None, AWKWARD)]):
        path = tmp_path / f"{i}.md"
        path.write_bytes(t.encode())
        paths.append(f"file:{path}")
        want |= {(f"file:{path}", k + 1, n) for k, n in enumerate(blocks(t)) if n > 10}
        pieces |= {(f"file:{path}", no, s, n, e, head, t[s:e]) for no, (s, n, e, head) in enumerate(split_text(t, 20, 5))}
    got = {(r["path"], r["block_no"], r["points"]) for r in large_blocks_of_files(spark, paths, 10, range_bytes).collect()}
    assert got == want
    got = {(r["path"], r["piece_no"], r["start"], r["new"], r["end"], r["heading"] or "", r["piece"]) for r in pieces_of_files(spark, paths, 20, 5, range_bytes).collect()}
    assert got == pieces


def test_a_file_of_one_line_is_read_by_ranges(spark, tmp_path):
    path = tmp_path / "line.txt"
    path.write_text("word " * 60_000)
    ranges = splitting.ranges_of_files(spark, [str(path)], 10_000, 200, 20).collect()
    assert len(ranges) == 30 and max(len(r["data"]) for r in ranges) <= 10_000 + sum(splitting._halo(200, 20))
    got = sorted(pieces_of_files(spark, [str(path)], 200, 20, 10_000).collect(), key=lambda r: r["piece_no"])
    assert [(r["start"], r["new"], r["end"]) for r in got] == [p[:3] for p in split_text("word " * 60_000, 200, 20)]
    assert large_blocks_of_files(spark, [str(path)], 2000, 10_000).first()["points"] == 300_000
