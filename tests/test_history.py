import datetime as dt
import random

from worklens.operators.history import snapshot_history, versions

SCHEMA = "k string, at timestamp, id string, v string, b string, value string, __extra int"


def when(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def brute(rows):
    out, by, least = [], {}, {}
    for k, at, i, v, b in rows:
        least[k, at, v, b] = min(i, least.get((k, at, v, b), i))
    for (k, at, v, b), i in least.items():
        by.setdefault(k, []).append((at, i, v, b))
    for k, entries in by.items():
        entries.sort(key=lambda e: (e[0], e[1]))
        begun = [e for n, e in enumerate(entries) if e[2] != (entries[n - 1][2] if n else e[3])]
        for n, e in enumerate(begun):
            out.append((k, e[2], e[1], begun[n + 1][1] if n + 1 < len(begun) else None))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return sorted([(r["k"], r["value"], r["open_id"], r["close_id"]) for r in versions(df, ["k"], "at", "id", "v", before="b", **more).collect()], key=str)


def test_random_with_ties_nulls_and_runs(spark):
    random.seed(2)
    for run_rows in (1_000_000, 20, 3):
        rows = [(random.choice("aaaab"), when(random.randint(0, 60)), f"{i:03}", random.choice(["x", "y", None]), random.choice(["x", "y", None])) for i in range(150)]
        assert run(spark, rows, run_rows=run_rows) == brute(rows)


def test_unplaceable_and_empty(spark):
    rows = [("a", None, "1", "x", None), (None, when(0), "2", "x", None), ("a", when(0), None, "x", None)]
    assert run(spark, rows) == []
    assert run(spark, []) == []


def test_first_entry_that_changes_nothing(spark):
    rows = [("a", when(0), "1", "x", "x"), ("a", when(1), "2", "x", "q"), ("a", when(2), "3", "y", "x")]
    assert run(spark, rows) == [("a", "y", "3", None)]


def test_snapshots(spark):
    df = spark.createDataFrame([("e", when(i), c, n) for i, (c, n) in enumerate([("r", 1), ("r", 1), ("r", None), ("g", None), ("r", 1)])], "e string, at timestamp, colour string, n int")
    got = sorted((r["valid_from"], r["valid_to"], r["colour"], r["n"]) for r in snapshot_history(df, ["e"], "at", ["colour", "n"]).where("valid_to is not null").collect())
    assert got == [(when(0), when(2), "r", 1), (when(2), when(3), "r", None), (when(3), when(4), "g", None)]
