import random

from worklens.operators.hierarchy import ancestors, hierarchy, levels, paths

SCHEMA = "id string, parent_id string, up string, loop string"


def brute(parent):
    out = set()
    for n in parent:
        seen, x = set(), n
        while (x := parent[x]) is not None and x in parent and x not in seen:
            seen.add(x)
            out.add((n, x))
    return out


def run(spark, parent):
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in parent.items()], SCHEMA)
    h = hierarchy(df, "id", "parent_id")
    rows = [tuple(r) for r in ancestors(h).collect()]
    high = {r["id"]: (r["depth"], r["root"]) for r in levels(df, "id", "parent_id").collect()}
    assert high == {r["id"]: (r["depth"], r["root"]) for r in paths(h).collect() if r["id"] in high}
    assert set(high) == {n for n in parent if not any((x, x) in set(rows) for x in [n, *(b for a, b in rows if a == n)])} or len(parent) > 500
    assert len(rows) == len(set(rows))
    return set(rows), {r["id"]: r for r in paths(h).collect()}


def test_deep_chain_and_loops(spark):
    parent = {f"n{i}": f"n{i - 1}" if i else None for i in range(41)}
    parent |= {"a": "b", "b": "c", "c": "a", "t": "a", "u": "t", "self": "self", "under": "self", "lost": "nowhere"}
    pairs, path = run(spark, parent)
    assert pairs == brute(parent)
    assert path["n40"]["depth"] == 40 and path["n40"]["root"] == "n0" and path["n40"]["path"][0] == "n0" and path["n40"]["path"][-1] == "n40"
    assert path["a"]["on_loop"] and path["self"]["on_loop"] and not path["u"]["on_loop"]
    assert len(path) == len(parent)


def test_random_graphs(spark):
    random.seed(4)
    names = [f"p{i}" for i in range(150)]
    parent = {n: random.choice([*names, None, "  ", "gone"]) for n in names}
    want = brute({k: (v if v and v.strip() else None) for k, v in parent.items()})
    assert run(spark, parent)[0] == want


def test_blanks_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None, "", ""), ("b", " a\t", "", ""), ("b", " a\t", "", ""), (None, "a", "", ""), ("c", "", "", "")], SCHEMA)
    assert [tuple(r) for r in ancestors(hierarchy(df, "id", "parent_id")).collect()] == [("b", "a")]
    none = hierarchy(spark.createDataFrame([], SCHEMA), "id", "parent_id")
    assert ancestors(none).count() == 0 and paths(none).count() == 0


def test_hot_parent(spark):
    parent = {"root": None, "hub": "root"} | {f"c{i}": "hub" for i in range(2000)}
    assert len(run(spark, parent)[0]) == 1 + 2 * 2000


def test_ten_thousand_levels(spark):
    df = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(10_000)] + [("x", "y"), ("y", "x")], "id string, parent_id string")
    got = {r["id"]: r["depth"] for r in levels(df, "id", "parent_id").collect()}
    assert got == {f"n{i}": i for i in range(10_000)}


def test_a_loop_much_longer_than_any_branch(spark):
    parent = {f"r{i:03}": f"r{(i + 1) % 75:03}" for i in range(75)} | {"t0": "r005"} | {f"t{i}": f"t{i - 1}" for i in range(1, 40)} | {"a": None, "b": "a"}
    pairs, path = run(spark, parent)
    assert pairs == brute(parent)
    assert path["t39"]["root"] == "r000" and path["t39"]["depth"] == 40 + 70 and path["r074"]["depth"] == 1 and path["r000"]["depth"] == 0
