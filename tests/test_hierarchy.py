"""Hierarchies against a walk node by node, on both the packed and the distributed way."""

import random

import pytest

from arbora.operators.hierarchy import descendants, hierarchy

SCHEMA = "t string, n bigint, p bigint, lab string, tree string, node int, path string, cyclic string"


def walk(rows):
    """Brute force: {(tree, node): (depth, root, path, cycle_id)}."""
    nodes = {}
    for t, n, p, lab in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2] is not None and r[2] != 0, r[2] or 0, r[3] is not None, r[3] or "")):
        nodes.setdefault((t, n), (p if p else None, lab))
    out = {}
    for t, n in nodes:
        seen, at = [], n
        while at is not None and (t, at) in nodes and at not in seen:
            seen.append(at)
            at = nodes[t, at][0]
        if at is not None and (t, at) in nodes:
            out[t, n] = (None, None, None, min(seen[seen.index(at) :]))
        else:
            path = seen[::-1]
            out[t, n] = (len(path) - 1, path[0], path, None)
    return out


def rows_of(rng, trees, size):
    rows = []
    for t in range(trees):
        n = rng.randint(1, size)
        for i in range(1, n + 1):
            p = rng.choice([0, None, rng.randint(1, n + 2), i - 1, i - 1, i - 1])
            rows.append((f"t{t}", i, p, rng.choice(["a", "b", None])))
    return rows + rng.sample(rows, len(rows) // 5) + [(None, 1, 0, "x"), ("t0", None, 1, "x")]


@pytest.mark.parametrize("giant", [200_000, 3])
def test_against_walk(spark, giant):
    rng = random.Random(5)
    rows = rows_of(rng, 25, 12)
    df = spark.createDataFrame([(*r, "clash", 9, "clash", "clash") for r in rows], SCHEMA)
    want = walk(rows)
    got = {(r["tree"], r["node"]): r for r in hierarchy(df, "t", "n", "p", "lab", giant=giant).collect()}
    assert set(got) == set(want)
    kids = {}
    for k, (_, _, path, _) in want.items():
        for a in (path or [])[:-1]:
            kids[k[0], a] = kids.get((k[0], a), 0) + 1
    for k, (depth, root, path, cycle) in want.items():
        r = got[k]
        assert (r["depth"], r["root"], r["path"], r["cycle_id"], r["cyclic"]) == (depth, root, path, cycle, cycle is not None)
        assert r["n_descendants"] == (None if cycle is not None else kids.get(k, 0))
        assert cycle is not None or len(r["label_path"]) == len(path)
    found = {(r["tree"], r["node"]): r["cycle_id"] for r in hierarchy(df, "t", "n", "p", cycles_only=True, giant=giant).collect()}
    assert found == {k: v[3] for k, v in want.items() if v[3] is not None}


def test_descendants_and_long_chain(spark):
    n = 300
    df = spark.createDataFrame([("a", i, i - 1) for i in range(1, n + 1)], "t string, n bigint, p bigint")
    h = hierarchy(df, "t", "n", "p")
    assert h.agg({"depth": "max"}).first()[0] == n - 1
    d = descendants(h)
    assert d.count() == n * (n - 1) // 2
    assert d.where("descendant - ancestor <> distance").count() == 0


def test_empty_and_self_loop(spark):
    empty = spark.createDataFrame([], "t string, n bigint, p bigint")
    assert hierarchy(empty, "t", "n", "p").count() == 0
    loop = spark.createDataFrame([("a", 1, 1), ("a", 2, 1)], "t string, n bigint, p bigint")
    assert {(r["node"], r["cycle_id"]) for r in hierarchy(loop, "t", "n", "p").collect()} == {(1, 1), (2, 1)}


@pytest.mark.parametrize("cycles_only", [False, True])
def test_wide_giant_tree(spark, monkeypatch, cycles_only):
    """A star whose rows all point at its root, with a chain and a wide cycle, by joins with every key in pieces of ten rows."""
    from arbora.operators import joins

    monkeypatch.setattr(joins, "TOGETHER", 10)
    rows = [(1, 1, None)] + [(1, i, 1) for i in range(2, 300)] + [(1, i, i - 1) for i in range(300, 340)]
    rows += [(2, 1, 2), (2, 2, 1)] + [(2, i, 1 + i % 2) for i in range(3, 200)] + [(3, i, None) for i in range(1, 100)]
    df = spark.createDataFrame(rows, "t bigint, n bigint, p bigint")
    h = hierarchy(df, "t", "n", "p", giant=5, cycles_only=cycles_only)
    if cycles_only:
        assert sorted((r["tree"], r["node"], r["cycle_id"]) for r in h.collect()) == [(2, i, 1) for i in range(1, 200)]
        return
    got = {(r["tree"], r["node"]): r for r in h.collect()}
    assert len(got) == len(rows)
    assert got[1, 1]["n_descendants"] == 338 and got[1, 5]["path"] == [1, 5] and got[1, 339]["depth"] == 41 and got[1, 339]["root"] == 1
    assert all(got[3, i]["depth"] == 0 for i in range(1, 100)) and all(got[2, i]["cycle_id"] == 1 for i in range(1, 200))


def test_split_join(spark, monkeypatch):
    from arbora.operators.joins import split_join

    left = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3) for i in range(100)], "i bigint, k int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (None, "d"), (9, "e")], "k int, v string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, split_join(left, right, "k", "i", how=how, together=4).select("i", "k", "v").collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, "k", how).select("i", "k", "v").collect()), key=str)
