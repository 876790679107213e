import random
from collections import defaultdict

import pytest
from talweg.operators.hierarchy import descendants, hierarchy


def brute(links):
    par = {}
    for a, b in links:
        if a is not None:
            par[a] = min([x for x in (par.get(a), b) if x is not None], default=None)
    par = {a: b if b in par else None for a, b in par.items()}
    out = {}
    for a in par:
        path, seen, v = [], set(), a
        while v is not None and v not in seen:
            seen.add(v)
            path.append(v)
            v = par[v]
        if v is None:
            out[a] = (path[-1], len(path) - 1, path)
        else:
            out[a] = (min(path[path.index(v) :]), -1, None)
    return out


def run(spark, links, finish):
    df = spark.createDataFrame([(a, b, "x") for a, b in links], "id long, parent long, root string")
    return {r["id"]: (r["root"], r["hops"], r["path"]) for r in hierarchy(df, "id", "parent", True, finish).collect()}


def hostile():
    rnd = random.Random(5)
    links = [(i, i - 1 if i % 50 else None) for i in range(1, 150)]  # chains
    links += [(200 + i, 200 + rnd.randrange(i)) for i in range(1, 80)] + [(200, 9999)]  # a tree under an unknown parent
    links += [(500 + i, 500 + (i + 1) % 7) for i in range(7)] + [(520 + i, 500 + i % 7 if i < 9 else 520 + i - 1) for i in range(20)]  # a loop and what is above it
    links += [(600, 600), (601, 600), (700, 701), (701, 700)]  # a node of its own, a loop of two
    links += [(800 + i, 800) for i in range(1, 60)] + [(800, None)]  # a hot parent
    return links + links[:30] + [(None, 3), (810, 801)]


@pytest.mark.parametrize("finish", [0, 40, 10_000])
def test_random_forest_with_loops_chain_and_star(spark, finish):
    assert run(spark, hostile(), finish) == brute(hostile())


@pytest.mark.parametrize("finish", [0, 40, 10_000])
def test_what_is_sent_up(spark, finish):
    """Sizes, heights and sums with and without coefficients against sums over the paths."""
    links = hostile()
    want = brute(links)
    value, coef = (lambda i: i % 7 + 0.5), (lambda i: 0.25 + i % 3 / 4)
    size, height, plain, scaled = defaultdict(int), defaultdict(int), defaultdict(float), defaultdict(float)
    gain = {}
    for a, (_, hops, path) in want.items():
        if hops < 0:
            continue
        g = 1.0
        for k, v in enumerate(path):
            g *= coef(v) if k else 1.0
            size[v], height[v], plain[v], scaled[v] = size[v] + 1, max(height[v], k), plain[v] + value(a), scaled[v] + g * value(a)
        gain[a] = g
    df = spark.createDataFrame([(a, b, None if a is None else value(a), None if a is None else coef(a)) for a, b in links], "id long, parent long, v double, c double")
    got = hierarchy(df, "id", "parent", finish_nodes=finish, sizes=True, sums={"plain": ("v", None), "scaled": ("v", "c")}).collect()
    assert {r["id"] for r in got} == set(want)
    for r in got:
        i = r["id"]
        assert (r["root"], r["hops"]) == want[i][:2]
        if r["hops"] < 0:
            assert r["size"] is r["height"] is r["plain"] is r["scaled"] is r["scaled_gain"] is None
        else:
            assert (r["size"], r["height"]) == (size[i], height[i])
            assert r["plain"] == pytest.approx(plain[i]) and r["scaled"] == pytest.approx(scaled[i]) and r["scaled_gain"] == pytest.approx(gain[i])


def test_paths_leave_in_pieces(spark, monkeypatch):
    from talweg.operators import hierarchy as h

    monkeypatch.setattr(h, "PIECE_IDS", 50)
    assert run(spark, hostile(), 10_000) == brute(hostile())


def test_empty_and_descendants(spark):
    assert run(spark, [], 10) == {}
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 3)], "id long, parent long")
    got = {tuple(r) for r in descendants(hierarchy(df, "id", "parent", True)).collect()}
    assert got == {(2, 1, 1), (3, 1, 2), (3, 2, 1), (3, 4, 1)}
    none = hierarchy(df.limit(0), "id", "parent", sizes=True, sums={"s": ("parent", None)})
    assert none.columns == ["id", "root", "hops", "size", "height", "s"] and none.count() == 0
