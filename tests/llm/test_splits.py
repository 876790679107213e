import random

from talweg.llm.splits import assign_splits, balance, components, divided, split_name, with_entity


def brute(links):
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in links:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            p, q = find(a), find(b)
            par[max(p, q)] = min(p, q)
    return {x: find(x) for x in par}


def test_components_of_chain_star_and_random_graph(spark):
    rnd = random.Random(1)
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("s000", f"s{i:03}") for i in range(1, 200)]
    links += [(f"r{rnd.randrange(80)}", f"r{rnd.randrange(80)}") for _ in range(60)] + [("x", "x"), ("y", None), (None, "z"), (None, None)] + [("c003", "c004")]
    rnd.shuffle(links)
    df = spark.createDataFrame([(*x, "l") for x in links], "p string, q string, label string")
    got = {r.entity: r.label for r in components(df, "p", "q").collect()}
    assert got == brute(links)
    assert components(df.limit(0), "p", "q").count() == 0


def test_divided(spark):
    m = spark.createDataFrame([(7, "a", "Training"), (7, "b", "test"), (42, "a", "val"), (42, "b", "VALID "), (7, "c", "x"), (7, "c", "train"), (7, None, "train"), (7, "d", None)], "seed long, st string, split string")
    labels = spark.createDataFrame([("a", "A"), ("b", "A")], "entity string, label string")
    named = with_entity(m.withColumn("split", split_name("split")), "st", labels)
    assert {tuple(r) for r in divided(named, "entity", "split", ["seed"]).collect()} == {(7, "A")}


def test_assignment_keeps_groups_whole_and_shares(spark):
    rnd = random.Random(3)
    rows = []
    for g in range(1500):
        for _ in range(1 + min(int(rnd.paretovariate(1.2)), 60)):
            rows.append((f"g{g}", rnd.choice("aab") if g % 2 else "c", 1))
    rows += [("big", "a", 1)] * 700 + [(None, "a", 1), ("g1", None, 1)]
    df = spark.createDataFrame(rows, "grp string, kind string, split int").drop("split")
    shares = {"train": 0.7, "val": 0.1, "test": 0.2}
    out = assign_splits(df, "grp", "kind", shares)
    got = out.collect()
    assert len(got) == len({r.grp for r in got}) == 1501
    assert {tuple(r) for r in got} == {tuple(r) for r in assign_splits(df, "grp", "kind", shares).collect()}
    for r in balance(df.join(out, "grp"), "kind", "split").collect():
        if r.kind and r.n > 50:
            assert abs(r.share - shares[r.split]) < 0.05
    for r in balance(df.join(assign_splits(df, "grp", "kind", shares, batch_rows=40), "grp"), "kind", "split").collect():
        if r.kind and r.n > 50:
            assert abs(r.share - shares[r.split]) < 0.05
    assert assign_splits(df.limit(0), "grp", "kind", shares).count() == 0


def test_labels_of_small_groups_are_balanced(spark):
    """A label that no group has most of still gets its shares."""
    rows = [(g, k) for g in range(600) for k in ["a", "a", "a", *(["rare"] if g % 10 == 0 else [])]]
    df = spark.createDataFrame(rows, "grp long, kind string")
    out = assign_splits(df, "grp", "kind", {"train": 0.5, "test": 0.5})
    got = {(r.kind, r.split): r.n for r in balance(df.join(out, "grp"), "kind", "split").collect()}
    assert got["rare", "train"] == got["rare", "test"] == 30 and abs(got["a", "train"] - got["a", "test"]) <= 3


def test_components_by_salted_joins(spark):
    links = [("a", "b"), ("b", "c"), ("x", "y"), (None, "z")] + [("hub", f"n{i}") for i in range(50)]
    df = spark.createDataFrame(links, "p string, q string")
    assert {r.entity: r.label for r in components(df, "p", "q", limit_rows=0).collect()} == brute(links)
