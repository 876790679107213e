"""Ranks and order statistics against sorted lists, over several ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from talweg.functions.ranks import interpolated, nearest, order_statistics, row_ranks, upper_middle, value_ranks
from talweg.operators.scores import spearman, spearman_of_all


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(2)
    data = [("hot", rnd.choice([float(rnd.randrange(30)), rnd.random()])) for _ in range(3000)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None), ("hot", None)]
    rnd.shuffle(data)
    return data, spark.createDataFrame(data, "g string, x double")


def test_order_statistics(rows):
    data, df = rows
    at = {"q1": interpolated(0.25), "q9": interpolated(0.9), "near": nearest(0.4), "upper": upper_middle}
    got = {r.g: r for r in order_statistics(df, ["g"], "x", at).collect()}
    assert set(got) == {"hot", "one", "two"}
    for g, r in got.items():
        v = sorted(x for k, x in data if k == g and x is not None)
        n = len(v)
        assert r.n == n and r.q1 == pytest.approx(np.quantile(v, 0.25)) and r.q9 == pytest.approx(np.quantile(v, 0.9))
        assert r.near == v[int((n - 1) * 0.4 + 0.5)] and r.upper == v[n // 2]
    (whole,) = order_statistics(df, [], "x", at).collect()
    assert whole.q9 == pytest.approx(np.quantile([x for _, x in data if x is not None], 0.9))
    assert order_statistics(df.limit(0), ["g"], "x", at).count() == 0


def test_ranks(rows):
    data, df = rows
    got = [r for r in row_ranks(df, ["g", "x"]).collect()]
    assert sorted(r["rank"] for r in got) == list(range(len(data)))
    assert [(r.g, r.x) for r in sorted(got, key=lambda r: r["rank"])] == sorted(data, key=lambda r: (r[0], -1.0 if r[1] is None else r[1]))
    hot = sorted(x for k, x in data if k == "hot" and x is not None)
    for r in value_ranks(df, ["g"], "x").filter("g = 'hot'").collect():
        assert (r["before"], r["count"]) == (sum(y < r.x for y in hot), hot.count(r.x))


def test_rank_correlation_of_a_whole_table(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(float(rnd.randrange(20)), float(rnd.randrange(20))) for _ in range(300)] + [(1.0, None)], "a double, b double")
    want = spearman(df.filter("b is not null").withColumn("k", F.lit(1)), "a", "b", ["k"]).first()
    got = spearman_of_all(df, "a", "b").first()
    assert got.rho == pytest.approx(want.rho) and got.n == want.n == 300
