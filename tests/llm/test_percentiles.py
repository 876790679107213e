import random

import numpy as np
import pytest
from talweg.llm.percentiles import bin_counts, group_percentiles, percentiles_of_bins

PROBS = [0.0, 0.1, 0.5, 0.9, 1.0]


def data(seed):
    rnd = random.Random(seed)
    rows = [("hot", "k", rnd.gauss(0, 1)) for _ in range(3000)] + [("hot", None, rnd.lognormvariate(0, 2)) for _ in range(1000)]
    rows += [("ties", "k", float(rnd.randrange(3))) for _ in range(900)] + [("same", "k", 7.0)] * 500 + [("one", "k", -2.5), ("two", "k", 1.0), ("two", "k", 2.0)]
    rows += [("dirty", "k", None), ("dirty", "k", float("nan")), ("dirty", "k", float("inf")), ("dirty2", "k", float("-inf")), ("dirty2", "k", 3.0), (None, None, 4.0), (None, None, 5.0)]
    return rows


@pytest.mark.parametrize("finish", [1, 64, 100_000])
def test_exact_in_every_group(spark, finish):
    rows = data(1)
    df = spark.createDataFrame([(*r, 1) for r in rows], "a string, b string, value double, n int").repartition(5)
    got = {(r.a, r.b): (r.n, r.quantiles) for r in group_percentiles(df, ["a", "b"], "value", PROBS, finish).collect()}
    want = {}
    for a, b, v in rows:
        if v is not None and np.isfinite(v):
            want.setdefault((a, b), []).append(v)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][0] == len(v)
        assert got[k][1] == pytest.approx(np.quantile(v, PROBS), rel=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([], "a string, value double")
    assert group_percentiles(df, ["a"], "value", [0.5]).count() == 0
    assert percentiles_of_bins(bin_counts(df, ["a"], "value"), ["a"], [0.5]).count() == 0


def test_summaries_of_days_combine(spark):
    rnd = random.Random(2)
    rows = [("g", d, rnd.choice([0.0, rnd.lognormvariate(1, 3), -rnd.lognormvariate(0, 1)])) for d in range(5) for _ in range(400)] + [("g", 1, None), ("z", 1, float("nan"))]
    df = spark.createDataFrame(rows, "a string, day int, value double")
    (r,) = percentiles_of_bins(bin_counts(df, ["a", "day"], "value"), ["a"], PROBS).collect()
    v = sorted(x for _, _, x in rows if x is not None and x == x)
    assert r.n == len(v)
    for p, q in zip(PROBS, r.quantiles):
        near = v[int((len(v) - 1) * p)], v[-int(-(len(v) - 1) * p // 1)]
        assert q == pytest.approx(np.quantile(v, p), abs=0.0101 * max(map(abs, near)))
