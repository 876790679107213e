import random

import pytest
from pyspark.sql import functions as F
from talweg.operators.spikes import implausible

SCHEMA = "row_id long, staid string, hours array<float>, daily float, source string"


def day(rnd, level, noise=0.01):
    return [round(level * (1 + rnd.gauss(0, noise)), 4) for _ in range(24)]


def rows():
    rnd = random.Random(2)
    out = []

    def add(i, st, h, daily="mean"):
        ok = [x for x in h if x is not None and 0 <= x < 4e5]
        out.append((i, st, h, sum(ok) / len(ok) if daily == "mean" else daily, "clash"))

    for d in range(40):
        add(d, "A", day(rnd, 20))
        add(100 + d, "B", [0.0] * 14 + [0.2] * 10 if d % 2 else [0.0] * 24, None if d % 2 == 0 else "mean")
        flood = [5.0 * 1.3**min(t, 12) * 0.9 ** max(0, t - 12) * (1 + rnd.gauss(0, 0.02)) for t in range(24)]
        add(200 + d, "C", flood)
        add(300 + d, "D", [(30.0 if 8 <= t < 16 else 3.0) * (1 + rnd.gauss(0, 0.02)) for t in range(24)])
    a = day(rnd, 20)
    for i, (at, n) in enumerate([(5, 1), (10, 2), (15, 3)]):
        h = list(a)
        h[at : at + n] = [60.0] * n
        add(1000 + i, "A", h)
    drop = list(a)
    drop[7] = 5.0
    add(1003, "A", drop)
    step = a[:12] + [x * 3 for x in a[12:]]
    add(1004, "A", step)
    add(1005, "A", a[:4] + [a[4]] * 10 + a[14:])
    add(1006, "A", a[:4] + [a[4]] * 9 + a[13:])
    for i, bad in enumerate([-999.0, 999999.0, float("nan"), float("inf"), None, -0.01]):
        add(1010 + i, "A", [*a[:23], bad])
    add(1020, "A", a, sum(a) / 24 * 1.02)
    add(1021, "A", a, sum(a) / 24 * 1.005)
    add(1022, "A", a, None)
    out.append((1023, "A", None, 3.0, None))
    out.append((1024, "A", [], 3.0, None))
    out.append((1025, None, a, None, None))
    out.append((1026, None, [*a[:23], -1.0], None, None))
    return out


def test_flags(spark):
    data = rows()
    df = spark.createDataFrame(data + [r for r in data if r[0] == 1000], SCHEMA)
    got = implausible(df, "staid", "row_id", "hours", "daily").collect()
    assert sum(r.row_id == 1000 for r in got) == 2
    assert {r.row_id: r.flags for r in got} == {
        1000: "spike", 1001: "spike", 1002: "spike", 1003: "spike", 1005: "stuck", 1020: "mean_off",
        **{1010 + i: "impossible" for i in range(6)}, 1026: "impossible",
    }


def test_empty(spark):
    assert implausible(spark.createDataFrame([], SCHEMA), "staid", "row_id", "hours", "daily").count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_a_source_without_a_normal_has_no_spikes(spark, n):
    df = spark.createDataFrame([(i, "x", [1.0] * 11 + [9.0] + [1.0] * 12, None, "") for i in range(n)], SCHEMA)
    assert implausible(df, "staid", "row_id", "hours", "daily").count() == 0


def test_a_source_goes_on_where_a_batch_was_cut():
    import numpy as np
    from talweg.operators.spikes import _Days

    rng = np.random.default_rng(4)
    n = 60
    source = np.array(["a"] * 30 + ["b"] * 30, dtype=object)
    day = np.r_[np.sort(rng.integers(0, 20, 30)), np.sort(rng.integers(0, 40, 30))]  # repeated and missing days
    segment = day // 16
    y = np.cumsum(rng.normal(0, 0.05, (n, 24)), axis=1) + rng.normal(0, 1, (n, 1))
    y[rng.random((n, 24)) < 0.03] += 3
    y[rng.random((n, 24)) < 0.05] = np.nan
    gain, deviation = np.full(n, 0.6), np.full(n, 0.08)
    whole = _Days(4.12, 3).judge(source, segment, day, y, gain, deviation)
    assert whole[0].any()
    for cuts in ([7, 8, 29, 30, 41], range(1, n)):
        days, parts = _Days(4.12, 3), np.split(np.arange(n), list(cuts))
        got = [days.judge(source[p], segment[p], day[p], y[p], gain[p], deviation[p]) for p in parts]
        assert (np.vstack([g[0] for g in got]) == whole[0]).all()
        assert np.array_equal(np.vstack([g[1] for g in got]), whole[1], equal_nan=True)


def test_the_level_is_known_from_the_day_before():
    import numpy as np
    from talweg.operators.spikes import LocalLevel

    f = LocalLevel(np.array([0.5]), np.array([0.1]), 4.0, 3)
    y = np.array([[0.0, 5.0, 5.0, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 2.0, 2.0, 9.0]])
    rows = np.arange(1)
    sign, _, level, variance = f.run(y, rows, np.array([np.nan]), np.zeros(1))
    assert sign.tolist() == [[0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 1]] and level[0] == pytest.approx(2.0)  # an excursion, a level that moved, a last reading withheld
    forecast, unknown = f.run(y[:, :1] + 2.1, rows, level, variance), f.run(y[:, :1] + 2.1, rows, np.array([np.nan]), np.zeros(1))
    assert 2.0 < forecast[2][0] < 2.1 and unknown[2][0] == pytest.approx(2.1)


def test_long_sources_and_rows_without_a_day(spark):
    """A spike is found in any segment of a long source, and in rows with no day."""
    rnd = random.Random(8)
    rows = [(d, "A", day(rnd, 20), None, d) for d in range(300)]
    for at in (0, 63, 64, 200):
        h = list(rows[at][2])
        h[6] = 80.0
        rows.append((1000 + at, "A", h, None, at))
    h = day(rnd, 20)
    h[9] = 90.0
    rows += [(2000, "A", h, None, None), (2001, None, h, None, 5)]
    df = spark.createDataFrame(rows, "row_id long, staid string, hours array<float>, daily float, day int")
    assert sorted(r.row_id for r in implausible(df, "staid", "row_id", "hours", "daily", "day").collect()) == [1000, 1063, 1064, 1200, 2000]
    dated = df.withColumn("segment", F.date_add(F.lit("2001-05-05").cast("date"), F.col("day"))).drop("day")
    assert sorted(r.row_id for r in implausible(dated, "staid", "row_id", "hours", "daily", "segment").collect()) == [1000, 1063, 1064, 1200, 2000]
