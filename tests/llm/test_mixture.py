import random

import numpy as np
import pytest
from talweg.llm.mixture import Timetable, mixture, token_counts


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(900):
        s = rnd.choice(["A", "A ", "a", "b", "B", "c"] if i % 9 else ["c"])
        rows.append((i, s, "river " * rnd.randrange(1, 40), "x"))
    rows += [(1000, "d", None, "x"), (1001, "d", "", "x"), (1002, None, "text", "x"), (1003, "unlisted", "text", "x"), (0, "a", "twice", "x")]
    return spark.createDataFrame(rows, "id long, source string, body string, tokens string")


def targets(spark):
    return spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.3, 2), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")


def test_shares_repeats_and_order(spark, docs):
    times = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 2.0), ("B ", 0.0, 1.5), ("b", 0.5, 1.5), ("b", 1.0, 0.5), ("a", 0.5, None), (None, 0.1, 1.0)], "source string, time double, weight double")
    mix, report = mixture(docs, "id", "source", "body", targets(spark), schedule=times)
    rows = mix.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert len({(r.doc_id, r["copy"], r.tokens) for r in rows}) == len(rows)
    rep = {r.source: r for r in report.collect()}
    for s, r in rep.items():
        assert abs(r.share - r.target_share) < 0.005
        assert r.repeats <= r.max_repeats
    late = sum(r.tokens for r in rows if r.source == "a" and r.position > 0.5) / sum(r.tokens for r in rows if r.source == "a")
    assert late > 0.6
    whole, run = sum(r.tokens for r in rows), 0
    for r in rows:  # a position is the share of the tokens before it
        assert abs(r.position - (run + r.tokens / 2) / whole) < 0.01
        run += r.tokens
    assert [tuple(r) for r in mixture(docs, "id", "source", "body", targets(spark), schedule=times)[0].collect()] == [tuple(r) for r in rows]


def test_times_against_numbers():
    table = Timetable({"a": 300, "b": 100}, {"a": [(0.2, 0.0), (0.6, 3.0), (0.8, 0.0)]})
    x = np.linspace(0, 1, 200_001)
    w = np.interp(x, [0.2, 0.6, 0.8], [0.0, 3.0, 0.0])
    cum = np.cumsum(w) / w.sum()
    share = np.array([0.01, 0.3, 0.5, 0.9, 0.99])
    when = np.interp(share, cum, x)
    assert table.when("a", share) == pytest.approx(when, abs=1e-4)
    assert table.position("a", share) == pytest.approx(0.75 * share + 0.25 * when, abs=1e-4)
    assert table.when("b", share) == pytest.approx(share)
    assert Timetable({"z": 5}, {"z": [(0.5, 0.0)]}).when("z", share) == pytest.approx(share)
    with pytest.raises(ValueError):
        Timetable({"a": 1}, {"a": [(0.0, -1.0)]})


def test_a_larger_total_falls_short_where_repeats_end(spark, docs):
    _, report = mixture(docs, "id", "source", "body", targets(spark), total=10_000_000)
    assert all(r.repeats == r.max_repeats and r.tokens == r.max_repeats * r.source_tokens for r in report.collect() if r.target_share > 0)


def test_empty(spark, docs):
    mix, report = mixture(docs.limit(0), "id", "source", "body", targets(spark))
    assert mix.count() == 0
    assert {r.tokens for r in report.collect()} == {0}


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("a" * 100_000,)], "t string")
    n = [r.tokens for r in token_counts(df, "t").collect()]
    assert n[:3] == [2, 0, 0] and n[3] > 1 and n[4] > 1000
