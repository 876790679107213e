import datetime as dt

import pytest
from talweg.functions.common import station_id, whole_number
from talweg.operators.references import count_by_period, reference_states

T = [dt.datetime(2024, m, 5) for m in range(1, 7)]


def states(spark, refs, parents, match):
    r = spark.createDataFrame([(*x, 0) for x in refs], "id int, a long, b string, t timestamp, ref_state string, gone int")
    p = spark.createDataFrame(parents, "pa long, b string, t timestamp, gone boolean")
    got = reference_states(r, p, {"a": "pa", "b": "b"}, match, "t", "t", "gone")
    assert got.columns == ["id", "a", "b", "t", "gone", "ref_state"]
    return sorted((x["id"], x["ref_state"]) for x in got.collect())


REFS = [(1, 1, "x", T[3], None), (2, 1, "y", T[3], "k"), (3, 1, None, T[3], None), (4, 9, None, T[3], None), (5, None, None, T[3], None), (6, 2, "x", T[0], None), (7, 3, "x", None, None), (7, 3, "x", None, None), (8, 4, "z", T[0], None), (8, 5, "z", T[0], None)]
PARENTS = [(1, "x", T[0], False), (2, "x", T[1], None), (2, "x", T[2], False), (3, "x", T[5], True), (None, "y", T[0], False), (4, "z", T[5], False), (4, "z", T[0], True)]


@pytest.mark.parametrize(
    "match, extra",
    [("simple", []), ("partial", [(4, "missing")]), ("full", [(3, "mixed"), (4, "mixed")])],
)
def test_match_semantics(spark, match, extra):
    common = [(2, "missing"), (6, "late"), (7, "deleted"), (7, "deleted"), (8, "missing")]
    assert states(spark, REFS, PARENTS, match) == sorted(common + extra)


def test_empty_tables(spark):
    assert states(spark, [], PARENTS, "simple") == []
    assert len(states(spark, REFS, [], "simple")) == 7


def test_counts_by_month(spark):
    df = spark.createDataFrame([("g", T[0], "late"), ("g", T[0], "late"), ("g", T[1], "missing"), ("g", None, "late")], "tab string, t timestamp, ref_state string")
    got = {tuple(r) for r in count_by_period(df, "tab", "t").collect()}
    assert got == {("g", dt.date(2024, 1, 1), "late", 2), ("g", dt.date(2024, 2, 1), "missing", 1), ("g", None, "late", 1)}


def test_number_and_station_notations(spark):
    texts = ["110068380", " 110000135 ", "110,105,190", "110000087.0", "1.10000031E8", "0", "-4", "n/a", "", None, "unknown", "1,23", "1.5", "nan", "1e400", "+7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(whole_number("t")).collect()]
    assert got == [110068380, 110000135, 110105190, 110000087, 110000031, 0, -4, None, None, None, None, None, None, None, None, 7]
    ids = ["563500", " 00563500", "USGS-00563500", "usgs:563500", "USGS__00563500", "900007846390689", " ", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in ids], "t string").select(station_id("t")).collect()]
    assert got == ["00563500"] * 5 + ["900007846390689", None, None]
