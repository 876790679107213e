import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from talweg.functions.recurrence import Network, route
from talweg.plans import workflow as wf
from talweg.streaming import flows


def test_config():
    assert wf.Config.load({"mode": "testing", "batch_size": 64, "testing": {"batch_size": 15, "rho": None}}).batch_size == 15
    for bad in ({"x": 1}, {"tau": 24}, {"start": "2011-01-01", "end": "2010-01-01"}, {"rho": 5, "warmup": 4}, {"workflow": "eval"}):
        with pytest.raises(ValueError):
            wf.Config.load(bad)


def test_plan_locks_and_runs(spark, tmp_path):
    src = tmp_path / "src.csv"
    src.write_text("a")
    c = wf.Config(sources={"s": str(src)})
    lock = wf.plan(c)["lock"]
    assert wf.plan(c, lock)["drift"] == {}
    src.write_text("b!")
    assert wf.plan(c, lock)["drift"] == {"s": "changed"}
    with pytest.raises(ValueError):
        wf.plan(c, lock, strict=True)
    assert wf.lock_differences({"a": {"sha256": 1}}, {"b": {"sha256": 1}}) == {"a": "removed", "b": "added"}
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    key = wf.cache_key("v1", lock, c)
    assert wf.resolve_or_build(spark, f"file://{tmp_path}/cache", key, build)[1] is False
    df, hit = wf.resolve_or_build(spark, f"file://{tmp_path}/cache", key, build)
    assert hit and df.count() == 3 and len(calls) == 1
    for i in range(4):
        wf.run(c, lambda _: {"nse": 1}, str(tmp_path / "runs"), f"r{i}")
    with pytest.raises(ZeroDivisionError):
        wf.run(c, lambda _: 1 / 0, str(tmp_path / "runs"), "r9")
    assert wf.gc(str(tmp_path / "runs")) == []
    assert wf.gc(str(tmp_path / "runs"), keep=2) == ["r2", "r1", "r0"]
    assert wf.status(str(tmp_path / "runs")) == ["r9", "r3"]


def test_routing_stream_equals_one_run(spark, tmp_path):
    net = pd.DataFrame({"basin": [1, 1, 1, 2], "comid": [1, 2, 3, 7], "parent": [None, 1, 1, None], "length_m": [3000.0, 2000.0, 5000.0, 900.0], "slope": [0.01, 0.002, 0.01, 0.005]})
    table = spark.createDataFrame([(1, 1, None, 3000.0, 0.01), (1, 2, 1, 2000.0, 0.002), (1, 3, 1, 5000.0, 0.01), (2, 7, None, 900.0, 0.005)], "basin long, comid long, parent long, length_m double, slope double")
    rng = np.random.default_rng(1)
    lateral = rng.uniform(0.1, 2, (9, 4))
    rows = [(int(net.basin[i]), int(net.comid[i]), t, float(lateral[t, i])) for t in range(9) for i in range(4)]
    schema = "basin long, comid long, t int, q_lateral double"
    for k, (a, b) in enumerate([(0, 4), (4, 5), (5, 9)]):
        spark.createDataFrame([r for r in rows if a <= r[2] < b], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = {(r.comid, r.t): r.q for r in flows.run_to_end(spark, flows.route_stream(stream, table)).collect()}
    whole = np.stack([q.value for q in route(Network(np.array([-1, 0, 0, -1])), lateral, {"n": 0.05, "q_spatial": 0.5, "p_spatial": 21.0}, net.length_m.to_numpy(), net.slope.to_numpy())])
    assert len(got) == 36
    for t in range(9):
        for i in range(4):
            assert got[int(net.comid[i]), t] == pytest.approx(whole[t, i], rel=1e-12)


def test_daily_pools_and_sessions(spark, tmp_path):
    df = spark.range(0, 24 * 5).select(F.lit(1).alias("id"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id AS int))").alias("ts"), F.col("id").cast("double").alias("v")).filter("hour(ts) <> 3")
    df.write.parquet(str(tmp_path / "h"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "h"))
    got = flows.run_to_end(spark, flows.pool_days_stream(stream(), "id", "ts", "v", tau=9)).orderBy("start").collect()
    assert [(r.start.hour, r.hours) for r in got][:3] == [(9, 8), (9, 23), (9, 23)]
    gaps = flows.run_to_end(spark, flows.sessions_stream(stream(), "id", "ts", gap="90 minutes"), "complete")
    assert sorted(r.n for r in gaps.collect()) == [3, 20, 23, 23, 23, 23]


def test_yaml_configs_and_groups(tmp_path):
    assert wf.parse_yaml("a: 1\nb:\n  c: [1, 2.5, x]\n  d:\n    e: 'y: z'\nf: # none\ng: true\n") == {"a": 1, "b": {"c": [1, 2.5, "x"], "d": {"e": "y: z"}}, "f": None, "g": True}
    for bad in ("a", "a: 1\na: 2", "a:\n\tb: 1"):
        with pytest.raises(ValueError):
            wf.parse_yaml(bad)
    (tmp_path / "s").write_text("x")
    groups = wf.Groups(str(tmp_path / "space"))
    groups.save("one", {"s": str(tmp_path / "s")})
    for call in (lambda: groups.use("two"), lambda: groups.save("two", {"s": str(tmp_path / "gone")}), lambda: wf.show(str(tmp_path), "r1")):
        with pytest.raises(ValueError):
            call()
    assert groups.list() == [("one", False, 1)]
