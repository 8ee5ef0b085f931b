"""Registration, statistics, pivots, refresh, streaming and what-if."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from gridloom.operators import columnar as C
from gridloom.operators import worksheet_pivot as P
from gridloom.plans import catalog, whatif
from gridloom.streaming import refresh as R

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_all_queries_have_names_and_most_have_sql():
    q, sql = catalog.queries(), catalog.oracle_sql()
    assert len(q) > 120 and set(sql) <= set(q) and set(q) - set(sql) <= {"stat_isolation_forest"}


def test_nothing_outside_llm_imports_it():
    out = subprocess.run([sys.executable, "-c", "import sys; sys.modules['gridloom.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) == len(catalog.queries()), out.stderr


def test_statistics(spark):
    df = spark.createDataFrame([(x,) for x in ("1", "2", "2", "nope", None, "4")], "v string")
    r = C.describe_range(df, "v").first()
    assert (r["count"], r["sum"], r["q1"], r["median"]) == (4, 9.0, 1.75, 2.0)
    n = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (100.0,)], "v double")
    assert [r["v"] for r in C.zscore(n, "v", 1.4).collect()] == [100.0] and [r["v"] for r in C.iqr(n, "v").collect()] == [100.0]
    scored = sorted((r["score"], r["v"]) for r in C.isolation_forest(n, "v").collect())
    assert scored[-1][1] == 100.0
    h = C.histogram(spark.createDataFrame([(x,) for x in (-5.0, 0.5, 9.9, float("nan"), float("inf"))], "v double"), "v", 0, 10, 2)
    assert sorted(map(tuple, h.collect())) == [(0, 2), (1, 2)]
    s = C.worksheet_sort(spark.createDataFrame([(x,) for x in ("true", "#DIV/0!", "a", "2", None, "10", "B")], "v string"), [("v", False)])
    assert [r[0] for r in s.collect()] == ["2", "10", "a", "B", "true", "#DIV/0!", None]


@pytest.mark.parametrize("key", [None, ["i"]])
def test_isolation_forest_samples_rows_not_values(spark, key):
    values = spark.range(100).select(F.col("id").cast("double").alias("v"))
    hot = values.orderBy(F.xxhash64("v")).first()["v"]
    data = [(i, hot) for i in range(2500)] + [(2500 + i, float(i % 100)) for i in range(2500)] + [(5000, 1000.0)]
    got = {r["v"]: r["score"] for r in C.isolation_forest(spark.createDataFrame(data, "i long, v double"), "v", key=key).collect()}
    assert got[hot] == min(got.values()) < got[1000.0] and len(set(got.values())) > 20


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "k int, v string, t int")
    delta = spark.createDataFrame([(2, "B", 1, False), (2, "BB", 2, False), (3, None, 1, True), (4, "d", 1, False)], "k int, v string, t int, gone boolean")
    assert sorted((r["k"], r["v"]) for r in C.upsert(base, delta, ["k"], "t", "gone").collect()) == [(1, "a"), (2, "BB"), (4, "d")]


def test_worksheet_pivot(spark):
    df = spark.createDataFrame([("E", "A", 1.0), ("E", "B", 3.0), ("W", "A", 4.0)], "r string, p string, v double")
    out = P.pivot(df, P.PivotConfig(["r"], ["p"], [P.Value("v", "sum", "s"), P.Value("v", "product", "x")], calculated_items=[("r", "Both", ["E", "W"])]))
    got = {(r["r"], r["p"]): r["s"] for r in out.collect()}
    assert got[("E", None)] == 4.0 and got[(None, None)] == 16.0 and got[("Both", "A")] == 5.0
    assert [r[0] for r in P.slicer_items(df.withColumn("o", F.monotonically_increasing_id()), "p", "o").collect()] == ["A", "B"]


def test_cron():
    c = R.Cron.parse("*/15 9-17 * * 1-5")
    assert c.next_after(dt.datetime(2024, 3, 1, 17, 50)) == dt.datetime(2024, 3, 4, 9, 0)
    either = R.Cron.parse("0 0 13 * 5")
    assert either.next_after(dt.datetime(2024, 9, 10)) == dt.datetime(2024, 9, 13) and either.next_after(dt.datetime(2024, 9, 13)) == dt.datetime(2024, 9, 20)
    assert R.Cron.parse("0 0 29 2 *").next_after(dt.datetime(2025, 1, 1)) == dt.datetime(2028, 2, 29) and R.Cron.parse("0 0 * * 7").weekdays == frozenset({0})
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            R.Cron.parse(bad)


def test_refresh_order_and_cache(spark, tmp_path):
    assert R.refresh_order({"a": ["b", "c"], "b": ["c"], "c": []}) == ["c", "b", "a"]
    with pytest.raises(ValueError):
        R.refresh_order({"a": ["b"], "b": ["a"]})
    made, now = [], [0.0]
    cache = R.ResultCache(str(tmp_path), ttl=10, most=1, clock=lambda: now[0])
    get = lambda k, s: cache.get(spark, k, s, lambda: made.append(k) or spark.range(3)).count()
    assert get("a", "1") == 3 and get("a", "1") == 3 and made == ["a"]
    now[0] = 11
    get("a", "1")
    now[0] = 12
    get("a", "2")
    assert made == ["a"] * 3 and len(cache.entries) == 1


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, i), "ab"[i % 2], i % 3, float(i)) for i in range(50)], "event_id long, ts timestamp, event_type string, user_id long, value double")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = R.tumbling(stream, "10 minutes", lateness="1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, R.tumbling(events, "10 minutes").collect()))
    R.incremental(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["user_id"], "event_id", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out/v000000000000").collect()) == [47, 48, 49]
    assert R.sessions(events, "5 minutes").count() == 3


def test_what_if(spark):
    assert whatif.goal_seek(lambda x: x * x, 9.0, 1.0) == pytest.approx(3.0)
    df = spark.createDataFrame([(2.0, 10.0)], "q double, p double")
    got = {r["scenario"]: r["rev"] for r in whatif.scenarios(df, {"base": {}, "up": {"p": "p * 2"}}, {"rev": "sum(q * p)"}).collect()}
    assert got == {"base": 20.0, "up": 40.0}
    mc = whatif.monte_carlo(spark, 4000, {"a": {"kind": "normal", "mean": 10, "sd": 2}, "b": {"kind": "uniform", "low": 0, "high": 1}, "c": {"kind": "triangular", "low": 0, "mode": 1, "high": 2}, "d": {"kind": "poisson", "mean": 3}}, [[1, 0.8, 0, 0], [0.8, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    r = mc.agg(F.avg("a"), F.avg("b"), F.avg("c"), F.avg("d"), F.corr("a", "b")).first()
    assert [r[0], r[1], r[2], r[3]] == [pytest.approx(10, abs=0.2), pytest.approx(0.5, abs=0.03), pytest.approx(1, abs=0.05), pytest.approx(3, abs=0.15)] and r[4] > 0.7


def test_anomalies_by_score_and_by_number(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (2.0,), (100.0,), (None,)], "v double")
    found = [r["v"] for r in C.anomalies(df, "v", key=["v"]).collect()]
    assert found[:1] == [100.0] and None not in found
    assert [r["v"] for r in C.anomalies(df, "v", 1.5, key=["v"]).collect()] == [100.0] and C.anomalies(df, "v", 3, key=["v"]).count() == 3
    with pytest.raises(ValueError):
        C.anomalies(df, "v", 0)
