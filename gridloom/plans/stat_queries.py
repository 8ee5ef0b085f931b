"""Queries of columnar operators, worksheet pivots, statistics and event windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import columnar as C
from gridloom.operators import worksheet_pivot as P
from gridloom.plans.catalog import register, table
from gridloom.streaming import refresh as R


def _q(name, source, sql):
    """Register f(df) over one table."""

    def add(f):
        register(name, sql)(lambda spark, sf: f(table(spark, sf, source)))
        return f

    return add


@_q("col_filter_mask", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity > 25 AND l_returnflag = 'A' AS mask FROM lineitem")
def _mask(d):
    return C.filter_mask(d, (F.col("l_quantity") > 25) & (F.col("l_returnflag") == "A")).select("l_orderkey", "l_linenumber", "mask")


@_q("col_filter_ci", "customer", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def _ci(d):
    return d.where(F.lower("c_mktsegment") == "building").select("c_custkey")


@_q("col_group_by", "lineitem", "SELECT l_suppkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1")
def _group(d):
    return d.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))


@_q("col_group_by_mask", "lineitem", "SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def _group_mask(d):
    return C.group_by_mask(d, F.col("l_discount") > 0.05, ["l_suppkey"], [F.sum("l_quantity").alias("q")])


@_q("col_stats", "customer", "SELECT 'c_custkey' AS \"column\", count(DISTINCT c_custkey) AS \"distinct\", count(*) FILTER (c_custkey IS NULL) AS nulls, sum(c_custkey)::double AS sum FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(*) FILTER (c_mktsegment IS NULL), NULL FROM customer")
def _stats(d):
    return C.column_stats(d, ["c_custkey", "c_mktsegment"], exact=True).select("column", "distinct", "nulls", "sum")


@register("col_full_outer_join", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def _full(spark, sf):
    on = (F.col("c_custkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))
    return table(spark, sf, "customer").join(table(spark, sf, "supplier"), on, "full").select("c_custkey", "s_suppkey")


@_q("col_upsert", "customer", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT -1::bigint, 0.0::double")
def _upsert(d):
    base = d.select("c_custkey", "c_acctbal", F.lit(0).alias("v"))
    delta = base.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).withColumn("v", F.lit(1)).withColumn("gone", F.lit(False))
    gone = base.where("c_custkey % 5 = 0").withColumn("v", F.lit(2)).withColumn("gone", F.lit(True))
    new = d.sparkSession.createDataFrame([(-1, 0.0, 1, False)], "c_custkey long, c_acctbal double, v int, gone boolean")
    return C.upsert(base, delta.unionByName(gone).unionByName(new), ["c_custkey"], "v", "gone").select("c_custkey", "c_acctbal")


@_q("stat_histogram", "lineitem", "SELECT greatest(0, least(9, floor((l_extendedprice-1000)/(90000.0-1000)*10)))::int AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _hist(d):
    return C.histogram(d, "l_extendedprice", 1000.0, 90000.0, 10)


@_q("stat_describe", "orders", "SELECT o_orderstatus, count(o_totalprice) AS count, min(o_totalprice) AS min, max(o_totalprice) AS max, quantile_cont(o_totalprice,0.5) AS median, quantile_cont(o_totalprice,0.25) AS q1, quantile_cont(o_totalprice,0.75) AS q3, round(avg(o_totalprice),4) AS mean, round(stddev_samp(o_totalprice),4) AS stdev FROM orders GROUP BY 1")
def _describe(d):
    out = C.describe_range(d, "o_totalprice", ["o_orderstatus"])
    return out.select("o_orderstatus", "count", "min", "max", "median", "q1", "q3", F.round("mean", 4).alias("mean"), F.round("stdev", 4).alias("stdev"))


@_q("stat_zscore", "orders", "SELECT o_orderkey, round((o_totalprice-m)/s,6) AS z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) WHERE abs((o_totalprice-m)/s) >= 1.5")
def _z(d):
    return C.zscore(d, "o_totalprice", 1.5).select("o_orderkey", F.round("z", 6).alias("z"))


@_q("stat_iqr", "events", "SELECT event_id FROM events, (SELECT quantile_cont(value,0.25) AS a, quantile_cont(value,0.75) AS b FROM events) WHERE value < a - 0.3*(b-a) OR value > b + 0.3*(b-a)")
def _iqr(d):
    return C.iqr(d, "value", 0.3).select("event_id")


register("stat_isolation_forest")(lambda spark, sf: C.isolation_forest(table(spark, sf, "events"), "value", key=["event_id"]).select("event_id", "score"))


@_q("stat_correlation", "lineitem", "SELECT round(corr(l_quantity, l_extendedprice),8) AS correlation FROM lineitem")
def _corr(d):
    return C.correlation(d, "l_quantity", "l_extendedprice").select(F.round("correlation", 8).alias("correlation"))


@_q("stat_running", "orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING),2) AS running FROM orders")
def _running(d):
    return C.running(d, "o_totalprice", ["o_orderkey"], ["o_custkey"]).select("o_orderkey", F.round("running", 2).alias("running"))


@_q("stat_autofilter", "orders", "SELECT o_orderkey FROM orders WHERE (lower(o_orderstatus)='f' OR lower(o_orderstatus)='p') AND o_orderdate::date > DATE '1995-01-01' AND o_totalprice BETWEEN 10000 AND 200000")
def _auto(d):
    return C.auto_filter(d, {"o_orderstatus": {"criteria": [("equals", "F"), ("equals", "P")]}, "o_orderdate": {"criteria": [("after", "1995-01-01")]}, "o_totalprice": {"join": "all", "criteria": [("between", 10000, 200000)]}}).select("o_orderkey")


@_q("pivot_subtotals", "orders", "SELECT o_orderstatus, o_orderpriority, count(o_custkey) AS n, (bit_count(GROUPING(o_orderstatus,o_orderpriority)))::int AS __level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _sub(d):
    return P.pivot(d, P.PivotConfig(["o_orderstatus", "o_orderpriority"], values=[P.Value("o_custkey", "count", "n")]))


@_q("pivot_grand_totals", "lineitem", "SELECT l_returnflag, l_linestatus, max(l_quantity) AS hi, min(l_quantity) AS lo FROM lineitem GROUP BY GROUPING SETS ((l_returnflag,l_linestatus),())")
def _grand(d):
    return P.pivot(d, P.PivotConfig(["l_returnflag", "l_linestatus"], values=[P.Value("l_quantity", "max", "hi"), P.Value("l_quantity", "min", "lo")], subtotals=False)).drop("__level")


def _share(name, show, over, extra=None):
    sql = f"SELECT l_returnflag, l_linestatus, round(q/{over},8) AS q FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY 1,2)"

    @_q(name, "lineitem", sql)
    def run(d):
        v = P.Value("l_quantity", "sum", "q", show, **(extra or {}))
        return P.pivot(d, P.PivotConfig(["l_returnflag"], ["l_linestatus"], [v], subtotals=False, row_grand_totals=False)).select("l_returnflag", "l_linestatus", F.round("q", 8).alias("q"))


_share("pivot_pct_grand", "percentOfGrandTotal", "sum(q) OVER ()")
_share("pivot_pct_row", "percentOfRowTotal", "sum(q) OVER (PARTITION BY l_returnflag)")
_share("pivot_pct_col", "percentOfColumnTotal", "sum(q) OVER (PARTITION BY l_linestatus)")
_share("pivot_pct_of", "percentOf", "max(CASE WHEN l_linestatus='O' THEN q END) OVER (PARTITION BY l_returnflag)", {"base_field": "l_linestatus", "base_item": "O"})


@_q("pivot_diff_from", "lineitem", "SELECT l_returnflag, l_linestatus, round(q/max(CASE WHEN l_returnflag='A' THEN q END) OVER (PARTITION BY l_linestatus)-1,8) AS q FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY 1,2)")
def _diff(d):
    v = P.Value("l_quantity", "sum", "q", "percentDifferenceFrom", "l_returnflag", "A")
    return P.pivot(d, P.PivotConfig(["l_returnflag"], ["l_linestatus"], [v], subtotals=False, row_grand_totals=False)).select("l_returnflag", "l_linestatus", F.round("q", 8).alias("q"))


@_q("pivot_calculated", "lineitem", "SELECT l_returnflag, round(sum(l_extendedprice)/sum(l_quantity),6) AS per FROM lineitem GROUP BY 1")
def _calc(d):
    out = P.pivot(d, P.PivotConfig(["l_returnflag"], values=[P.Value("l_extendedprice", "sum", "p"), P.Value("l_quantity", "sum", "q")], subtotals=False, row_grand_totals=False, calculated_fields={"per": "[p] / [q]"}))
    return out.select("l_returnflag", F.round("per", 6).alias("per"))


@_q("pivot_crosstab", "customer", "SELECT c_mktsegment, avg(c_acctbal) FILTER (c_nationkey=1) AS \"1\", avg(c_acctbal) FILTER (c_nationkey=2) AS \"2\" FROM customer GROUP BY 1")
def _cross(d):
    return P.crosstab(d, "c_mktsegment", "c_nationkey", P.Value("c_acctbal", "average"), [1, 2])


@_q("pivot_slicer", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F','P') AND o_orderdate::date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'")
def _slice(d):
    return P.timeline(P.slicer(d, "o_orderstatus", ["F", "P"]), "o_orderdate", "1994-01-01", "1995-12-31").select("o_orderkey")


@_q("ev_tumbling", "events", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2")
def _tumble(d):
    return R.tumbling(d, "1 hour").select(F.col("start").cast("timestamp_ntz"), "event_type", "n", F.round("total", 4).alias("total"))


@_q("ev_sliding", "events", "SELECT w AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w, * FROM events) GROUP BY 1,2")
def _slide(d):
    return R.tumbling(d, "1 hour", "30 minutes").select(F.col("start").cast("timestamp_ntz"), "event_type", "n", F.round("total", 4).alias("total"))


@_q("ev_session", "events", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS b FROM events)) GROUP BY user_id, s")
def _session(d):
    out = R.sessions(d, "30 minutes")
    return out.select("user_id", F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "n")
