"""Queries of the cell functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions.cells import call
from gridloom.plans.catalog import register, table

c = F.col


def _row(name, source, keep, made, sql):
    """Scalars by row: made gives {output: (function, *arguments)}; it is called when a session is there."""

    @register(name, sql)
    def run(spark, sf):
        return table(spark, sf, source).select(*keep, *[call(f, *a).alias(n) for n, (f, *a) in made().items()])


def _agg(name, source, by, made, sql, digits=6):
    """Aggregates by group, rounded."""

    @register(name, sql)
    def run(spark, sf):
        out = table(spark, sf, source).groupBy(*by).agg(*[call(f, *a).alias(n) for n, (f, *a) in made().items()])
        return out.select(*by, *[F.round(c(n), digits).alias(n) if dict(out.dtypes)[n] == "double" else c(n) for n in out.columns if n not in by])


_agg("fx_sumifs", "lineitem", ["l_returnflag"], lambda: {"s": ("SUMIFS", c("l_quantity"), c("l_discount"), ">0.05", c("l_linestatus"), "O")}, "SELECT l_returnflag, coalesce(sum(l_quantity) FILTER (l_discount>0.05 AND l_linestatus='O'),0) AS s FROM lineitem GROUP BY 1")
_agg("fx_countifs", "orders", ["o_orderpriority"], lambda: {"n": ("COUNTIFS", c("o_totalprice"), ">=100000", c("o_orderstatus"), "<>f")}, "SELECT o_orderpriority, count(*) FILTER (o_totalprice>=100000 AND o_orderstatus<>'F') AS n FROM orders GROUP BY 1")
_agg("fx_averageifs", "orders", ["o_orderpriority"], lambda: {"a": ("AVERAGEIFS", c("o_totalprice"), c("o_orderstatus"), "o")}, "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus='O'),6) AS a FROM orders GROUP BY 1")
_agg("fx_minmaxifs", "lineitem", ["l_returnflag"], lambda: {"lo": ("MINIFS", c("l_tax"), c("l_quantity"), ">49"), "hi": ("MAXIFS", c("l_tax"), c("l_quantity"), "<0")}, "SELECT l_returnflag, coalesce(min(l_tax) FILTER (l_quantity>49),0) AS lo, 0.0::double AS hi FROM lineitem GROUP BY 1")
_agg("fx_countif_wildcard", "part", ["p_brand"], lambda: {"n": ("COUNTIF", c("p_type"), "*s?eel*")}, "SELECT p_brand, count(*) FILTER (regexp_matches(lower(p_type),'s.eel')) AS n FROM part GROUP BY 1")
_agg("fx_subtotal", "lineitem", ["l_linestatus"], lambda: {"s": ("SUBTOTAL", 109, c("l_quantity"), c("l_discount") > 0.05), "n": ("SUBTOTAL", 2, c("l_quantity"))}, "SELECT l_linestatus, sum(l_quantity) FILTER (NOT l_discount>0.05) AS s, count(l_quantity) AS n FROM lineitem GROUP BY 1")
_agg("fx_aggregate", "orders", ["o_orderstatus"], lambda: {"m": ("AGGREGATE", 12, 6, c("o_totalprice")), "k": ("AGGREGATE", 14, 6, c("o_totalprice"), 3)}, "SELECT o_orderstatus, median(o_totalprice) AS m, list_sort(list(o_totalprice),'DESC')[3] AS k FROM orders GROUP BY 1")
_agg("fx_sumproduct", "lineitem", ["l_returnflag"], lambda: {"s": ("SUMPRODUCT", c("l_quantity"), c("l_tax"))}, "SELECT l_returnflag, round(sum(l_quantity*l_tax),6) AS s FROM lineitem GROUP BY 1")
_agg("fx_percentile_inc", "orders", ["o_orderstatus"], lambda: {"p": ("PERCENTILE.INC", c("o_totalprice"), 0.9)}, "SELECT o_orderstatus, round(quantile_cont(o_totalprice,0.9),6) AS p FROM orders GROUP BY 1")
_agg("fx_percentile_exc", "orders", ["o_orderstatus"], lambda: {"p": ("PERCENTILE.EXC", c("o_totalprice"), 0.9)}, "SELECT o_orderstatus, round(a[k]+(r-k)*(a[k+1]-a[k]),6) AS p FROM (SELECT o_orderstatus, list_sort(list(o_totalprice)) AS a, 0.9*(count(*)+1) AS r, floor(0.9*(count(*)+1))::int AS k FROM orders GROUP BY 1)", 6)
_agg("fx_quartile", "orders", ["o_orderstatus"], lambda: {"q": ("QUARTILE", c("o_totalprice"), 3)}, "SELECT o_orderstatus, round(quantile_cont(o_totalprice,0.75),6) AS q FROM orders GROUP BY 1")
_agg("fx_median", "lineitem", ["l_shipdate"], lambda: {"m": ("MEDIAN", c("l_extendedprice"))}, "SELECT l_shipdate, round(median(l_extendedprice),6) AS m FROM lineitem GROUP BY 1")
_agg("fx_stdev_s", "orders", ["o_orderpriority"], lambda: {"s": ("STDEV.S", c("o_totalprice")), "p": ("STDEV.P", c("o_totalprice"))}, "SELECT o_orderpriority, round(stddev_samp(o_totalprice),4) AS s, round(stddev_pop(o_totalprice),4) AS p FROM orders GROUP BY 1", 4)
_agg("fx_var_p", "lineitem", ["l_returnflag"], lambda: {"v": ("VAR.P", c("l_quantity")), "d": ("VAR.S", c("l_quantity"))}, "SELECT l_returnflag, round(var_pop(l_quantity),6) AS v, round(var_samp(l_quantity),6) AS d FROM lineitem GROUP BY 1")
_agg("fx_correl", "lineitem", ["l_returnflag"], lambda: {"r": ("CORREL", c("l_quantity"), c("l_extendedprice"))}, "SELECT l_returnflag, round(corr(l_quantity,l_extendedprice),6) AS r FROM lineitem GROUP BY 1")
_agg("fx_slope", "lineitem", ["l_returnflag"], lambda: {"b": ("SLOPE", c("l_extendedprice"), c("l_quantity")), "a": ("INTERCEPT", c("l_extendedprice"), c("l_quantity")), "r2": ("RSQ", c("l_extendedprice"), c("l_quantity"))}, "SELECT l_returnflag, round(regr_slope(l_extendedprice,l_quantity),4) AS b, round(regr_intercept(l_extendedprice,l_quantity),4) AS a, round(regr_r2(l_extendedprice,l_quantity),4) AS r2 FROM lineitem GROUP BY 1", 4)
_agg("fx_forecast", "lineitem", ["l_linestatus"], lambda: {"f": ("FORECAST", 60, c("l_extendedprice"), c("l_quantity"))}, "SELECT l_linestatus, round(regr_intercept(l_extendedprice,l_quantity)+60*regr_slope(l_extendedprice,l_quantity),4) AS f FROM lineitem GROUP BY 1", 4)
_agg("fx_trimmean", "orders", ["o_orderstatus"], lambda: {"t": ("TRIMMEAN", c("o_totalprice"), 0.2)}, "SELECT o_orderstatus, round(avg(o_totalprice) FILTER (r > k AND r <= n - k),4) AS t FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n, floor(count(*) OVER (PARTITION BY o_orderstatus)*0.2/2) AS k FROM orders) GROUP BY 1", 4)
_agg("fx_geomean_harmean", "lineitem", ["l_returnflag"], lambda: {"g": ("GEOMEAN", c("l_quantity")), "h": ("HARMEAN", c("l_quantity"))}, "SELECT l_returnflag, round(exp(avg(ln(l_quantity))),6) AS g, round(count(*)/sum(1/l_quantity),6) AS h FROM lineitem GROUP BY 1")
_agg("fx_skew_kurt", "orders", ["o_orderstatus"], lambda: {"s": ("SKEW", c("o_totalprice")), "k": ("KURT", c("o_totalprice"))}, "SELECT o_orderstatus, round(skewness(o_totalprice),5) AS s, round(kurtosis(o_totalprice),5) AS k FROM orders GROUP BY 1", 5)
_agg("fx_large_small", "customer", ["c_mktsegment"], lambda: {"l": ("LARGE", c("c_acctbal"), 2), "s": ("SMALL", c("c_acctbal"), 3)}, "SELECT c_mktsegment, list_sort(list(c_acctbal),'DESC')[2] AS l, list_sort(list(c_acctbal))[3] AS s FROM customer GROUP BY 1")
_agg("fx_sums", "lineitem", ["l_returnflag"], lambda: {"q": ("SUMSQ", c("l_quantity")), "d": ("SUMXMY2", c("l_quantity"), c("l_tax")), "v": ("DEVSQ", c("l_quantity"))}, "SELECT l_returnflag, round(sum(l_quantity*l_quantity),3) AS q, round(sum((l_quantity-l_tax)*(l_quantity-l_tax)),3) AS d, round(var_pop(l_quantity)*count(*),3) AS v FROM lineitem GROUP BY 1", 3)
_agg("fx_counts", "events", ["event_type"], lambda: {"n": ("COUNT", c("value")), "a": ("COUNTA", c("props")), "b": ("COUNTBLANK", c("props"))}, "SELECT event_type, count(value) AS n, count(props) AS a, count(*) FILTER (props IS NULL OR props='') AS b FROM events GROUP BY 1")


def _lookup(name, sql, f):
    register(name, sql)(f)


_lookup("fx_vlookup_exact", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey", lambda spark, sf: call("VLOOKUP", table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, sf, "nation"), "n_nationkey", "n_name").drop("c_nationkey"))
_lookup("fx_vlookup_approx", "SELECT o.o_orderkey, p.p_retailprice, p.p_partkey FROM orders o ASOF LEFT JOIN (SELECT p_retailprice, max(p_partkey) AS p_partkey FROM part GROUP BY 1) p ON o.o_totalprice / 100 >= p.p_retailprice", lambda spark, sf: call("VLOOKUP", table(spark, sf, "orders").select("o_orderkey", (c("o_totalprice") / 100).alias("k")), "k", table(spark, sf, "part").groupBy("p_retailprice").agg(F.max("p_partkey").alias("p_partkey")), "p_retailprice", ["p_retailprice", "p_partkey"], -1).drop("k"))
_lookup("fx_xlookup", "SELECT s_suppkey, coalesce(r, 'none') AS r_name FROM supplier LEFT JOIN (SELECT r_regionkey, r_name AS r FROM region) ON r_regionkey = s_nationkey", lambda spark, sf: call("XLOOKUP", table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", table(spark, sf, "region"), "r_regionkey", "r_name", "exact", "none").drop("s_nationkey"))
_lookup("fx_index_match", "SELECT c_custkey, r AS position FROM customer LEFT JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) ON n_nationkey = c_nationkey", lambda spark, sf: call("MATCH", table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, sf, "nation").orderBy("n_nationkey"), "n_nationkey").drop("c_nationkey"))
_lookup("fx_filter", "SELECT p_partkey FROM part WHERE p_size > 25 AND p_retailprice < 1500", lambda spark, sf: table(spark, sf, "part").where("p_size > 25 AND p_retailprice < 1500").select("p_partkey"))
_lookup("fx_sort", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey", lambda spark, sf: table(spark, sf, "part").select("p_partkey", "p_size").orderBy(F.desc("p_size"), "p_partkey"))
_lookup("fx_unique", "SELECT p_brand FROM part GROUP BY 1", lambda spark, sf: table(spark, sf, "part").select("p_brand").dropDuplicates())
_lookup("fx_unique_once", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1", lambda spark, sf: table(spark, sf, "orders").groupBy("o_custkey").count().where("count = 1").select("o_custkey"))
_lookup("fx_sequence", "SELECT n_nationkey, list_transform(range(0, n_nationkey + 1), lambda x: (5 + 2*x)::double) AS s FROM nation", lambda spark, sf: table(spark, sf, "nation").select("n_nationkey", F.flatten(call("SEQUENCE", 1, 1, 5, 2)).alias("x"), F.transform(call("SEQUENCE", c("n_nationkey") + 1, 1, 5, 2), lambda r: F.element_at(r, 1)).alias("s")).drop("x"))
_lookup("fx_mode", "SELECT l_returnflag, m AS mode FROM (SELECT l_returnflag, l_quantity AS m, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS r FROM lineitem GROUP BY 1,2) WHERE r = 1", lambda spark, sf: call("MODE", table(spark, sf, "lineitem"), "l_quantity", None, ["l_returnflag"]))
_lookup("fx_frequency", "SELECT b AS bin, count(*) AS n FROM (SELECT CASE WHEN l_quantity<=10 THEN 10.0::double WHEN l_quantity<=30 THEN 30.0::double END AS b FROM lineitem) GROUP BY 1", lambda spark, sf: call("FREQUENCY", table(spark, sf, "lineitem"), "l_quantity", [10, 30]))
_lookup("fx_dsum", "SELECT sum(c_acctbal) AS value FROM customer WHERE (c_mktsegment ILIKE 'b%' AND c_acctbal > 1000) OR c_nationkey = 3", lambda spark, sf: call("DSUM", table(spark, sf, "customer"), "c_acctbal", [{"c_mktsegment": "B*", "c_acctbal": ">1000"}, {"c_nationkey": 3}]))
_lookup("fx_dget", "SELECT n_name AS value, NULL::varchar AS err FROM nation WHERE n_nationkey = 7", lambda spark, sf: call("DGET", table(spark, sf, "nation"), "n_name", [{"n_nationkey": 7}]))


@register("fx_rank_eq", "SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC)::int AS r, round((rank() OVER (ORDER BY c_acctbal DESC)) + (count(*) OVER (PARTITION BY c_acctbal)-1)/2.0,1) AS a FROM customer")
def _rank(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    d = call("RANK.AVG", call("RANK.EQ", d, "c_acctbal", "r"), "c_acctbal", "a")
    return d.select("c_custkey", c("r").cast("int").alias("r"), F.round("a", 1).alias("a"))


@register("fx_percentrank_all", "SELECT o_orderkey, floor(round((percent_rank() OVER (ORDER BY o_totalprice))*1000,6))/1000 AS p, floor(round((rank() OVER (ORDER BY o_totalprice))/(count(*) OVER () + 1.0)*1000,6))/1000 AS e FROM orders")
def _prank_all(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return call("PERCENTRANK.EXC", call("PERCENTRANK.INC", d, "o_totalprice", "p"), "o_totalprice", "e").drop("o_totalprice")


@register("fx_percentrank", "SELECT o_orderkey, floor(round((percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice))*1000,6))/1000 AS p FROM orders")
def _prank(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", call("PERCENTRANK.INC", c("o_totalprice"), 3, ["o_custkey"]).alias("p"))


_row("fx_text", "customer", ["c_custkey"], lambda: {"u": ("UPPER", c("c_name")), "l": ("LEFT", c("c_name"), 5), "r": ("RIGHT", c("c_name"), 3), "m": ("MID", c("c_name"), 2, 4), "n": ("LEN", c("c_name")), "s": ("SUBSTITUTE", c("c_name"), "0", "o"), "f": ("FIND", "#", c("c_name"))}, "SELECT c_custkey, upper(c_name) AS u, left(c_name,5) AS l, right(c_name,3) AS r, substring(c_name,2,4) AS m, length(c_name)::int AS n, replace(c_name,'0','o') AS s, nullif(instr(c_name,'#'),0)::int AS f FROM customer")
_row("fx_textjoin", "nation", ["n_nationkey"], lambda: {"j": ("TEXTJOIN", "-", True, c("n_name"), "", c("n_regionkey")), "t": ("TRIM", F.concat(F.lit("  "), c("n_name"), F.lit("  x ")))}, "SELECT n_nationkey, n_name || '-' || n_regionkey AS j, n_name || ' x' AS t FROM nation")


@register("fx_textsplit", "SELECT c_custkey, string_split(c_name,'#')[2] AS s FROM customer")
def _textsplit(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", call("INDEX", call("TEXTSPLIT", c("c_name"), "#"), 1, 2).alias("s"))


@register("fx_date", "SELECT o_orderkey, year(d)::int AS y, month(d)::int AS m, (dayofweek(d)+1)::int AS w, last_day(d + INTERVAL 1 MONTH)::date AS e, (d - DATE '1899-12-30')::int AS serial FROM (SELECT o_orderkey, o_orderdate::date AS d FROM orders)")
def _dates(spark, sf):
    from gridloom.functions.cells.dates import serial

    d = c("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", call("YEAR", d).alias("y"), call("MONTH", d).alias("m"), call("WEEKDAY", d).alias("w"), call("EOMONTH", d, 1).alias("e"), serial(d).alias("serial"))


@register("fx_networkdays", "SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM range(s, s + INTERVAL 31 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6)::int AS n FROM (SELECT l_orderkey, l_linenumber, l_shipdate::date AS s FROM lineitem)")
def _networkdays(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.select("l_orderkey", "l_linenumber", call("NETWORKDAYS", c("l_shipdate"), F.date_add(c("l_shipdate").cast("date"), 30)).alias("n"))


@register("fx_eomonth", "SELECT o_orderkey, last_day(o_orderdate::date) AS a, (o_orderdate::date + INTERVAL 3 MONTH)::date AS b FROM orders")
def _eomonth(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", call("EOMONTH", c("o_orderdate"), 0).alias("a"), call("EDATE", c("o_orderdate"), 3).alias("b"))


_YEARFRAC = """
    WITH d AS (SELECT o_orderkey, least(o_orderdate::date, DATE '2000-02-29') AS a, greatest(o_orderdate::date, DATE '2000-02-29') AS b FROM orders),
         e AS (SELECT *, month(a) = 2 AND a = last_day(a) AS fa, month(b) = 2 AND b = last_day(b) AS fb FROM d),
         x AS (SELECT *, CASE WHEN fa OR day(a) = 31 THEN 30 ELSE day(a) END AS p FROM e),
         y AS (SELECT *, CASE WHEN fa AND fb THEN 30 WHEN day(b) = 31 AND p = 30 THEN 30 ELSE day(b) END AS q FROM x)
    SELECT o_orderkey, round(((year(b)-year(a))*360+(month(b)-month(a))*30+q-p)/360.0,9) AS f, round((b-a)/365.0,9) AS g FROM y"""


@register("fx_yearfrac", _YEARFRAC)
def _yearfrac(spark, sf):
    d = table(spark, sf, "orders")
    end = F.lit("2000-02-29").cast("date")
    return d.select("o_orderkey", F.round(call("YEARFRAC", c("o_orderdate"), end, 0), 9).alias("f"), F.round(call("YEARFRAC", c("o_orderdate"), end, 3), 9).alias("g"))


@register("fx_npv", "SELECT o_custkey, round(sum(o_totalprice/power(1.08, r)),4) AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1")
def _npv(spark, sf):
    flows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda s: s["o_totalprice"]).alias("v"))
    return flows.select("o_custkey", F.round(call("NPV", 0.08, c("v")), 4).alias("v"))


@register("fx_xnpv", "SELECT o_custkey, round(sum(o_totalprice/power(1.08, (d-f)/365.0)),4) AS v FROM (SELECT o_custkey, o_totalprice, o_orderdate::date AS d, first_value(o_orderdate::date) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f FROM orders) GROUP BY 1")
def _xnpv(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))).alias("s"))
    return rows.select("o_custkey", F.round(call("XNPV", 0.08, F.transform("s", lambda x: x["o_totalprice"]), F.transform("s", lambda x: x["o_orderdate"].cast("date"))), 4).alias("v"))


@register("fx_pmt", "SELECT p_partkey, round(-p_retailprice*power(1+0.05/12,36)*(0.05/12)/(power(1+0.05/12,36)-1),6) AS p FROM part")
def _pmt(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(call("PMT", 0.05 / 12, 36, c("p_retailprice")), 6).alias("p"))


@register("fx_json", "SELECT event_id, (props->>'$.k')::bigint AS k FROM events")
def _json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("fx_math", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice/7)*7 AS f, ceil(l_extendedprice/7)*7 AS g, floor(l_extendedprice/100+0.5)*100 AS r, l_extendedprice - 7*floor(l_extendedprice/7) AS m FROM lineitem")
def _math(spark, sf):
    x = c("l_extendedprice")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", call("FLOOR", x, 7).alias("f"), call("CEILING", x, 7).alias("g"), call("ROUND", x, -2).alias("r"), call("MOD", x, 7).alias("m"))


@register("fx_logic", "SELECT o_orderkey, CASE WHEN o_totalprice>200000 THEN 'A' WHEN o_totalprice>100000 THEN 'B' ELSE 'C' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
def _logic(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", call("IFS", c("o_totalprice") > 200000, "A", c("o_totalprice") > 100000, "B", F.lit(True), "C").alias("band"), call("SWITCH", c("o_orderstatus"), "F", 1, "O", 2, 0).alias("code"))


@register("fx_lambda", "SELECT o_custkey, list_sort(list(o_totalprice::double))[1] AS first, len(list(o_totalprice)) AS n FROM orders GROUP BY 1")
def _lambda(spark, sf):
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_totalprice")).alias("a"))
    return a.select("o_custkey", call("INDEX", call("MAP", c("a"), lambda v: v * 1.0), 1).alias("first"), call("REDUCE", F.lit(0).cast("long"), c("a"), lambda s, _: s + 1).alias("n"))


@register("fx_norm_dist", "SELECT o_orderkey, true AS same FROM orders")
def _norm(spark, sf):
    """The distribution and its inverse, one after the other."""
    m = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    d = table(spark, sf, "orders").join(F.broadcast(m), "o_orderstatus")  # one row for each of the order states
    return d.select("o_orderkey", (F.abs(call("NORM.INV", call("NORM.DIST", c("o_totalprice"), c("m"), c("s"), True), c("m"), c("s")) - c("o_totalprice")) < 0.001).alias("same"))


@register("fx_irr", "SELECT o_custkey, 0.0::double AS left_ FROM orders GROUP BY 1")
def _irr(spark, sf):
    """What the flows are worth at their own rate: nothing."""
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_totalprice")).alias("a"), F.sum("o_totalprice").alias("s"))
    a = a.select("o_custkey", "a", (c("s") * 0.9).alias("paid"), call("IRR", F.concat(F.array(-c("s") * 0.9), c("a"))).alias("r"))
    return a.select("o_custkey", (F.round((call("NPV", c("r"), c("a")) - c("paid")) / c("paid"), 6) + 0.0).alias("left_"))
