"""Queries of the star-schema model, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.plans.catalog import register, table
from gridloom.plans.model import Model, Relationship


def star(spark, sf) -> Model:
    """The sales star: lineitem -> orders -> customer -> nation -> region, lineitem -> part and supplier."""
    m = Model()
    for n in "region nation customer supplier part orders lineitem".split():
        m.add_table(n, table(spark, sf, n))
    for f, c, t, k in (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")):
        m.add_relationship(Relationship(f, c, t, k, referential=True))
    m.add_relationship(Relationship("supplier", "s_nationkey", "nation", "n_nationkey", active=False, referential=True))
    m.add_measure("Qty", "SUM(lineitem[l_quantity])")
    m.add_measure("Lines", "COUNTROWS(lineitem)")
    m.add_measure("Orders", "COUNTROWS(orders)")
    return m


def _pivot(name, base, keys, measures, sql, filters=None, setup=None):
    @register(name, sql)
    def run(spark, sf):
        m = star(spark, sf)
        if setup:
            setup(m)
        out = m.pivot(base, keys, measures, filters)
        return out.toDF(*[c.split("[")[1][:-1] if "[" in c else c for c in out.columns])


_SEG, _FLAG, _REG, _NAT = ("customer", "c_mktsegment"), ("lineitem", "l_returnflag"), ("region", "r_name"), ("nation", "n_name")
_J = "lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey"
_pivot("dax_sum", "lineitem", [_SEG], [("q", "[Qty]")], f"SELECT c_mktsegment, sum(l_quantity) AS q FROM {_J} GROUP BY 1")
_pivot("dax_countrows", "orders", [_REG], [("n", "COUNTROWS(orders)")], "SELECT r_name, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1")
_pivot("dax_distinctcount", "lineitem", [_FLAG], [("p", "DISTINCTCOUNT(lineitem[l_partkey])"), ("s", "DISTINCTCOUNTNOBLANK(lineitem[l_suppkey])")], "SELECT l_returnflag, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1")
_pivot("dax_averagex", "lineitem", [_FLAG], [("a", "AVERAGEX(lineitem, lineitem[l_quantity] * 2)"), ("hi", "MAXX(lineitem, lineitem[l_quantity] + 1)"), ("lo", "MINX(lineitem, lineitem[l_quantity] - 1)")], "SELECT l_returnflag, avg(l_quantity*2) AS a, max(l_quantity+1) AS hi, min(l_quantity-1) AS lo FROM lineitem GROUP BY 1")
_pivot("dax_calculate", "lineitem", [_FLAG], [("q", "[Qty]"), ("o", 'CALCULATE([Qty], orders[o_orderstatus] = "O")'), ("share", 'DIVIDE(CALCULATE([Lines], orders[o_orderstatus] = "O"), [Lines])')], f"SELECT l_returnflag, sum(l_quantity) AS q, sum(l_quantity) FILTER (o_orderstatus='O') AS o, (count(*) FILTER (o_orderstatus='O'))::double/count(*) AS share FROM {_J} GROUP BY 1")
_pivot("dax_all", "lineitem", [_FLAG, ("lineitem", "l_linestatus")], [("n", "[Lines]"), ("flag", "CALCULATE([Lines], ALL(lineitem[l_linestatus]))"), ("total", "CALCULATE([Lines], ALL(lineitem))")], "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_returnflag)::bigint AS flag, sum(count(*)) OVER ()::bigint AS total FROM lineitem GROUP BY 1,2")
_pivot("dax_filter", "lineitem", [_REG], [("n", "COUNTROWS(FILTER(lineitem, lineitem[l_quantity] > 30))")], f"SELECT r_name, nullif(count(*) FILTER (l_quantity > 30),0) AS n FROM {_J} GROUP BY 1")
_pivot("dax_crossfilter", "customer", [_SEG], [("n", "CALCULATE(COUNTROWS(customer), CROSSFILTER(orders[o_custkey], customer[c_custkey], BOTH), orders[o_orderstatus] = \"P\")")], "SELECT c_mktsegment, nullif(count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')),0) AS n FROM customer GROUP BY 1")
_pivot("dax_userelationship", "supplier", [("supplier", "s_nationkey")], [("n", "CALCULATE(COUNTROWS(supplier), USERELATIONSHIP(supplier[s_nationkey], nation[n_nationkey]), nation[n_regionkey] = 1)")], "SELECT s_nationkey, nullif(count(*) FILTER (n_regionkey=1),0) AS n FROM supplier JOIN nation ON s_nationkey=n_nationkey GROUP BY 1")
_pivot("dax_in", "orders", [("orders", "o_orderpriority")], [("n", 'CALCULATE([Orders], orders[o_orderstatus] IN {"O", "P"})')], "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus IN ('O','P')),0) AS n FROM orders GROUP BY 1")
_pivot("dax_selectedvalue", "orders", [("orders", "o_custkey")], [("s", 'SELECTEDVALUE(orders[o_orderstatus], "many")'), ("one", "HASONEVALUE(orders[o_orderstatus])")], "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus)=1 THEN max(o_orderstatus) ELSE 'many' END AS s, count(DISTINCT o_orderstatus)=1 AS one FROM orders GROUP BY 1")
_pivot("dax_isinscope", "lineitem", [_FLAG], [("a", "ISINSCOPE(lineitem[l_returnflag])"), ("b", "ISINSCOPE(lineitem[l_linestatus])"), ("n", "[Lines]")], "SELECT l_returnflag, true AS a, false AS b, count(*) AS n FROM lineitem GROUP BY 1")
_pivot("dax_concatenatex", "region", [_REG], [("names", 'CONCATENATEX(RELATEDTABLE(nation), nation[n_name], ", ", nation[n_name], ASC)')], "SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey=r_regionkey GROUP BY 1")
_pivot("dax_related", "customer", [_SEG], [("n", 'COUNTX(FILTER(customer, RELATED(region[r_name]) = "ASIA"), customer[c_custkey])')], "SELECT c_mktsegment, count(*) FILTER (r_name='ASIA') AS n FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1")
_pivot("dax_var", "lineitem", [_FLAG], [("r", "VAR a = [Lines] VAR b = [Qty] RETURN DIVIDE(b, a)")], "SELECT l_returnflag, sum(l_quantity)/count(*) AS r FROM lineitem GROUP BY 1")
_pivot("dax_context_transition", "customer", [_SEG], [("most", "MAXX(customer, [Orders])")], "SELECT c_mktsegment, max(n) AS most FROM (SELECT c_custkey, c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1,2) GROUP BY 1")


def _calculated(name, t, text, keep, sql):
    @register(name, sql)
    def run(spark, sf):
        m = star(spark, sf).add_calculated_column(t, "x", text)
        return m.tables[t].select(*keep, "x")


_calculated("dax_relatedtable", "region", "COUNTROWS(RELATEDTABLE(customer))", ["r_name"], "SELECT r_name, count(*) AS x FROM region JOIN nation ON n_regionkey=r_regionkey JOIN customer ON c_nationkey=n_nationkey GROUP BY 1")
_calculated("dax_lookupvalue", "customer", "LOOKUPVALUE(nation[n_name], nation[n_nationkey], customer[c_nationkey])", ["c_custkey"], "SELECT c_custkey, n_name AS x FROM customer LEFT JOIN nation ON n_nationkey=c_nationkey")
_calculated("dax_earlier_rank", "customer", "COUNTROWS(FILTER(customer, customer[c_nationkey] = EARLIER(customer[c_nationkey]) && customer[c_acctbal] > EARLIER(customer[c_acctbal])))", ["c_custkey"], "SELECT c_custkey, nullif(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)-1,0) AS x FROM customer")
_calculated("dax_if_blank", "orders", 'IF(orders[o_totalprice] > 100000, "high", IF(ISBLANK(orders[o_orderpriority]), "none", BLANK()))', ["o_orderkey"], "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_orderpriority IS NULL THEN 'none' END AS x FROM orders")


def _table(name, text, sql):
    @register(name, sql)
    def run(spark, sf):
        out = star(spark, sf).table(text)
        return out.toDF(*[c.split("[")[1][:-1] if "[" in c else c for c in out.columns])


_table("dax_values", "VALUES(customer[c_mktsegment])", "SELECT DISTINCT c_mktsegment FROM customer")
_table("dax_distinct", "DISTINCT(orders[o_orderstatus])", "SELECT DISTINCT o_orderstatus FROM orders")
_table("dax_summarize", "SUMMARIZE(orders, orders[o_orderstatus], region[r_name])", "SELECT DISTINCT o_orderstatus, r_name FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey")
_table("dax_summarizecolumns", 'SUMMARIZECOLUMNS(region[r_name], orders[o_orderstatus], FILTER(region, region[r_name] <> "ASIA"), "n", COUNTROWS(orders), "avg", AVERAGE(orders[o_orderkey]))', "SELECT r_name, o_orderstatus, count(*) AS n, avg(o_orderkey) AS avg FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1,2")
_table("dax_calculatetable", 'CALCULATETABLE(VALUES(nation[n_name]), region[r_name] = "EUROPE")', "SELECT n_name FROM nation JOIN region ON n_regionkey=r_regionkey WHERE r_name='EUROPE'")


@register("dax_blank_member", "SELECT s_nationkey, count(*) AS n FROM orders LEFT JOIN supplier ON o_custkey=s_suppkey GROUP BY 1")
def _blank(spark, sf):
    m = Model().add_table("orders", table(spark, sf, "orders")).add_table("supplier", table(spark, sf, "supplier"))
    m.add_relationship(Relationship("orders", "o_custkey", "supplier", "s_suppkey"))  # most keys have no supplier
    return m.pivot("orders", [("supplier", "s_nationkey")], [("n", "COUNTROWS(orders)")]).withColumnRenamed("supplier[s_nationkey]", "s_nationkey")


@register("dax_m2m", "SELECT s_name, round(sum(o_totalprice),2) AS total FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON o_orderkey=l_orderkey JOIN supplier ON s_suppkey=l_suppkey GROUP BY 1")
def _m2m(spark, sf):
    m = Model().add_table("orders", table(spark, sf, "orders")).add_table("bridge", table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()).add_table("supplier", table(spark, sf, "supplier"))
    m.add_relationship(Relationship("orders", "o_orderkey", "bridge", "l_orderkey", many_to_many=True)).add_relationship(Relationship("bridge", "l_suppkey", "supplier", "s_suppkey", referential=True))
    out = m.pivot("orders", [("supplier", "s_name")], [("total", "SUM(orders[o_totalprice])")]).withColumnRenamed("supplier[s_name]", "s_name")
    return out.where("s_name IS NOT NULL").withColumn("total", F.round("total", 2))


@register("dax_crosstab", "SELECT r_name, count(*) FILTER (o_orderstatus='F') AS \"F\", count(*) FILTER (o_orderstatus='O') AS \"O\", count(*) FILTER (o_orderstatus='P') AS \"P\" FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1")
def _crosstab(spark, sf):
    out = star(spark, sf).crosstab("orders", [_REG], [("orders", "o_orderstatus")], [("n", "[Orders]")], ["F", "O", "P"])
    return out.withColumnRenamed("region[r_name]", "r_name").fillna(0, ["F", "O", "P"])


_pivot("dax_column_aggregates", "orders", [("orders", "o_orderpriority")], [("lo", "MIN(orders[o_totalprice])"), ("hi", "MAX(orders[o_totalprice])"), ("n", "COUNT(orders[o_custkey])"), ("a", "COUNTA(orders[o_orderstatus])"), ("b", "COUNTBLANK(orders[o_orderstatus])"), ("sx", "SUMX(orders, orders[o_custkey] * 2 + 1)"), ("plain", "MAX(orders[o_custkey]) - MIN(orders[o_custkey]) * 2")], "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_custkey) AS n, count(o_orderstatus) AS a, count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus = '') AS b, sum(o_custkey * 2 + 1)::double AS sx, (max(o_custkey) - min(o_custkey) * 2)::double AS plain FROM orders GROUP BY 1")
_pivot("dax_allnoblankrow", "lineitem", [_FLAG], [("n", "CALCULATE([Lines], ALLNOBLANKROW(lineitem))"), ("m", "CALCULATE([Lines], FILTER(ALLNOBLANKROW(lineitem[l_linestatus]), lineitem[l_linestatus] = \"O\"))")], "SELECT l_returnflag, (SELECT count(*) FROM lineitem) AS n, nullif(count(*) FILTER (l_linestatus = 'O'),0) AS m FROM lineitem GROUP BY 1")
_calculated("dax_containsrow", "nation", "IF(CONTAINSROW({1, 3}, nation[n_regionkey]) && TRUE() || FALSE(), \"in\", \"out\")", ["n_name"], "SELECT n_name, CASE WHEN n_regionkey IN (1, 3) THEN 'in' ELSE 'out' END AS x FROM nation")
_calculated("dax_containsrow_pairs", "nation", "IF(CONTAINSROW({(1, 2), (3, 4)}, nation[n_regionkey], nation[n_regionkey] + 1), 1, 0)", ["n_name"], "SELECT n_name, CASE WHEN n_regionkey IN (1, 3) THEN 1 ELSE 0 END AS x FROM nation")
