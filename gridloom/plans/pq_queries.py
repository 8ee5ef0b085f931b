"""Queries of the step engine, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.expression import EXPRESSION_KEY
from gridloom.plans.catalog import register, table
from gridloom.plans.mlang import compile_m
from gridloom.plans.query import Engine, Query
from gridloom.runtime import scratch_root


def _engine(spark, sf, **queries):
    names = "region nation customer supplier part orders lineitem events".split()
    return Engine(spark, queries, {n: None for n in names} | {n: table(spark, sf, n) for n in names})


def _steps(name: str, source: str, steps: list[dict], sql: str, **others):
    """Register a query of steps over a table; others are further queries by name."""

    @register(name, sql)
    def run(spark, sf):
        qs = {k: Query({"type": "table", "table": t}, s) for k, (t, s) in others.items()}
        return _engine(spark, sf, **qs).run(Query({"type": "table", "table": source}, steps))


def _cmp(column, operator, value=None, **more):
    return {"type": "comparison", "column": column, "operator": operator, "value": value} | more


def _sel(*columns):
    return {"type": "selectColumns", "columns": list(columns)}


def _where(p):
    return {"type": "filterRows", "predicate": p}


def _group(keys, *aggs):
    return {"type": "groupBy", "groupColumns": keys, "aggregations": [{"column": c, "op": o, "as": a} for c, o, a in aggs]}


def _sort(*keys):
    return {"type": "sortRows", "sortBy": [{"column": k.lstrip("-"), "direction": "descending" if k[0] == "-" else "ascending"} for k in keys]}


_steps("pq_select_columns", "orders", [_sel("o_orderkey", "o_orderstatus")], "SELECT o_orderkey, o_orderstatus FROM orders")
_steps("pq_remove_columns", "orders", [{"type": "removeColumns", "columns": ["o_orderdate", "o_totalprice"]}], "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
_steps("pq_filter_compare", "lineitem", [_where({"type": "and", "predicates": [_cmp("l_quantity", "greaterThan", 40), _cmp("l_discount", "lessThanOrEqual", 0.05), _cmp("l_returnflag", "equals", "R")]}), _sel("l_orderkey", "l_linenumber", "l_quantity")], "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40 AND l_discount <= 0.05 AND l_returnflag = 'R'")
_steps("pq_filter_null", "customer", [_where({"type": "or", "predicates": [_cmp("c_mktsegment", "isNull"), _cmp("c_acctbal", "isNotNull")]}), _sel("c_custkey")], "SELECT c_custkey FROM customer WHERE c_mktsegment IS NULL OR c_acctbal IS NOT NULL")
_steps("pq_filter_text", "part", [_where({"type": "or", "predicates": [_cmp("p_type", "contains", "brass"), _cmp("p_brand", "endsWith", "3"), _cmp("p_name", "startsWith", "PART#0000001", caseSensitive=False)]}), _sel("p_partkey", "p_type")], "SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type),'brass') OR ends_with(lower(p_brand),'3') OR starts_with(lower(p_name),'part#0000001')")
_steps("pq_filter_and_or_not", "orders", [_where({"type": "and", "predicates": [{"type": "not", "predicate": _cmp("o_orderstatus", "equals", "F")}, {"type": "or", "predicates": [_cmp("o_totalprice", "lessThan", 50000), _cmp("o_orderpriority", "notEquals", "1-URGENT")]}]}), _sel("o_orderkey", "o_orderstatus", "o_orderpriority")], "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' AND (o_totalprice < 50000 OR o_orderpriority IS DISTINCT FROM '1-URGENT')")
_steps("pq_sort_nulls", "customer", [_sel("c_custkey", "c_mktsegment", "c_acctbal"), _sort("c_mktsegment", "-c_acctbal", "c_custkey")], "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey")
_steps("pq_group_avg", "orders", [_group(["o_orderpriority"], ("o_totalprice", "average", "a")), {"type": "transformColumns", "transforms": [{"column": "a", EXPRESSION_KEY: "number_round(_, 3)"}]}], "SELECT o_orderpriority, floor(avg(o_totalprice)*1000+0.5)/1000 AS a FROM orders GROUP BY 1")
_steps("pq_group_count", "customer", [_group(["c_mktsegment", "c_nationkey"], ("c_custkey", "count", "n"))], "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1,2")
_steps("pq_group_minmax", "lineitem", [_group(["l_shipdate"], ("l_extendedprice", "min", "lo"), ("l_extendedprice", "max", "hi"))], "SELECT l_shipdate, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")
_steps("pq_group_countdistinct", "lineitem", [_group(["l_returnflag"], ("l_suppkey", "countDistinct", "s"), ("l_partkey", "countDistinct", "p"))], "SELECT l_returnflag, count(DISTINCT l_suppkey) + max((l_suppkey IS NULL)::int) AS s, count(DISTINCT l_partkey) + max((l_partkey IS NULL)::int) AS p FROM lineitem GROUP BY 1")
_steps("pq_add_column", "lineitem", [_sel("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), {"type": "addColumn", "name": "net", EXPRESSION_KEY: "number_round([l_extendedprice] * (1 - [l_discount]), 2)"}, {"type": "addColumn", "name": "big", EXPRESSION_KEY: '[net] > 50000 ? "big" : "small"'}], "SELECT *, CASE WHEN net > 50000 THEN 'big' ELSE 'small' END AS big FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, floor(l_extendedprice*(1-l_discount)*100+0.5)/100 AS net FROM lineitem)")
_steps("pq_rename", "nation", [{"type": "renameColumn", "oldName": "n_name", "newName": "Nation"}], "SELECT n_nationkey, n_name AS \"Nation\", n_regionkey FROM nation")
_steps("pq_change_type", "orders", [_sel("o_orderkey", "o_totalprice", "o_orderdate"), {"type": "changeType", "column": "o_orderdate", "newType": "date"}, {"type": "changeType", "column": "o_orderkey", "newType": "string"}], "SELECT o_orderkey::varchar AS o_orderkey, o_totalprice, o_orderdate::date AS o_orderdate FROM orders")
_steps("pq_take", "orders", [_sel("o_orderkey", "o_totalprice"), _sort("-o_totalprice", "o_orderkey"), {"type": "take", "count": 25}], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_steps("pq_skip", "customer", [_sel("c_custkey", "c_acctbal"), _sort("c_acctbal", "c_custkey"), {"type": "skip", "count": 100}], "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey OFFSET 100")
_steps("pq_remove_rows", "nation", [_sort("n_name"), {"type": "removeRows", "offset": 3, "count": 5}], "SELECT n_nationkey, n_name, n_regionkey FROM (SELECT *, row_number() OVER (ORDER BY n_name) - 1 AS r FROM nation) WHERE r < 3 OR r >= 8")
_steps("pq_pivot", "orders", [_sel("o_orderpriority", "o_orderstatus", "o_totalprice"), {"type": "pivot", "rowColumn": "o_orderstatus", "valueColumn": "o_totalprice", "aggregation": "count", "values": ["F", "O", "P"]}], "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus='F'),0) AS \"F\", nullif(count(*) FILTER (o_orderstatus='O'),0) AS \"O\", nullif(count(*) FILTER (o_orderstatus='P'),0) AS \"P\" FROM orders GROUP BY 1")
_steps("pq_unpivot", "lineitem", [_sel("l_orderkey", "l_linenumber", "l_discount", "l_tax"), {"type": "unpivot", "columns": ["l_discount", "l_tax"], "nameColumn": "kind", "valueColumn": "rate"}], "SELECT l_orderkey, l_linenumber, 'l_discount' AS kind, l_discount AS rate FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
_steps("pq_distinct", "orders", [_sel("o_orderstatus", "o_orderpriority"), {"type": "distinctRows", "columns": None}], "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_steps("pq_distinct_keys", "orders", [_sel("o_orderkey", "o_custkey", "o_totalprice"), _sort("o_orderkey"), {"type": "distinctRows", "columns": ["o_custkey"]}], "SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
_steps("pq_transform_columns", "customer", [_sel("c_custkey", "c_name", "c_acctbal"), {"type": "transformColumns", "transforms": [{"column": "c_name", EXPRESSION_KEY: "text_upper(_)"}, {"column": "c_acctbal", EXPRESSION_KEY: "_ < 0 ? 0 : _", "newType": "number"}]}], "SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
_steps("pq_fill_down", "events", [_sel("event_id", "event_type", "value"), {"type": "addColumn", "name": "seen", EXPRESSION_KEY: '[event_type] == "purchase" ? [value] : null'}, _sort("event_id"), {"type": "fillDown", "columns": ["seen"]}, _sel("event_id", "seen")], "SELECT event_id, last_value(CASE WHEN event_type='purchase' THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events")
_steps("pq_replace_values", "customer", [_sel("c_custkey", "c_mktsegment"), {"type": "replaceValues", "column": "c_mktsegment", "find": "BUILDING", "replace": "CONSTRUCTION"}], "SELECT c_custkey, CASE WHEN c_mktsegment='BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS c_mktsegment FROM customer")
_steps("pq_split_column", "customer", [_sel("c_custkey", "c_name"), {"type": "splitColumn", "column": "c_name", "delimiter": "#", "newColumns": ["head", "number"]}], "SELECT c_custkey, string_split(c_name,'#')[1] AS head, string_split(c_name,'#')[2] AS number FROM customer")
_steps("pq_reorder", "region", [{"type": "reorderColumns", "columns": ["r_name", "r_regionkey"], "missingField": "ignore"}], "SELECT r_name, r_regionkey FROM region")
_steps("pq_index", "nation", [_sort("n_name"), {"type": "addIndexColumn", "name": "i", "initialValue": 10, "increment": 5}], "SELECT *, 10 + 5*(row_number() OVER (ORDER BY n_name)-1) AS i FROM nation")
_steps("pq_combine", "orders", [_sel("o_orderkey", "o_orderstatus", "o_orderpriority"), {"type": "combineColumns", "columns": ["o_orderstatus", "o_orderpriority"], "delimiter": "/", "newColumnName": "both"}], "SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority AS both FROM orders")
_steps("pq_names", "region", [{"type": "transformColumnNames", "transform": "upper"}], 'SELECT r_regionkey AS "R_REGIONKEY", r_name AS "R_NAME" FROM region')
_steps("pq_demote_promote", "region", [_sort("r_regionkey"), {"type": "demoteHeaders"}, {"type": "promoteHeaders"}], "SELECT r_regionkey::varchar AS r_regionkey, r_name FROM region")
_steps("pq_replace_errors", "orders", [_sel("o_orderkey", "o_orderpriority"), {"type": "addColumn", "name": "o_orderpriority__err", EXPRESSION_KEY: '[o_orderpriority] == "4-NOT SPECIFIED" ? "#VALUE!" : null'}, {"type": "replaceErrorValues", "replacements": [{"column": "o_orderpriority", "value": "none"}]}, _sel("o_orderkey", "o_orderpriority")], "SELECT o_orderkey, CASE WHEN o_orderpriority='4-NOT SPECIFIED' THEN 'none' ELSE o_orderpriority END AS o_orderpriority FROM orders")
_steps("pq_remove_errors", "orders", [_sel("o_orderkey", "o_orderpriority"), {"type": "addColumn", "name": "o_orderpriority__err", EXPRESSION_KEY: '[o_orderpriority] == "4-NOT SPECIFIED" ? "#VALUE!" : null'}, {"type": "removeRowsWithErrors", "columns": None}, _sel("o_orderkey")], "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'")
_steps("pq_append", "customer", [_sel("c_name"), {"type": "renameColumn", "oldName": "c_name", "newName": "name"}, {"type": "append", "queries": ["s"]}], "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier", s=("supplier", [_sel("s_name"), {"type": "renameColumn", "oldName": "s_name", "newName": "name"}]))

_O = [_sel("o_orderkey", "o_custkey")]
_M = {"type": "merge", "rightQuery": "c", "leftKeys": ["o_custkey"], "rightKeys": ["c_custkey"]}
_C = ("customer", [_sel("c_custkey", "c_name", "c_nationkey")])
_OC = "(SELECT o_orderkey, o_custkey FROM orders) o {} (SELECT c_custkey, c_name, c_nationkey FROM customer) c ON o_custkey = c_custkey"
for _kind, _how in (("inner", "JOIN"), ("left", "LEFT JOIN")):
    _steps(f"pq_join_{_kind}", "orders", [*_O, _M | {"joinType": _kind}], f"SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM {_OC.format(_how)}", c=_C)
_steps("pq_join_leftsemi", "orders", [*_O, _M | {"joinType": "leftSemi"}], f"SELECT * FROM {_OC.format('SEMI JOIN')}", c=_C)
# most customers and suppliers have no partner with the same key and nation, some have
_L = [_sel("c_custkey", "c_nationkey", "c_name")]
_MS = {"type": "merge", "rightQuery": "s", "leftKeys": ["c_custkey", "c_nationkey"], "rightKeys": ["s_suppkey", "s_nationkey"]}
_S = ("supplier", [_sel("s_suppkey", "s_nationkey", "s_name")])
_LS = "(SELECT c_custkey, c_nationkey, c_name FROM customer) c"
_SS = "(SELECT s_suppkey, s_nationkey, s_name FROM supplier) s"
_ON = "ON c_custkey = s_suppkey AND c_nationkey = s_nationkey"
for _kind, _how in (("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    _steps(f"pq_join_{_kind}", "customer", [*_L, _MS | {"joinType": _kind}], f"SELECT coalesce(c_custkey, s_suppkey) AS c_custkey, coalesce(c_nationkey, s_nationkey) AS c_nationkey, c_name, s_name FROM {_LS} {_how} {_SS} {_ON}", s=_S)
_steps("pq_join_leftanti", "customer", [*_L, _MS | {"joinType": "leftAnti"}], f"SELECT * FROM {_LS} ANTI JOIN {_SS} {_ON}", s=_S)
_steps("pq_join_rightsemi", "customer", [*_L, _MS | {"joinType": "rightSemi"}], f"SELECT * FROM {_SS} SEMI JOIN {_LS} {_ON}", s=_S)
_steps("pq_join_rightanti", "customer", [*_L, _MS | {"joinType": "rightAnti"}], f"SELECT * FROM {_SS} ANTI JOIN {_LS} {_ON}", s=_S)
_steps("pq_join_take", "customer", [_sel("c_custkey", "c_nationkey", "c_acctbal"), _sort("-c_acctbal", "c_custkey"), _MS | {"joinType": "left", "leftKeys": ["c_nationkey"], "rightKeys": ["s_nationkey"]}, {"type": "take", "count": 40}, _sel("c_custkey", "s_suppkey")], "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey ORDER BY c_acctbal DESC, c_custkey, s_suppkey LIMIT 40", s=("supplier", [_sel("s_suppkey", "s_nationkey"), _sort("s_suppkey")]))
_steps("pq_join_index", "nation", [_sort("-n_name"), {"type": "merge", "rightQuery": "s", "leftKeys": ["n_nationkey"], "rightKeys": ["s_nationkey"], "joinType": "full"}, {"type": "addIndexColumn", "name": "i", "initialValue": 0, "increment": 1}, _sel("n_nationkey", "s_suppkey", "i")], "SELECT n_nationkey, s_suppkey, row_number() OVER (ORDER BY n_name DESC, s_suppkey DESC) - 1 AS i FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey", s=("supplier", [_sel("s_suppkey", "s_nationkey"), _sort("-s_suppkey")]))
_NULLED = {"type": "addColumn", "name": "k", EXPRESSION_KEY: "[n_regionkey] == 0 ? null : [n_regionkey]"}
_steps("pq_join_nullsafe", "nation", [_NULLED, {"type": "merge", "rightQuery": "r", "leftKeys": ["k"], "rightKeys": ["k"], "joinType": "inner"}, _sel("n_name", "r_name")], "SELECT n_name, r_name FROM nation JOIN region ON nullif(n_regionkey,0) IS NOT DISTINCT FROM nullif(r_regionkey,0)", r=("region", [{"type": "addColumn", "name": "k", EXPRESSION_KEY: "[r_regionkey] == 0 ? null : [r_regionkey]"}]))
_steps("pq_join_ignorecase", "nation", [{"type": "merge", "rightQuery": "n", "leftKeys": ["n_name"], "rightKeys": ["low"], "joinType": "inner", "comparer": {"comparer": "ordinalIgnoreCase"}}, _sel("n_nationkey", "key2")], "SELECT n_nationkey, n_nationkey AS key2 FROM nation", n=("nation", [{"type": "addColumn", "name": "low", EXPRESSION_KEY: "text_lower([n_name])"}, {"type": "renameColumn", "oldName": "n_nationkey", "newName": "key2"}, _sel("low", "key2")]))
_steps("pq_join_multikey", "lineitem", [_sel("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), {"type": "merge", "rightQuery": "l", "leftKeys": ["l_orderkey", "l_linenumber"], "rightKeys": ["l_orderkey", "l_linenumber"], "joinType": "inner"}], "SELECT a.l_orderkey, a.l_linenumber, a.l_suppkey, a.l_partkey, b.l_quantity FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber)", l=("lineitem", [_sel("l_orderkey", "l_linenumber", "l_quantity")]))
_NEST = {"type": "merge", "rightQuery": "n", "leftKeys": ["r_regionkey"], "rightKeys": ["n_regionkey"], "joinType": "left", "joinMode": "nested", "newColumnName": "nations"}


@register("pq_join_nested", "SELECT r_regionkey, r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1,2")
def _nested(spark, sf):
    from pyspark.sql import functions as F

    df = _engine(spark, sf, n=Query({"type": "table", "table": "nation"})).run(Query({"type": "table", "table": "region"}, [_NEST]))
    return df.select("r_regionkey", "r_name", F.size("nations").cast("long").alias("n"))


_steps("pq_join_expand", "region", [_NEST, {"type": "expandTableColumn", "column": "nations", "columns": ["n_name"], "newColumnNames": ["nation"]}], "SELECT r_regionkey, r_name, n_name AS nation FROM region LEFT JOIN nation ON r_regionkey = n_regionkey", n=("nation", []))


@register("pq_m_script", "SELECT l_returnflag, floor(sum(l_extendedprice)+0.5) AS \"Total\", count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_linestatus = 'O' GROUP BY 1")
def _m(spark, sf):
    q = compile_m("""
        let Source = Excel.CurrentWorkbook(){[Name="lineitem"]}[Content],
            #"Filtered Rows" = Table.SelectRows(Source, each [l_quantity] >= 10 and [l_linestatus] = "O"),
            #"Grouped Rows" = Table.Group(#"Filtered Rows", {"l_returnflag"}, {{"Total", each List.Sum([l_extendedprice])}, {"n", each Table.RowCount(_)}}),
            #"Rounded" = Table.TransformColumns(#"Grouped Rows", {{"Total", each Number.Round(_, 0), type number}}),
            #"Sorted Rows" = Table.Sort(#"Rounded", {{"l_returnflag", Order.Ascending}})
        in #"Sorted Rows" """)
    return _engine(spark, sf).run(q)


def _written(spark, sf, name: str, kind: str) -> str:
    """A table as files of another kind in the shared scratch folder; returns their place."""
    import uuid

    path = f"{scratch_root(spark)}/gridloom/sources/{name}-{uuid.uuid4().hex}"
    df = table(spark, sf, name)
    if kind == "csv":
        df.write.option("header", True).csv(path)
    else:  # one document: a list of rows, for a table that is small whatever the scale
        df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias("rows")))).write.text(path)
    return path


def _source(name: str, sql: str, source, steps: list[dict] = ()):
    @register(name, sql)
    def run(spark, sf):
        return Engine(spark).run(Query(source(spark, sf), list(steps)))


def _nations(spark, sf) -> list[dict]:
    """The 25 rows of nation, as a web service would give them."""
    return [r.asDict() for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]


def _paged(spark, sf):
    rows = _nations(spark, sf)
    return lambda url: {"value": rows[int(url.rsplit("=", 1)[1]) :][:10]} | ({"@odata.nextLink": f"http://x/n?$skip={int(url.rsplit('=', 1)[1]) + 10}"} if int(url.rsplit("=", 1)[1]) + 10 < len(rows) else {})


_NATIONS = "SELECT n_nationkey::double AS n_nationkey, n_name, n_regionkey::double AS n_regionkey FROM nation"
_source("src_csv", "SELECT c_custkey::int AS c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey >= 5", lambda spark, sf: {"type": "csv", "path": _written(spark, sf, "customer", "csv"), "options": {"hasHeaders": True}}, [_where(_cmp("c_nationkey", "greaterThanOrEqual", 5)), _sel("c_custkey", "c_name", "c_acctbal")])
_source("src_json", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1", lambda spark, sf: {"type": "json", "path": _written(spark, sf, "nation", "json"), "jsonPath": "$.rows"}, [_group(["n_regionkey"], ("n_nationkey", "count", "n"))])
_source("src_parquet_columns", "SELECT s_suppkey, s_name FROM supplier", lambda spark, sf: {"type": "parquet", "path": f"{sf}/supplier.parquet", "options": {"columns": ["s_suppkey", "s_name"]}})
_source("src_range", _NATIONS, lambda spark, sf: {"type": "range", "range": {"values": [["n_nationkey", "n_name", "n_regionkey"], *[[r["n_nationkey"], r["n_name"], r["n_regionkey"]] for r in _nations(spark, sf)]], "hasHeaders": True}})
_source("src_arrow", "SELECT n_nationkey, n_name, n_regionkey FROM nation", lambda spark, sf: {"type": "arrow", "table": table(spark, sf, "nation").toArrow()})
_source("src_folder", "SELECT 'part.parquet' AS \"Name\", '.parquet' AS \"Extension\"", lambda spark, sf: {"type": "folder", "path": f"{sf}/part.parquet"}, [_sel("Name", "Extension")])
_source("src_api", _NATIONS, lambda spark, sf: {"type": "api", "url": "http://x/nations", "fetch": (lambda rows: lambda url: rows)(_nations(spark, sf))})
_source("src_odata", _NATIONS, lambda spark, sf: {"type": "odata", "url": "http://x/n?$skip=0", "fetch": _paged(spark, sf)})
