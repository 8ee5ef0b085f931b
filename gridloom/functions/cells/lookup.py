"""Lookup, reference and dynamic-array functions. Tables are DataFrames; arrays are array Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.cells import define
from gridloom.functions.cells.aggregates import wildcard
from gridloom.functions.cells.math import _num, col
from gridloom.runtime import materialize
from gridloom.operators.steps import ROW, add_row, dense_row

lit = F.lit


@define("VLOOKUP XLOOKUP", "table")
def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, result: str | list[str], mode: int | str = "exact", missing=None, last: bool = False, order: str | None = None) -> DataFrame:
    """df with the result columns of the matching table row.

    mode: "exact" (first match in reading order, or by `order`; last=True for
    the last), -1 (exact or next smaller), 1 (exact or next larger). Exact
    keys of text match without case. The approximate modes are as-of joins:
    both sides are merged in key order and the last (next) table row is
    carried along, with no comparison of all pairs.
    """
    results = [result] if isinstance(result, str) else list(result)
    if mode == "exact":
        fold = lambda c, d: F.lower(c) if d.dataType.typeName() == "string" else c
        t = table if order else add_row(table)
        pick = F.max_by if last else F.min_by
        k = fold(F.col(f"`{table_key}`"), table.schema[table_key]).alias("__k")
        one = t.groupBy(k).agg(pick(F.struct(*[F.col(f"`{r}`") for r in results]), F.col(order or ROW)).alias("__r"))
        joined = df.join(one, fold(F.col(f"`{key}`"), df.schema[key]) == F.col("__k"), "left").drop("__k")
        rows = joined.select(*df.columns, F.col("__r").isNull().alias("__miss"), *[F.col(f"__r.`{r}`").alias(r) for r in results])
        for r in results if missing is not None else []:
            rows = rows.withColumn(r, F.when(F.col("__miss"), lit(missing)).otherwise(F.col(f"`{r}`")))
        return rows.drop("__miss")
    return asof(df, key, table, table_key, results, forward=mode == 1)


def asof(df: DataFrame, key: str, table: DataFrame, table_key: str, results: list[str], by: list[str] | None = None, forward: bool = False) -> DataFrame:
    """The table row with the largest key at or below each key (or the smallest at or above).

    With `by`, the merge runs for each group. Without, keys are ranged over
    partitions and a carry row for each partition is passed on, so no task
    holds all rows.
    """
    packed = F.struct(F.col(f"`{table_key}`").alias("__tk"), *[F.col(f"`{r}`") for r in results])
    by = by or []
    left = df.select(*by, F.col(f"`{key}`").cast("double").alias("__o"), lit(1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__l"), lit(None).cast(table.select(packed).schema[0].dataType).alias("__r"))
    right = table.select(*by, F.col(f"`{table_key}`").cast("double").alias("__o"), lit(0).alias("__side"), lit(None).cast(left.schema["__l"].dataType).alias("__l"), packed.alias("__r"))
    both = left.unionByName(right)
    sign = -1 if forward else 1
    both = both.withColumn("__s", F.col("__o") * sign)
    if by:
        w = Window.partitionBy(*by).orderBy("__s", "__side").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("__f", F.last("__r", ignorenulls=True).over(w))
    else:
        dealt = both.repartitionByRange("__s", "__side").sortWithinPartitions("__s", "__side")
        part = materialize(dealt.withColumn("__p", F.spark_partition_id()), "asof")  # written once: the carries need the same division
        w = Window.partitionBy("__p").orderBy("__s", "__side").rowsBetween(Window.unboundedPreceding, 0)
        carry = part.where("__r IS NOT NULL").groupBy("__p").agg(F.max_by("__r", "__s").alias("__c"))
        parts = part.select("__p").distinct().join(carry, "__p", "left")
        parts = parts.select(F.col("__p").alias("__q"), F.last("__c", ignorenulls=True).over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__c"))
        found = part.join(parts, F.col("__p") == F.col("__q")).withColumn("__f", F.coalesce(F.last("__r", ignorenulls=True).over(w), F.col("__c")))
    return found.where("__side = 1").select(*[F.col(f"__l.`{c}`").alias(c) for c in df.columns], *[F.when(F.col("__o").isNotNull(), F.col(f"__f.`{r}`")).alias(r) for r in results])


@define("HLOOKUP", "table")
def hlookup(df: DataFrame, key: str, table: DataFrame, row: int) -> DataFrame:
    """Header names as keys: the value in data row `row` (from 1) of the column so named."""
    values = dense_row(table).where(F.col(ROW) == row - 1).drop(ROW)
    pairs = values.select(F.explode(F.array(*[F.struct(lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in table.columns])).alias("x")).select("x.*")
    return lookup(df, key, pairs, "k", "v")


@define("LOOKUP", "table")
def lookup_last(df: DataFrame, key: str, table: DataFrame, table_key: str, result: str) -> DataFrame:
    return asof(df, key, table, table_key, [result])


@define("MATCH XMATCH", "table")
def match(df: DataFrame, key: str, table: DataFrame, table_key: str, mode: int | str = "exact", last: bool = False) -> DataFrame:
    """df with position: the row number (from 1) of the match in the table's reading order."""
    numbered = dense_row(table).withColumn("position", F.col(ROW) + 1).drop(ROW)
    return lookup(df, key, numbered, table_key, "position", mode, None, last, "position") if mode == "exact" else asof(df, key, numbered, table_key, ["position"], forward=mode == 1)


@define("XLOOKUP.WILDCARD", "table")
def wildcard_lookup(table: DataFrame, table_key: str, pattern: str, result: str) -> DataFrame:
    """The first row whose key matches a constant pattern."""
    return add_row(table).where(F.col(table_key).rlike(wildcard(pattern))).agg(F.min_by(result, ROW).alias(result))


def _start(x) -> Column:
    return lit(float(x)) if isinstance(x, int) and not isinstance(x, bool) else col(x)


# --- arrays as Columns
define("INDEX", "array")(lambda a, r, c=None: F.try_element_at(a, _num(r).cast("int")) if c is None else F.try_element_at(F.try_element_at(a, _num(r).cast("int")), _num(c).cast("int")))
define("TAKE", "array")(lambda a, n: F.when(_num(n) >= 0, F.slice(a, lit(1), F.least(_num(n).cast("int"), F.size(a)))).otherwise(F.slice(a, F.greatest(F.size(a) + _num(n).cast("int") + 1, lit(1)), F.size(a))))
define("DROP", "array")(lambda a, n: F.when(_num(n) >= 0, F.slice(a, _num(n).cast("int") + 1, F.size(a))).otherwise(F.slice(a, lit(1), F.greatest(F.size(a) + _num(n).cast("int"), lit(0)))))
define("SORT", "array")(lambda a, order=1: F.sort_array(a, order == 1))
define("SORTBY", "array")(lambda a, b, order=1: F.transform(F.sort_array(F.zip_with(a, F.transform(b, lambda v, i: F.struct(v.alias("k"), i.alias("i"))), lambda v, k: F.struct(k.alias("k"), v.alias("v"))), order == 1), lambda s: s["v"]))
define("UNIQUE", "array")(lambda a, once=False: F.filter(F.array_distinct(a), lambda v: F.size(F.filter(a, lambda w: w.eqNullSafe(v))) == 1) if once else F.array_distinct(a))
define("FILTER", "array")(lambda a, mask: F.transform(F.filter(F.arrays_zip(a.alias("v"), mask.alias("m")), lambda s: s["m"].cast("boolean")), lambda s: s["v"]))
define("MAP", "array")(lambda *xs: F.transform(xs[0], xs[1]) if len(xs) == 2 else F.zip_with(*xs))
define("REDUCE", "array")(lambda start, a, f: F.aggregate(a, _start(start), f))
define("SCAN", "array")(lambda start, a, f: F.slice(F.aggregate(a, F.array(_start(start)), lambda s, v: F.concat(s, F.array(f(F.element_at(s, -1), v)))), lit(2), F.size(a)))
define("BYROW", "array")(lambda a, f: F.transform(a, f))
define("TRANSPOSE", "array")(lambda a: F.transform(F.sequence(lit(1), F.size(F.element_at(a, 1))), lambda k: F.transform(a, lambda r: F.element_at(r, k))))
define("BYCOL", "array")(lambda a, f: F.transform(F.transform(F.sequence(lit(1), F.size(F.element_at(a, 1))), lambda k: F.transform(a, lambda r: F.element_at(r, k))), f))
define("MAKEARRAY", "array")(lambda r, c, f: F.transform(F.sequence(lit(1), _num(r).cast("int")), lambda i: F.transform(F.sequence(lit(1), _num(c).cast("int")), lambda j: f(i, j))))
define("TOCOL TOROW", "array")(lambda a, ignore=0: F.filter(F.flatten(a), lambda v: v.isNotNull()) if ignore in (1, 3) else F.flatten(a))
define("VSTACK", "array")(lambda *xs: F.concat(*xs))
define("HSTACK", "array")(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)))
define("WRAPROWS", "array")(lambda a, n, pad=None: F.transform(F.sequence(lit(0), F.ceil(F.size(a) / n).cast("int") - 1), lambda r: F.transform(F.sequence(lit(1), lit(int(n))), lambda k: F.coalesce(F.try_element_at(a, r * int(n) + k), lit(pad)))))
define("WRAPCOLS", "array")(lambda a, n, pad=None: F.transform(F.sequence(lit(1), lit(int(n))), lambda r: F.transform(F.sequence(lit(0), F.ceil(F.size(a) / n).cast("int") - 1), lambda k: F.coalesce(F.try_element_at(a, k * int(n) + r), lit(pad)))))
define("EXPAND", "array")(lambda a, rows, columns, pad=None: F.transform(F.sequence(lit(1), lit(int(rows))), lambda r: F.transform(F.sequence(lit(1), lit(int(columns))), lambda k: F.coalesce(F.try_element_at(F.try_element_at(a, r), k), lit(pad)))))
define("CHOOSEROWS", "array")(lambda a, *ks: F.array(*[F.try_element_at(a, lit(int(k))) for k in ks]))
define("CHOOSECOLS", "array")(lambda a, *ks: F.transform(a, lambda r: F.array(*[F.try_element_at(r, lit(int(k))) for k in ks])))
define("LAMBDA")(lambda f: f)
define("LET")(lambda *xs: xs[-1](*xs[:-1]) if callable(xs[-1]) and not isinstance(xs[-1], Column) else xs[-1])
define("COLUMNS", "table")(lambda df: len([c for c in df.columns if c != ROW]))
define("COLUMN", "table")(lambda df, name: df.columns.index(name) + 1)
define("ROW", "table")(lambda df: dense_row(df).withColumn("row", F.col(ROW) + 1).drop(ROW))
define("AREAS", "table")(lambda *ranges: len(ranges))
define("OFFSET INDIRECT", "table")(lambda df, top, left=0, height=None, width=None: dense_row(df).where((F.col(ROW) >= top) & (F.col(ROW) < (top + height if height is not None else 1 << 62))).drop(ROW).select(*df.columns[left : left + width if width is not None else None]))
define("RTD", "table")(lambda spark, source, *topics: spark.readStream.format(source).load())


# --- cube functions: members and values of a star-schema model
@define("CUBEVALUE", "table")
def cube_value(model, measure: str, *members: str) -> DataFrame:
    """A measure under filters such as 'region[r_name] = "ASIA"'."""
    return model.evaluate(measure, list(members))


define("CUBESET", "table")(lambda model, table, column, order=True: model.table(f"DISTINCT({table}[{column}])").orderBy(F.col(f"`{model.column(table, column)[0]}[{model.column(table, column)[1]}]`").asc() if order else F.desc(f"`{model.column(table, column)[0]}[{model.column(table, column)[1]}]`")))
define("CUBESETCOUNT", "table")(lambda members: members.count())
define("CUBERANKEDMEMBER", "table")(lambda members, k: members.offset(k - 1).limit(1))
define("CUBEMEMBER", "table")(lambda model, table, column, value: model.table(f'FILTER(DISTINCT({table}[{column}]), {table}[{column}] = "{value}")'))
define("CUBEMEMBERPROPERTY", "table")(lambda model, table, column, value, prop: model.tables[model.name(table)].where(F.col(column) == value).select(prop).limit(1))
define("CUBEKPIMEMBER", "table")(lambda model, kpi, prop="value": model.evaluate(f"[{kpi}]"))
define("GETPIVOTDATA", "table")(lambda pivot, value, *pairs: pivot.where(" AND ".join(["true"] + [f"`{k}` = '{v}'" for k, v in zip(pairs[::2], pairs[1::2])])).select(value))
