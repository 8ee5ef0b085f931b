"""Worksheet pivots: subtotals, grand totals, show-as, calculated fields and items."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATIONS = {
    "sum": lambda x: F.sum(x), "count": lambda x: F.count(x), "average": lambda x: F.avg(x), "min": F.min, "max": F.max, "product": lambda x: F.product(x), "countNumbers": lambda x: F.count(x.cast("string").try_cast("double")),
    "stdDev": F.stddev_samp, "stdDevP": F.stddev_pop, "var": F.var_samp, "varP": F.var_pop,
}


@dataclass
class Value:
    """One value field. show: normal, percentOfGrandTotal, percentOfRowTotal, percentOfColumnTotal, percentOf or percentDifferenceFrom (with base_item)."""

    column: str
    aggregation: str = "sum"
    name: str | None = None
    show: str = "normal"
    base_field: str | None = None
    base_item: object = None


@dataclass
class PivotConfig:
    rows: list[str]
    columns: list[str] = field(default_factory=list)
    values: list[Value] = field(default_factory=list)
    filters: list[dict] = field(default_factory=list)
    subtotals: bool = True
    row_grand_totals: bool = True
    calculated_fields: dict[str, str] = field(default_factory=dict)  # name -> expression over value names
    calculated_items: list[tuple[str, object, list]] = field(default_factory=list)  # (field, new item, items that it sums)


def pivot(df: DataFrame, config: PivotConfig) -> DataFrame:
    """Long form: row and column fields, __level (0 detail; higher: that many fields rolled up), one column for each value.

    Subtotals come from one rollup, so detail and totals need one shuffle of
    partial aggregates.
    """
    from gridloom.functions.expression import compile_expression
    from gridloom.operators.predicate import compile_predicate

    for p in config.filters:
        df = df.filter(compile_predicate(p))
    for name, item, parts in config.calculated_items:
        df = df.unionByName(df.where(F.col(name).isin(parts)).withColumn(name, F.lit(item)))
    keys = [*config.rows, *config.columns]
    names = [v.name or f"{v.aggregation} of {v.column}" for v in config.values]
    aggs = [AGGREGATIONS[v.aggregation](F.col(v.column)).alias(n) for v, n in zip(config.values, names)]
    grouped = df.rollup(*keys) if config.subtotals or config.row_grand_totals else df.groupBy(*keys)
    if config.subtotals or config.row_grand_totals:
        out = grouped.agg(*aggs, F.grouping_id().alias("__g"))
        out = out.withColumn("__level", F.bit_count("__g").cast("int")).drop("__g")
        if not config.subtotals:
            out = out.where(F.col("__level").isin(0, len(keys)))
        if not config.row_grand_totals:
            out = out.where(F.col("__level") < len(keys))
    else:
        out = grouped.agg(*aggs).withColumn("__level", F.lit(0))
    for v, n in zip(config.values, names):
        if v.show != "normal":
            out = out.withColumn(n, show_as(v, n, config))
    for name, text in config.calculated_fields.items():
        out = out.withColumn(name, compile_expression(text, out.schema).column)
    return out


def show_as(v: Value, name: str, config: PivotConfig) -> Column:
    x = F.col(name).cast("double")
    level = F.col("__level")
    if v.show == "percentOfGrandTotal":
        return F.try_divide(x, F.sum(x).over(Window.partitionBy("__level")))
    if v.show == "percentOfRowTotal":
        return F.try_divide(x, F.sum(x).over(Window.partitionBy("__level", *config.rows)))
    if v.show == "percentOfColumnTotal":
        return F.try_divide(x, F.sum(x).over(Window.partitionBy("__level", *config.columns)))
    rest = [k for k in (*config.rows, *config.columns) if k != v.base_field]
    base = F.max(F.when(F.col(v.base_field).eqNullSafe(F.lit(v.base_item)), x)).over(Window.partitionBy("__level", *rest))
    part = F.try_divide(x, base)
    return F.when(level >= 0, part if v.show == "percentOf" else part - 1)


def crosstab(df: DataFrame, row: str, column: str, value: Value, items: list) -> DataFrame:
    """Wide form for one row and one column field."""
    return df.groupBy(row).pivot(column, items).agg(AGGREGATIONS[value.aggregation](F.col(value.column)))


def slicer_items(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct items in the order of their first appearance."""
    return df.groupBy(column).agg(F.min(order).alias("__o")).orderBy("__o").select(column)


def slicer(df: DataFrame, column: str, items: list | None) -> DataFrame:
    if items is None:
        return df
    test = F.col(column).isin([i for i in items if i is not None])
    return df.where(test | F.col(column).isNull() if None in items else test)


def timeline(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows whose date lies in the range, both ends included; values that are no dates fail."""
    d = F.col(column).try_cast("date") if dict(df.dtypes)[column] == "string" else F.col(column).cast("date")
    out = df.where(d.isNotNull())
    return out.where(d >= F.lit(start).cast("date") if start else F.lit(True)).where(d <= F.lit(end).cast("date") if end else F.lit(True))
