"""The table steps, each a function from DataFrame to DataFrame.

Steps whose result depends on row order read the hidden column ROW, which is
added (by add_row) only to plans that hold such a step. It comes from an
explicit sort where there is one; else from the order in which Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.expression import EXPRESSION_KEY, Typed, compile_expression, kind_of
from gridloom.operators.predicate import compile_predicate
from gridloom.runtime import materialize

ROW = "__row"
AGGREGATES = ("sum", "count", "average", "min", "max", "countDistinct")
#: Steps whose result depends on row order.
ORDERED = {"take", "skip", "removeRows", "distinctRows", "fillDown", "addIndexColumn", "promoteHeaders", "demoteHeaders"}


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def add_row(df: DataFrame) -> DataFrame:
    """df with ROW: rising in reading order, without a shuffle (not gapless)."""
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def ranged(df: DataFrame) -> DataFrame:
    """df by ranges of ROW, with __p (partition) and __k (place in it).

    Written once: both what counts the partitions and what reads their rows
    must see one and the same division, which a recomputed range partition
    does not promise.
    """
    dealt = df.repartitionByRange(ROW).sortWithinPartitions(ROW)
    return materialize(dealt.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__k")), "ranged")


def dense_row(df: DataFrame) -> DataFrame:
    """df with ROW made gapless from 0.

    Rows are range-partitioned by ROW and counted by partition, so only one
    row for each partition is numbered in one task.
    """
    if ROW not in df.columns:
        df = add_row(df)
    part = ranged(df)
    sizes = part.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = part.join(before, F.col("__p") == F.col("__q"))
    return joined.withColumn(ROW, F.col("__before") + F.col("__k")).drop("__p", "__q", "__k", "__before", "__n")


def unique_names(names: list[str]) -> list[str]:
    """Trimmed names; blank ones become ColumnN, later repeats get .1, .2 and so on."""
    out: list[str] = []
    for k, name in enumerate(names, 1):
        base = (name or "").strip() or f"Column{k}"
        now, n = base, 0
        while now in out:
            n += 1
            now = f"{base}.{n}"
        out.append(now)
    return out


def select_columns(df, columns):
    return df.select(*map(c, columns), *([ROW] if ROW in df.columns and ROW not in columns else []))


def remove_columns(df, columns):
    return df.drop(*columns)


def filter_rows(df, predicate):
    return df.filter(compile_predicate(predicate))


def sort_rows(df, sortBy):
    keys = []
    for s in sortBy:
        name = f"`{s['column']}`"
        down, first = s.get("direction") == "descending", s.get("nulls") == "first"
        keys.append((F.desc_nulls_first if first else F.desc_nulls_last)(name) if down else (F.asc_nulls_first if first else F.asc_nulls_last)(name))
    if ROW in df.columns:  # stable, and the new order becomes the row order
        return df.orderBy(*keys, ROW).withColumn(ROW, F.monotonically_increasing_id())
    return df.orderBy(*keys)


def _numeric(df: DataFrame, name: str) -> Column:
    return c(name).cast("double") if kind_of(df.schema[name].dataType) == "number" else c(name).cast("string").try_cast("double")


def aggregate(df: DataFrame, op: str, column: str) -> Column:
    if op == "sum":
        return F.coalesce(F.sum(_numeric(df, column)), F.lit(0.0))
    if op == "average":
        return F.avg(_numeric(df, column))
    if op == "count":
        return F.count(F.lit(1))
    if op in ("min", "max"):
        return getattr(F, op)(c(column))
    if op == "countDistinct":
        return F.count_distinct(c(column)) + F.max(c(column).isNull().cast("long"))
    raise ValueError(f"unknown aggregation {op!r}")


def group_by(df, groupColumns, aggregations):
    made = [aggregate(df, a["op"], a["column"]).alias(a.get("as") or f"{a['op']} of {a['column']}") for a in aggregations]
    if ROW in df.columns:
        made.append(F.min(ROW).alias(ROW))
    return df.groupBy(*map(c, groupColumns)).agg(*made)


def add_column(df, name, **expression):
    if name in df.columns:
        raise ValueError(f"column {name!r} is there already")
    return df.withColumn(name, compile_expression(expression[EXPRESSION_KEY], df.schema).column)


def rename_column(df, oldName, newName):
    if newName in df.columns and newName != oldName:
        raise ValueError(f"column {newName!r} is there already")
    return df.withColumnRenamed(oldName, newName)


_MS = 86_400_000


def change(v: Typed, new: str) -> Column:
    """A value as another type; what cannot be read becomes null, blank text too."""
    x = v.column
    blank = F.nullif(F.trim(x), F.lit("")) if v.kind == "text" else x
    if new in ("any",):
        return x
    if new == "string":
        return x.cast("string")
    if new == "number":
        return blank.try_cast("double") if v.kind == "text" else x.cast("double") if v.kind != "date" else F.unix_date(x).cast("double")
    if new == "decimal":
        return blank.try_cast("decimal(38,10)")
    if new == "boolean":
        return blank.try_cast("boolean") if v.kind == "text" else x.cast("boolean")
    if new == "date":
        return F.coalesce(blank.try_cast("date"), F.substring(blank, 1, 10).try_cast("date")) if v.kind == "text" else x.cast("date")
    if new in ("datetime", "datetimezone"):
        return blank.try_cast("timestamp") if v.kind == "text" else x.cast("timestamp")
    if new == "time":
        if v.kind == "number":
            return F.pmod(F.round(x * _MS).cast("long"), F.lit(_MS))
        m = lambda k: F.nullif(F.regexp_extract(blank, r"^(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?$", k), F.lit(""))
        return ((m(1).try_cast("double") * 3600 + m(2).try_cast("double") * 60 + F.coalesce(m(3).try_cast("double"), F.lit(0.0))) * 1000).cast("long")
    if new == "duration":
        if v.kind == "number":
            return F.round(x * _MS).cast("long")
        pattern = r"^(-)?P(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
        g = lambda k: F.coalesce(F.regexp_extract(blank, pattern, k).try_cast("double"), F.lit(0.0))
        total = (g(2) * 86400 + g(3) * 3600 + g(4) * 60 + g(5)) * 1000
        return F.when(blank.rlike(pattern), F.when(F.regexp_extract(blank, pattern, 1) == "-", -total).otherwise(total)).cast("long")
    if new == "binary":
        return F.try_to_binary(blank, F.lit("base64")) if v.kind == "text" else x.cast("binary")
    raise ValueError(f"unknown type {new!r}")


def change_type(df, column, newType):
    return df.withColumn(column, change(Typed(c(column), kind_of(df.schema[column].dataType)), newType))


def take(df, count):
    return df.orderBy(ROW).limit(count)


def skip(df, count):
    return df.orderBy(ROW).offset(count)


def remove_rows(df, offset, count):
    return dense_row(df).filter((F.col(ROW) < offset) | (F.col(ROW) >= offset + count))


def pivot(df, rowColumn, valueColumn, aggregation="sum", values=None):
    rest = [n for n in df.columns if n not in (rowColumn, valueColumn, ROW)]
    grouped = df.groupBy(*map(c, rest)).pivot(rowColumn, values) if values else df.groupBy(*map(c, rest)).pivot(rowColumn)
    return grouped.agg(aggregate(df, aggregation, valueColumn))


def unpivot(df, columns, nameColumn, valueColumn):
    kinds = {df.schema[n].dataType.simpleString() for n in columns}
    ids = [n for n in df.columns if n not in columns]
    if len(kinds) > 1:
        df = df.select(*map(c, ids), *[c(n).cast("double" if all(kind_of(df.schema[m].dataType) == "number" for m in columns) else "string").alias(n) for n in columns])
    return df.unpivot(ids, columns, nameColumn, valueColumn)


def distinct_rows(df, columns=None):
    keys = columns or [n for n in df.columns if n != ROW]
    if columns is None and ROW not in df.columns:
        return df.dropDuplicates(keys)
    rest = [n for n in df.columns if n not in keys]
    first = F.min_by(F.struct(*map(c, rest)), F.col(ROW)).alias("__first")
    return df.groupBy(*map(c, keys)).agg(first).select(*[c(n) if n in keys else F.col(f"__first.`{n}`").alias(n) for n in df.columns])


def transform_columns(df, transforms):
    made = {}
    for t in transforms:
        v = compile_expression(t[EXPRESSION_KEY], df.schema, t["column"])
        made[t["column"]] = change(v, t["newType"]) if t.get("newType") else v.column
    return df.withColumns(made)


def fill_down(df, columns):
    """Last value above that is not null. In reading order; partitions hand their last values on by a small table."""
    part = ranged(df)
    own = Window.partitionBy("__p").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    lasts = part.groupBy("__p").agg(*[F.max_by(c(n), F.when(c(n).isNotNull(), F.col(ROW))).alias(f"__l{k}") for k, n in enumerate(columns)])
    up = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    above = lasts.select(F.col("__p").alias("__q"), *[F.last(f"__l{k}", ignorenulls=True).over(up).alias(f"__a{k}") for k in range(len(columns))])
    joined = part.join(above, F.col("__p") == F.col("__q"))
    filled = {n: F.coalesce(F.last(c(n), ignorenulls=True).over(own), F.col(f"__a{k}")) for k, n in enumerate(columns)}
    return joined.withColumns(filled).select(*map(c, df.columns))


def replace_values(df, column, find, replace):
    return df.withColumn(column, F.when(c(column).eqNullSafe(F.lit(find)), F.lit(replace)).otherwise(c(column)))


def split_column(df, column, delimiter, newColumns=None):
    parts = F.split(c(column).cast("string"), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    if not newColumns:
        width = df.agg(F.max(F.size(parts))).first()[0] or 1
        newColumns = [f"{column}.{k}" for k in range(1, width + 1)]
    made = [F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(newColumns)]
    out: list = []
    for n in df.columns:
        out += made if n == column else [c(n)]
    return df.select(*out)


def promote_headers(df):
    head = df.orderBy(ROW).first()
    data = [n for n in df.columns if n != ROW]
    names = unique_names([None if head is None or head[n] is None else str(head[n]) for n in data])
    rest = df if head is None else df.filter(F.col(ROW) != head[ROW])
    return rest.select(*[c(n).alias(m) for n, m in zip(data, names)], ROW)


def demote_headers(df):
    data = [n for n in df.columns if n != ROW]
    names = [f"Column{k}" for k in range(1, len(data) + 1)]
    body = df.select(*[c(n).cast("string").alias(m) for n, m in zip(data, names)], ROW)
    head = df.sparkSession.createDataFrame([(*data, -1)], ", ".join(f"{m} string" for m in names) + f", {ROW} long")
    return head.unionByName(body)


def reorder_columns(df, columns, missingField="error"):
    have = [n for n in df.columns if n != ROW]
    lost = [n for n in columns if n not in have]
    if lost and missingField == "error":
        raise KeyError(f"unknown columns {lost}")
    if missingField == "useNull":
        df = df.withColumns({n: F.lit(None).cast("string") for n in lost}) if lost else df
        have += lost
    columns = [n for n in columns if n in have]
    return df.select(*map(c, columns), *[c(n) for n in df.columns if n not in columns])


def add_index_column(df, name, initialValue=0, increment=1):
    out = dense_row(df)
    return out.withColumn(name, F.lit(initialValue) + F.col(ROW) * F.lit(increment))


def combine_columns(df, columns, delimiter, newColumnName):
    made = F.concat_ws(delimiter, *[F.coalesce(c(n).cast("string"), F.lit("")) for n in columns]).alias(newColumnName)
    out: list = []
    for n in df.columns:
        if n == columns[0]:
            out.append(made)
        if n not in columns:
            out.append(c(n))
    return df.select(*out)


def transform_column_names(df, transform):
    f = {"upper": str.upper, "lower": str.lower, "trim": str.strip}[transform]
    names = unique_names([f(n) for n in df.columns if n != ROW])
    return df.toDF(*names, *([ROW] if ROW in df.columns else []))


def error_column(name: str) -> str:
    """Where a step leaves error codes as values, they stand in this column beside the value."""
    return f"{name}__err"


def remove_rows_with_errors(df, columns=None):
    for n in columns or [x for x in df.columns if error_column(x) in df.columns]:
        if error_column(n) in df.columns:
            df = df.filter(c(error_column(n)).isNull())
    return df


def replace_error_values(df, replacements):
    for r in replacements:
        n, e = r["column"], error_column(r["column"])
        if e in df.columns:
            df = df.withColumn(n, F.when(c(e).isNotNull(), F.lit(r["value"])).otherwise(c(n))).withColumn(e, F.lit(None).cast("string"))
    return df


def append(df, others):
    for other in others:
        df = df.unionByName(other, allowMissingColumns=True)
    return df


STEPS = {
    "selectColumns": select_columns, "removeColumns": remove_columns, "filterRows": filter_rows, "sortRows": sort_rows, "groupBy": group_by, "addColumn": add_column,
    "renameColumn": rename_column, "changeType": change_type, "take": take, "skip": skip, "removeRows": remove_rows, "pivot": pivot, "unpivot": unpivot,
    "distinctRows": distinct_rows, "removeRowsWithErrors": remove_rows_with_errors, "transformColumns": transform_columns, "fillDown": fill_down,
    "replaceValues": replace_values, "splitColumn": split_column, "promoteHeaders": promote_headers, "demoteHeaders": demote_headers, "reorderColumns": reorder_columns,
    "addIndexColumn": add_index_column, "combineColumns": combine_columns, "transformColumnNames": transform_column_names, "replaceErrorValues": replace_error_values,
}
