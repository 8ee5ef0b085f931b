"""Merges: eight kinds of null-safe equi-joins, flat or nested."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.steps import ROW, c

_RIGHT = "__right_row"
KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "leftSemi": "left_semi", "leftAnti": "left_anti", "rightSemi": "left_semi", "rightAnti": "left_anti"}
_HINTS = {"sortMerge": "merge", "leftHash": "shuffle_hash", "rightHash": "shuffle_hash", "pairwiseHash": "shuffle_hash"}


def _ignores_case(comparers, comparer, k: int) -> bool:
    found = comparers[k] if comparers else comparer
    return bool(found) and (found.get("caseSensitive") is False or "ignorecase" in str(found.get("comparer", "")).lower())


def merge(left: DataFrame, right: DataFrame, joinType: str = "inner", leftKeys=None, rightKeys=None, leftKey=None, rightKey=None, comparer=None, comparers=None, joinAlgorithm=None, joinMode: str = "flat", newColumnName: str | None = None, rightColumns=None) -> DataFrame:
    """Null keys match null keys. Flat output: left columns, then right columns that are not keys (repeats get .1, .2).

    Nested output: one row for each left row, with an array of right rows.
    Where left carries ROW, the result does: rows stand in left order, those
    of one left row in right order, right rows without a left one at the end.
    """
    leftKeys, rightKeys = leftKeys or [leftKey], rightKeys or [rightKey]
    if len(leftKeys) != len(rightKeys) or not leftKeys:
        raise ValueError("as many left keys as right keys are needed")
    ordered, right = ROW in left.columns, right.drop(ROW)
    if ordered:
        right = right.withColumn(_RIGHT, F.monotonically_increasing_id())
        out = _joined(left, right, joinType, leftKeys, rightKeys, comparer, comparers, joinAlgorithm, joinMode, newColumnName, rightColumns or (right.drop(_RIGHT).columns if joinMode == "nested" else None))
        if joinMode == "nested" or KINDS[joinType] in ("left_semi", "left_anti"):
            return out.withColumnRenamed(_RIGHT, ROW) if joinType.startswith("right") else out
        sort = out.orderBy(F.asc_nulls_last(ROW), _RIGHT)
        return sort.withColumn(ROW, F.monotonically_increasing_id()).drop(_RIGHT)
    return _joined(left, right, joinType, leftKeys, rightKeys, comparer, comparers, joinAlgorithm, joinMode, newColumnName, rightColumns)


def _joined(left, right, joinType, leftKeys, rightKeys, comparer, comparers, joinAlgorithm, joinMode, newColumnName, rightColumns) -> DataFrame:
    if (joinAlgorithm or "").split(".")[-1] in _HINTS:
        right = right.hint(_HINTS[joinAlgorithm.split(".")[-1]])
    inner = right.select(*[c(n).alias(f"__r{k}") for k, n in enumerate(right.columns)])
    where = {n: f"__r{k}" for k, n in enumerate(right.columns)}

    def side(df, name, alias, k):
        key = F.col(f"`{alias}`") if alias else c(name)
        fold = _ignores_case(comparers, comparer, k) and isinstance(df.schema[name].dataType, T.StringType)
        return F.lower(key) if fold else key

    on = reduce(lambda a, b: a & b, [side(left, lk, None, k).eqNullSafe(side(right, rk, where[rk], k)) for k, (lk, rk) in enumerate(zip(leftKeys, rightKeys))])
    how = KINDS[joinType]
    if joinType in ("rightSemi", "rightAnti"):
        return inner.join(left, on, how).select(*[F.col(where[n]).alias(n) for n in right.columns])
    if how in ("left_semi", "left_anti"):
        return left.join(inner, on, how)
    if joinMode == "nested":
        shown = rightColumns or right.columns
        order = [_RIGHT] if _RIGHT in right.columns else []
        packed = F.struct(*[F.col(where[n]).alias(n) for n in [*order, *shown]])
        keys = [side(right, rk, where[rk], k).alias(f"__k{k}") for k, rk in enumerate(rightKeys)]
        lists = inner.select(*keys, packed.alias("__s")).groupBy(*[f"__k{k}" for k in range(len(keys))]).agg((F.sort_array(F.collect_list("__s")) if order else F.collect_list("__s")).alias(newColumnName))
        if order:
            lists = lists.withColumn(newColumnName, F.transform(c(newColumnName), lambda s: F.struct(*[s.getField(n).alias(n) for n in shown])))
        match = reduce(lambda a, b: a & b, [side(left, lk, None, k).eqNullSafe(F.col(f"__k{k}")) for k, lk in enumerate(leftKeys)])
        out = left.join(lists, match, how if how in ("inner", "left") else "left").drop(*[f"__k{k}" for k in range(len(keys))])
        kind = T.ArrayType(T.StructType([T.StructField(n, right.schema[n].dataType) for n in shown]))
        return out.withColumn(newColumnName, F.coalesce(c(newColumnName), F.array().cast(kind)))
    joined = left.join(inner, on, how)
    names, out = list(left.columns), []
    for n in left.columns:
        if how in ("right", "full") and n in leftKeys:
            out.append(F.coalesce(c(n), F.col(where[rightKeys[leftKeys.index(n)]])).alias(n))
        else:
            out.append(c(n))
    for n in right.columns:
        if n not in rightKeys:
            new, k = n, 0
            while new in names:
                k += 1
                new = f"{n}.{k}"
            names.append(new)
            out.append(F.col(where[n]).alias(new))
    return joined.select(*out)


def expand_table_column(df: DataFrame, column: str, columns=None, newColumnNames=None) -> DataFrame:
    """One row for each nested row; a left row with none stays once, with nulls."""
    fields = columns or df.schema[column].dataType.elementType.names
    names = newColumnNames or fields
    rest = [n for n in df.columns if n != column]
    rows = df.select(*map(c, rest), F.posexplode_outer(c(column)).alias("__at", "__n"))
    taken = list(rest)
    out = []
    for f, n in zip(fields, names):
        new, k = n, 0
        while new in taken:
            k += 1
            new = f"{n}.{k}"
        taken.append(new)
        out.append(F.col(f"__n.`{f}`").alias(new))
    if ROW in rest:
        return rows.orderBy(ROW, "__at").select(*map(c, [n for n in rest if n != ROW]), *out, F.monotonically_increasing_id().alias(ROW))
    return rows.select(*map(c, rest), *out)
