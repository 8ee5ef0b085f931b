"""Column statistics, masks, grouped kernels, range statistics, anomalies and upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_stats(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """A row for each column: distinct, nulls, min, max, sum, avg_length; one pass over the data."""
    columns = columns or df.columns
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = []
    for k, n in enumerate(columns):
        c, number = F.col(n), isinstance(df.schema[n].dataType, T.NumericType)
        aggs.append(F.struct(F.lit(n).alias("column"), distinct(c).alias("distinct"), F.count_if(c.isNull()).alias("nulls"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), (F.sum(c.cast("double")) if number else F.lit(None).cast("double")).alias("sum"), (F.avg(F.length(c)) if isinstance(df.schema[n].dataType, T.StringType) else F.lit(None).cast("double")).alias("avg_length")).alias(f"s{k}"))
    return df.agg(*aggs).select(F.explode(F.array(*[f"s{k}" for k in range(len(columns))])).alias("s")).select("s.*")


def filter_mask(df: DataFrame, test: Column, name: str = "mask") -> DataFrame:
    return df.withColumn(name, F.coalesce(test, F.lit(False)))


def group_by_mask(df: DataFrame, test: Column, keys: list[str], aggs: list[Column]) -> DataFrame:
    return df.where(test).groupBy(*keys).agg(*aggs)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins; NaN and nulls are left out, what lies outside goes to the edge bins."""
    x = F.col(column).cast("double")
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - low) / (high - low) * bins)))
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def describe_range(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, sum, mean, min, max, variance, stdev, median, q1, q3 of numbers; text that reads as a number counts."""
    x = F.col(column).cast("string").try_cast("double")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*(by or [])).agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("stdev"), q[1].alias("median"), q[0].alias("q1"), q[2].alias("q3"))


def zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose z score is above the threshold in size, with z. The moments are one row, joined on."""
    x = F.col(column).cast("double")
    m = df.agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    out = df.join(F.broadcast(m)).withColumn("z", F.when(F.col("__s") > 0, (x - F.col("__m")) / F.col("__s")).otherwise(0.0))
    return out.where(F.abs("z") >= threshold).drop("__m", "__s")


def iqr(df: DataFrame, column: str, width: float = 1.5) -> DataFrame:
    x = F.col(column).cast("double")
    q = df.agg(F.percentile(x, F.lit(0.25)).alias("__a"), F.percentile(x, F.lit(0.75)).alias("__b"))
    out = df.join(F.broadcast(q))
    return out.where((x < F.col("__a") - width * (F.col("__b") - F.col("__a"))) | (x > F.col("__b") + width * (F.col("__b") - F.col("__a")))).drop("__a", "__b")


def isolation_forest(df: DataFrame, column: str, trees: int = 50, sample: int = 256, seed: int = 7, key: list[str] | None = None) -> DataFrame:
    """df with score (0 to 1, higher: more isolated). Trees grow on the driver from a bounded sample; scoring is a vectorised map.

    The sample is uniform over rows: those with the smallest hashes of `key`,
    columns that tell all rows apart, or without it of the rows' numbers, which
    depend on how the table is partitioned.
    """
    import math

    import numpy as np

    row = F.xxhash64(*(key or [F.monotonically_increasing_id()]))
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"), row.alias("row")).orderBy("row").limit(sample * 8).select("v").toPandas().iloc[:, 0].to_numpy()
    rng = np.random.default_rng(seed)
    norm = lambda n: 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n > 1)
    size = min(sample, len(rows))

    def grow(v, depth, limit):
        if depth >= limit or len(v) <= 1 or v.min() == v.max():
            return (depth + norm(len(v)),)
        cut = rng.uniform(v.min(), v.max())
        return (cut, grow(v[v < cut], depth + 1, limit), grow(v[v >= cut], depth + 1, limit))

    forest = [grow(rng.choice(rows, size, replace=False), 0, math.ceil(math.log2(max(2, size)))) for _ in range(trees)] if size else []

    def path(tree, v, at, out):
        if len(tree) == 1:
            out[at] += tree[0]
            return
        left = v < tree[0]
        path(tree[1], v[left], at[left], out)
        path(tree[2], v[~left], at[~left], out)

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        v = s.to_numpy(float)
        out = np.zeros(len(v))
        for t in forest:
            path(t, v, np.arange(len(v)), out)
        return pd.Series(2 ** (-out / max(1, len(forest)) / max(norm(size), 1e-9)))

    return df.withColumn("score", score(F.col(column).cast("double")))


def anomalies(df: DataFrame, column: str, threshold: float = 0.65, **forest) -> DataFrame:
    """The rows that the isolation forest finds isolated, most isolated first.

    A threshold up to 1 is the least score, one above 1 the number of rows to give.
    """
    scored = isolation_forest(df, column, **forest).where(F.col(column).isNotNull())
    if threshold <= 0:
        raise ValueError("the threshold has to be above 0")
    ranked = scored.orderBy(F.desc("score"), column)
    return ranked.limit(int(threshold)) if threshold > 1 else ranked.where(F.col("score") >= threshold)


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("correlation"))


def upsert(base: DataFrame, delta: DataFrame, key: list[str], version: str, deleted: str | None = None) -> DataFrame:
    """base with the latest row of each key; rows of delta marked deleted take the key away."""
    delta = delta if deleted else delta.withColumn("__del", F.lit(False))
    mark = deleted or "__del"
    both = base.withColumn(mark, F.lit(False)).unionByName(delta, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key]
    last = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(version))).alias("__r"))
    return last.select(*key, "__r.*").where(~F.coalesce(F.col(mark), F.lit(False))).select(*base.columns)


def worksheet_sort(df: DataFrame, columns: list[tuple[str, bool]], case_sensitive: bool = False) -> DataFrame:
    """Order of cell kinds in a text column: numbers, text, logicals, errors, blanks; blanks last in both directions."""
    from gridloom.functions.cells.math import ERRORS

    keys = []
    for name, down in columns:
        s = F.col(name).cast("string")
        n = s.try_cast("double")
        rank = F.when(s.isNull() | (s == ""), 4).when(s.isin(*ERRORS), 3).when(F.lower(s).isin("true", "false"), 2).when(n.isNotNull(), 0).otherwise(1)
        text = s if case_sensitive else F.lower(s)
        blank = (rank == 4).cast("int")
        keys += [blank.asc(), rank.desc() if down else rank.asc(), n.desc() if down else n.asc(), text.desc() if down else text.asc()]
    return df.orderBy(*keys)


def running(df: DataFrame, value: str, order: list[str], by: list[str], name: str = "running") -> DataFrame:
    """A running sum by group."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def auto_filter(df: DataFrame, criteria: dict[str, dict], today=None) -> DataFrame:
    """Column criteria joined by and; each {"join": "any" | "all", "criteria": [(op, value[, value2]), ...]}."""
    from functools import reduce

    d = lambda v: F.lit(v).cast("date")
    now = d(today) if today else F.current_date()
    for name, c in criteria.items():
        x, s = F.col(name), F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))
        n = F.col(name).cast("string").try_cast("double")
        made = []
        for op, *v in c["criteria"]:
            made.append({
                "equals": lambda: s == str(v[0]).lower(), "contains": lambda: s.contains(str(v[0]).lower()), "beginsWith": lambda: s.startswith(str(v[0]).lower()), "endsWith": lambda: s.endswith(str(v[0]).lower()),
                ">": lambda: n > v[0], ">=": lambda: n >= v[0], "<": lambda: n < v[0], "<=": lambda: n <= v[0], "between": lambda: n.between(v[0], v[1]), "<>": lambda: n != v[0],
                "after": lambda: x.cast("date") > d(v[0]), "before": lambda: x.cast("date") < d(v[0]), "dateBetween": lambda: x.cast("date").between(d(v[0]), d(v[1])), "on": lambda: x.cast("date") == d(v[0]),
                "today": lambda: x.cast("date") == now, "yesterday": lambda: x.cast("date") == F.date_sub(now, 1), "tomorrow": lambda: x.cast("date") == F.date_add(now, 1), "blanks": lambda: s == "", "nonBlanks": lambda: s != "",
            }[op]())
        df = df.where(reduce((lambda a, b: a | b) if c.get("join", "any") == "any" else (lambda a, b: a & b), [F.coalesce(m, F.lit(False)) for m in made]))
    return df
