"""Aggregates over columns, conditional aggregates, criteria, database functions and rank windows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.cells import define
from gridloom.functions.cells.math import _num, col
from gridloom.functions.cells.numeric import _udf, f_cdf, gamma_p, norm_cdf, t_cdf
from gridloom.runtime import materialize

lit = F.lit


def _agg(names: str, f):
    define(names, "aggregate")(f)


_coerced = lambda x: F.coalesce(col(x).cast("string").try_cast("double"), F.when(col(x).cast("string") == "true", 1.0).when(col(x).isNotNull(), 0.0))
_n = lambda x: col(x).cast("string").try_cast("double")  # noqa: E731  numbers only; text that is none is skipped
for _names, _f in {
    "SUM": lambda x: F.coalesce(F.sum(_n(x)), lit(0.0)), "AVERAGE": lambda x: F.avg(_n(x)), "MIN": lambda x: F.coalesce(F.min(_n(x)), lit(0.0)), "MAX": lambda x: F.coalesce(F.max(_n(x)), lit(0.0)), "COUNT": lambda x: F.count(_n(x)), "COUNTA": lambda x: F.count(col(x)), "COUNTBLANK": lambda x: F.count_if(col(x).isNull() | (col(x).cast("string") == "")),
    "PRODUCT": lambda x: F.product(_n(x)), "SUMSQ": lambda x: F.coalesce(F.sum(_n(x) * _n(x)), lit(0.0)), "AVERAGEA": lambda x: F.avg(_coerced(x)), "MAXA": lambda x: F.max(_coerced(x)), "MINA": lambda x: F.min(_coerced(x)), "VARA": lambda x: F.var_samp(_coerced(x)), "VARPA": lambda x: F.var_pop(_coerced(x)), "STDEVA": lambda x: F.stddev_samp(_coerced(x)), "STDEVPA": lambda x: F.stddev_pop(_coerced(x)),
    "STDEV STDEV.S": lambda x: F.stddev_samp(_n(x)), "STDEVP STDEV.P": lambda x: F.stddev_pop(_n(x)), "VAR VAR.S": lambda x: F.var_samp(_n(x)), "VARP VAR.P": lambda x: F.var_pop(_n(x)), "DEVSQ": lambda x: F.var_pop(_n(x)) * F.count(_n(x)), "MEDIAN": lambda x: F.percentile(_n(x), lit(0.5)),
    "PERCENTILE PERCENTILE.INC": lambda x, p: F.percentile(_n(x), lit(p)), "QUARTILE QUARTILE.INC": lambda x, k: F.percentile(_n(x), lit(k / 4)), "GEOMEAN": lambda x: F.when(F.min(_n(x)) > 0, F.exp(F.avg(F.when(_n(x) > 0, F.ln(_n(x)))))), "HARMEAN": lambda x: F.when(F.min(_n(x)) > 0, F.count(_n(x)) / F.sum(F.when(_n(x) > 0, 1 / _n(x)))),
    "AVEDEV": lambda x: F.aggregate(F.collect_list(_n(x)), lit(0.0), lambda s, v: s + F.abs(v - F.avg(_n(x)))) / F.nullif(F.count(_n(x)), lit(0)),
    "SKEW.P": lambda x: F.skewness(_n(x)), "SKEW": lambda x: F.when(F.count(_n(x)) > 2, F.skewness(_n(x)) * F.sqrt(F.count(_n(x)) * (F.count(_n(x)) - 1.0)) / F.nullif(F.count(_n(x)) - 2.0, lit(0.0))),
    "KURT": lambda x: F.when(F.count(_n(x)) > 3, ((F.count(_n(x)) + 1) * F.kurtosis(_n(x)) + 6) * (F.count(_n(x)) - 1) / ((F.count(_n(x)) - 2.0) * F.nullif(F.count(_n(x)) - 3.0, lit(0.0)))),
    "CORREL PEARSON": lambda a, b: F.corr(_n(a), _n(b)), "COVAR COVARIANCE.P": lambda a, b: F.covar_pop(_n(a), _n(b)), "COVARIANCE.S": lambda a, b: F.covar_samp(_n(a), _n(b)), "SLOPE": lambda y, x: F.regr_slope(_n(y), _n(x)), "INTERCEPT": lambda y, x: F.regr_intercept(_n(y), _n(x)), "RSQ": lambda y, x: F.regr_r2(_n(y), _n(x)),
    "STEYX": lambda y, x: F.sqrt((F.regr_syy(_n(y), _n(x)) - F.pow(F.regr_sxy(_n(y), _n(x)), lit(2.0)) / F.nullif(F.regr_sxx(_n(y), _n(x)), lit(0.0))) / F.nullif(F.regr_count(_n(y), _n(x)) - 2.0, lit(0.0))), "FORECAST FORECAST.LINEAR": lambda v, y, x: F.regr_intercept(_n(y), _n(x)) + F.regr_slope(_n(y), _n(x)) * v,
    "SUMPRODUCT": lambda *xs: F.coalesce(F.sum(reduce(lambda a, b: a * b, [F.coalesce(_n(x), lit(0.0)) for x in xs])), lit(0.0)), "SUMX2MY2": lambda a, b: F.sum(_n(a) * _n(a) - _n(b) * _n(b)), "SUMX2PY2": lambda a, b: F.sum(_n(a) * _n(a) + _n(b) * _n(b)), "SUMXMY2": lambda a, b: F.sum((_n(a) - _n(b)) * (_n(a) - _n(b))),
    "LARGE": lambda x, k: F.try_element_at(F.sort_array(F.collect_list(_n(x)), False), lit(int(k))), "SMALL": lambda x, k: F.try_element_at(F.sort_array(F.collect_list(_n(x))), lit(int(k))), "ROWS": lambda x=1: F.count(lit(1)),
    "STRING.AGG": lambda x, d: F.listagg(col(x).cast("string"), lit(d)),
}.items():
    _agg(_names, _f)


def _exclusive(x, p: float) -> Column:
    a, n = F.sort_array(F.collect_list(_n(x))), F.count(_n(x))
    r = lit(p) * (n + 1)
    k = F.floor(r).cast("int")
    low, high = F.try_element_at(a, F.greatest(k, lit(1))), F.try_element_at(a, F.greatest(F.least(k + 1, n.cast("int")), lit(1)))
    return F.when((r >= 1) & (r <= n), low + (r - k) * (high - low))


_agg("PERCENTILE.EXC", _exclusive)
_agg("QUARTILE.EXC", lambda x, k: _exclusive(x, k / 4))


def _trimmed(x, share: float) -> Column:
    a = F.sort_array(F.collect_list(_n(x)))
    cut = F.floor(F.size(a) * lit(share) / 2).cast("int")
    kept = F.slice(a, cut + 1, F.greatest(F.size(a) - 2 * cut, lit(0)))
    return F.aggregate(kept, lit(0.0), lambda s, v: s + v) / F.nullif(F.size(kept), lit(0))


_agg("TRIMMEAN", _trimmed)


def mode(df: DataFrame, x: str, order: str | None = None, by: list[str] | None = None) -> DataFrame:
    """The most frequent number of each group; of equally frequent ones that which comes first by `order` (else the smallest)."""
    by = by or []
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(lit(1)).alias("__n"), F.min(order or x).alias("__o"))
    return counts.groupBy(*by).agg(F.max_by(F.struct(F.col(x).alias("v"), F.col("__n").alias("n")), F.struct(F.col("__n"), -F.col("__o"))).alias("__m")).where("__m.n > 1").select(*by, F.col("__m.v").alias("mode"))


define("MODE MODE.SNGL", "table")(mode)


@define("MODE.MULT", "table")
def mode_mult(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(lit(1)).alias("__n"))
    return counts.withColumn("__t", F.max("__n").over(Window.partitionBy(*by))).where("__n = __t AND __n > 1").select(*by, F.col(x).alias("mode"))


@define("FREQUENCY", "table")
def frequency(df: DataFrame, x: str, bins: list[float]) -> DataFrame:
    """Counts of values up to each bound, and above the last: (bin, n), the last bin null."""
    edges = sorted(bins)
    at = F.size(F.filter(F.array(*map(lit, map(float, edges))), lambda b: b < F.col(x).cast("double")))
    counts = df.where(F.col(x).isNotNull()).groupBy(at.alias("k")).agg(F.count(lit(1)).alias("n"))
    all_bins = df.sparkSession.createDataFrame([(k, float(b) if b is not None else None) for k, b in enumerate([*edges, None])], "k int, bin double")
    return all_bins.join(counts, "k", "left").select("bin", F.coalesce("n", lit(0)).alias("n"))


# --- hypothesis tests

_t_two = _udf(lambda t, n, tails: tails * (1 - t_cdf(abs(t), n)))
_f_two = _udf(lambda f, a, b: 2 * min(1 - f_cdf(f, a, b), f_cdf(f, a, b)))
_chi_tail = _udf(lambda x, n: 1 - gamma_p(n / 2, x / 2))
_z_tail = _udf(lambda z: 1 - norm_cdf(z))


@define("T.TEST TTEST", "table")
def t_test(df: DataFrame, a: str, b: str, tails: int = 2, kind: int = 1) -> DataFrame:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = df.agg(F.avg(x - y).alias("d"), F.stddev_samp(x - y).alias("sd"), F.count(x - y).alias("n"), F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.var_samp(x).alias("va"), F.var_samp(y).alias("vb"), F.count(x).cast("double").alias("na"), F.count(y).cast("double").alias("nb"))
    c = F.col
    if kind == 1:
        t, n = c("d") / (c("sd") / F.sqrt("n")), c("n") - 1.0
    elif kind == 2:
        n = c("na") + c("nb") - 2
        pooled = ((c("na") - 1) * c("va") + (c("nb") - 1) * c("vb")) / n
        t = (c("ma") - c("mb")) / F.sqrt(pooled * (1 / c("na") + 1 / c("nb")))
    else:
        ra, rb = c("va") / c("na"), c("vb") / c("nb")
        t = (c("ma") - c("mb")) / F.sqrt(ra + rb)
        n = (ra + rb) * (ra + rb) / (ra * ra / (c("na") - 1) + rb * rb / (c("nb") - 1))
    return s.select(_t_two(t, n, lit(float(tails))).alias("p"))


@define("F.TEST FTEST", "table")
def f_test(df: DataFrame, a: str, b: str) -> DataFrame:
    s = df.agg(F.var_samp(F.col(a).cast("double")).alias("va"), F.var_samp(F.col(b).cast("double")).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    return s.select(_f_two(F.col("va") / F.col("vb"), F.col("na") - 1.0, F.col("nb") - 1.0).alias("p"))


@define("CHISQ.TEST CHITEST", "table")
def chi_test(df: DataFrame, observed: str, expected: str, freedom: int | None = None) -> DataFrame:
    o, e = F.col(observed).cast("double"), F.col(expected).cast("double")
    s = df.agg(F.sum((o - e) * (o - e) / e).alias("x"), (F.count(o) - 1.0).alias("n"))
    return s.select(_chi_tail("x", lit(float(freedom)) if freedom else F.col("n")).alias("p"))


@define("Z.TEST ZTEST", "table")
def z_test(df: DataFrame, x: str, mean: float, sigma: float | None = None) -> DataFrame:
    v = F.col(x).cast("double")
    s = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.count(v).alias("n"))
    return s.select(_z_tail((F.col("m") - mean) / ((lit(sigma) if sigma else F.col("s")) / F.sqrt("n"))).alias("p"))


_agg("PROB", lambda x, p, lo, hi=None: F.when(F.abs(F.sum(_n(p)) - 1) < 1e-7, F.coalesce(F.sum(F.when(_n(x).between(lo, lo if hi is None else hi), _n(p))), lit(0.0))))

# --- criteria: ">5", "a*c", "", "=", "<>"

_CRITERION = re.compile(r"^(<=|>=|<>|=|<|>)?(.*)$", re.S)


def wildcard(pattern: str) -> str:
    """A pattern with ?, * and ~ as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            out += re.escape(pattern[i + 1])
            i += 1
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?is)^{out}$"


def criterion(x, c) -> Column:
    """Whether values match a spreadsheet criterion; never null. Text compares without case; errors never match."""
    x = col(x)
    text = x.cast("string")
    number = text.try_cast("double")
    if c is None or isinstance(c, bool) or isinstance(c, (int, float)):
        want = 0.0 if c is None else float(c)
        return F.coalesce(text == str(c).lower(), lit(False)) if isinstance(c, bool) else F.coalesce(number == want, lit(False))
    op, rest = _CRITERION.match(c).groups()
    try:
        value = float(rest) if rest.strip() else None
    except ValueError:
        value = None
    if value is not None:
        n = {None: number == value, "=": number == value, "<>": number.isNull() | (number != value), "<": number < value, "<=": number <= value, ">": number > value, ">=": number >= value}[op]
        return F.coalesce(n, lit(op == "<>"))
    if rest == "":
        blank = text.isNull() if op in ("=", "<>") else text.isNull() | (text == "")
        return {None: blank, "=": blank, "<>": ~blank}.get(op, lit(False))
    if op in (None, "=", "<>"):
        hit = F.coalesce(text.rlike(wildcard(rest)), lit(False))
        return ~hit if op == "<>" else hit
    low = F.lower(text)
    r = rest.lower()
    return F.coalesce({"<": low < r, "<=": low <= r, ">": low > r, ">=": low >= r}[op] & number.isNull(), lit(False))


def _all(pairs) -> Column:
    return reduce(lambda a, b: a & b, [criterion(x, c) for x, c in zip(pairs[::2], pairs[1::2])])


_agg("SUMIF", lambda x, c, v=None: F.coalesce(F.sum(F.when(criterion(x, c), _n(v if v is not None else x))), lit(0.0)))
_agg("SUMIFS", lambda v, *pairs: F.coalesce(F.sum(F.when(_all(pairs), _n(v))), lit(0.0)))
_agg("COUNTIF", lambda x, c: F.count_if(criterion(x, c)))
_agg("COUNTIFS", lambda *pairs: F.count_if(_all(pairs)))
_agg("AVERAGEIF", lambda x, c, v=None: F.avg(F.when(criterion(x, c), _n(v if v is not None else x))))
_agg("AVERAGEIFS", lambda v, *pairs: F.avg(F.when(_all(pairs), _n(v))))
_agg("MINIFS", lambda v, *pairs: F.coalesce(F.min(F.when(_all(pairs), _n(v))), lit(0.0)))
_agg("MAXIFS", lambda v, *pairs: F.coalesce(F.max(F.when(_all(pairs), _n(v))), lit(0.0)))

_SUBTOTAL = ["AVERAGE", "COUNT", "COUNTA", "MAX", "MIN", "PRODUCT", "STDEV", "STDEVP", "SUM", "VAR", "VARP"]
_AGGREGATE = [*_SUBTOTAL, "MEDIAN", "MODE.SNGL", "LARGE", "SMALL", "PERCENTILE.INC", "QUARTILE.INC", "PERCENTILE.EXC", "QUARTILE.EXC"]


@define("SUBTOTAL", "aggregate")
def subtotal(fn, x, hidden=None):
    """Functions 1-11; 101-111 leave out rows where `hidden` holds."""
    from gridloom.functions.cells import REGISTRY

    v = F.when(~F.coalesce(col(hidden), lit(False)), col(x)) if fn > 100 and hidden is not None else col(x)
    return REGISTRY[_SUBTOTAL[fn % 100 - 1]].call(v)


@define("AGGREGATE", "aggregate")
def aggregate_fn(fn, option, x, k=None, hidden=None):
    """Functions 1-19; options 2, 3, 6 and 7 ignore errors (others give null where one is there), 1, 3, 5 and 7 hidden rows."""
    from gridloom.functions.cells import REGISTRY
    from gridloom.functions.cells.math import _err

    v = F.when(~F.coalesce(col(hidden), lit(False)), col(x)) if option in (1, 3, 5, 7) and hidden is not None else col(x)
    if fn == 13:
        value = F.mode(_n(v))
    else:
        f = REGISTRY[_AGGREGATE[fn - 1]].call
        clean = F.when(~F.coalesce(_err(v), lit(False)), v)
        value = f(clean, k) if k is not None else f(clean)
    return value if option in (2, 3, 6, 7) else F.when(F.count_if(F.coalesce(_err(v), lit(False))) == 0, value)


# --- database functions: criteria are rows (dicts); rows join by or, their columns by and


def database_predicate(rows: list[dict]) -> Column:
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [criterion(F.col(f"`{k}`"), v) if not isinstance(v, Column) else v for k, v in r.items() if v is not None] or [lit(True)]) for r in rows])


for _name, _base in {"DSUM": "SUM", "DAVERAGE": "AVERAGE", "DCOUNT": "COUNT", "DCOUNTA": "COUNTA", "DMAX": "MAX", "DMIN": "MIN", "DPRODUCT": "PRODUCT", "DSTDEV": "STDEV", "DSTDEVP": "STDEVP", "DVAR": "VAR", "DVARP": "VARP"}.items():

    def _database(df: DataFrame, field: str, rows: list[dict], base=_base) -> DataFrame:
        from gridloom.functions.cells import REGISTRY

        return df.where(database_predicate(rows)).agg(REGISTRY[base].call(F.col(f"`{field}`")).alias("value"))

    define(_name, "table")(_database)


@define("DGET", "table")
def dget(df: DataFrame, field: str, rows: list[dict]) -> DataFrame:
    """The single match; null where none or several match, with the error in err."""
    v = F.col(f"`{field}`")
    return df.where(database_predicate(rows)).agg(F.count(lit(1)).alias("n"), F.max(v).alias("v")).select(F.when(F.col("n") == 1, F.col("v")).alias("value"), F.when(F.col("n") == 0, "#VALUE!").when(F.col("n") > 1, "#NUM!").alias("err"))


# --- windows


def _window(by, order: Column) -> Window:
    if not by:
        raise ValueError("over a whole table, give the DataFrame and the column's name: call(name, df, column, result)")
    return Window.partitionBy(*by).orderBy(order)


def _rank(x, order: int = 0, by=()) -> Column:
    return F.rank().over(_window(by, col(x).asc() if order else col(x).desc()))


_cut3 = lambda v, digits: F.floor(F.round(v * 10**digits, 6)) / 10**digits


def rank_table(df: DataFrame, column: str, order: int = 0) -> DataFrame:
    """df with __below (rows before its value), __same (rows of its value) and __all (rows with a value), without one task for all.

    Values are counted first, so ties cost one row; the counts are ranged
    over partitions, and each partition gets the total of those before it.
    Null values have no rank.
    """
    key = F.col(f"`{column}`")
    counts = df.where(key.isNotNull()).groupBy(key.alias("__v")).agg(F.count(lit(1)).alias("__same"))
    counts = counts.repartitionByRange("__v" if order else F.desc("__v")).sortWithinPartitions("__v" if order else F.desc("__v"))
    counts = materialize(counts.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__k")), "ranks")
    parts = counts.groupBy("__p").agg(F.sum("__same").alias("__n"))  # one row for each partition
    line = Window.orderBy("__p")
    parts = parts.select(F.col("__p").alias("__q"), (F.sum("__n").over(line) - F.col("__n")).alias("__base"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    own = Window.partitionBy("__p").orderBy("__k")
    ranked = counts.withColumn("__in", F.sum("__same").over(own) - F.col("__same")).join(F.broadcast(parts), F.col("__p") == F.col("__q"))
    ranked = ranked.select("__v", "__same", (F.col("__base") + F.col("__in")).alias("__below"), "__all")
    return df.join(ranked, key == F.col("__v"), "left").drop("__v")


def _ranking(names: str, grouped, value, option: int, ascending: int | None = None):
    """Functions that take a Column and groups, or a DataFrame, a column's name and the result's name."""

    def run(x, *args):
        if not isinstance(x, DataFrame):
            return grouped(x, *args)
        column, result, given = (*args, option)[:3]
        ranked = rank_table(x, column, given if ascending is None else ascending)
        return ranked.withColumn(result, value(given)).drop("__below", "__same", "__all")

    define(names, "window")(run)


_ranking("RANK RANK.EQ", _rank, lambda _: F.col("__below") + 1, 0)
_ranking("RANK.AVG", lambda x, order=0, by=(): _rank(x, order, by) + (F.count(lit(1)).over(Window.partitionBy(*by, col(x))) - 1) / 2, lambda _: F.col("__below") + 1 + (F.col("__same") - 1) / 2, 0)
_ranking("PERCENTRANK PERCENTRANK.INC", lambda x, digits=3, by=(): _cut3(F.percent_rank().over(_window(by, col(x).asc())), digits), lambda digits: _cut3(F.when(F.col("__all") == 1, 0.0).otherwise(F.col("__below") / (F.col("__all") - 1)), digits), 3, 1)
_ranking("PERCENTRANK.EXC", lambda x, digits=3, by=(): _cut3(_rank(x, 1, by) / (F.count(lit(1)).over(Window.partitionBy(*by)) + 1.0), digits), lambda digits: _cut3((F.col("__below") + 1) / (F.col("__all") + 1.0), digits), 3, 1)
