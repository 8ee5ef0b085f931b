"""Math, logical and information functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.cells import define

lit = F.lit
_num = lambda x: (x if isinstance(x, Column) else lit(x)).cast("double")


def col(x) -> Column:
    return x if isinstance(x, Column) else lit(x)


def _simple(name: str, f):
    define(name)(lambda x, f=f: f(_num(x)))


def _guard(ok: Column, x: Column) -> Column:
    return F.when(ok, x)


for _n, _f in {
    "ABS": F.abs, "ATAN": F.atan, "COS": F.cos, "COSH": F.cosh, "SIN": F.sin, "SINH": F.sinh, "TAN": F.tan, "TANH": F.tanh, "ASINH": F.asinh, "EXP": F.exp, "DEGREES": F.degrees, "RADIANS": F.radians,
    "ACOS": lambda x: _guard(F.abs(x) <= 1, F.acos(x)), "ASIN": lambda x: _guard(F.abs(x) <= 1, F.asin(x)), "ACOSH": lambda x: _guard(x >= 1, F.acosh(x)), "ATANH": lambda x: _guard(F.abs(x) < 1, F.atanh(x)),
    "ACOT": lambda x: F.pi() / 2 - F.atan(x), "ACOTH": lambda x: _guard(F.abs(x) > 1, 0.5 * F.ln((x + 1) / F.nullif(x - 1, lit(0.0)))),
    "COT": lambda x: F.try_divide(lit(1.0), F.tan(x)), "COTH": lambda x: F.try_divide(F.cosh(x), F.sinh(x)), "CSC": lambda x: F.try_divide(lit(1.0), F.sin(x)), "CSCH": lambda x: F.try_divide(lit(1.0), F.sinh(x)), "SEC": lambda x: 1 / F.cos(x), "SECH": lambda x: 1 / F.cosh(x),
    "LN": lambda x: _guard(x > 0, F.ln(x)), "LOG10": lambda x: _guard(x > 0, F.log10(x)), "SQRT": lambda x: _guard(x >= 0, F.sqrt(x)), "SQRTPI": lambda x: _guard(x >= 0, F.sqrt(x * F.pi())), "SIGN": F.signum, "INT": lambda x: F.floor(x).cast("double"),
    "EVEN": lambda x: F.signum(x) * F.ceil(F.abs(x) / 2) * 2, "ODD": lambda x: F.when(x == 0, 1.0).otherwise(F.signum(x) * (F.ceil((F.abs(x) + 1) / 2) * 2 - 1)),
    "ISEVEN": lambda x: F.abs(_trunc(x)) % 2 == 0, "ISODD": lambda x: F.abs(_trunc(x)) % 2 == 1, "FISHER": lambda x: _guard(F.abs(x) < 1, F.atanh(x)), "FISHERINV": F.tanh,
    "PHI": lambda x: F.exp(-x * x / 2) / F.sqrt(2 * F.pi()), "ROUNDBAHTDOWN": lambda x: _toward(x * 4) / 4, "ROUNDBAHTUP": lambda x: _away(x * 4) / 4,
}.items():
    _simple(_n, _f)


def _toward(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def _away(x: Column) -> Column:
    return F.signum(x) * F.ceil(F.abs(x))


def _trunc(x: Column) -> Column:
    return _toward(x)


def _scaled(x, d, f) -> Column:
    p = F.pow(lit(10.0), _num(d))
    return f(F.round(_num(x) * p, 9)) / p


define("PI")(lambda: F.pi())
define("ATAN2")(lambda x, y: F.when((_num(x) != 0) | (_num(y) != 0), F.atan2(_num(y), _num(x))))
define("POWER")(lambda x, y: F.when(~((_num(x) == 0) & (_num(y) <= 0)), F.pow(_num(x), _num(y))))
define("LOG")(lambda x, b=10: F.when((_num(x) > 0) & (_num(b) > 0) & (_num(b) != 1), F.ln(_num(x)) / F.ln(_num(b))))
define("MOD")(lambda x, n: F.when(_num(n) != 0, _num(x) - _num(n) * F.floor(_num(x) / F.nullif(_num(n), lit(0.0)))))
define("QUOTIENT")(lambda x, y: F.when(_num(y) != 0, _toward(_num(x) / F.nullif(_num(y), lit(0.0)))))
define("ROUND")(lambda x, d=0: _scaled(x, d, lambda v: F.signum(v) * F.floor(F.abs(v) + 0.5)))
define("ROUNDDOWN")(lambda x, d=0: _scaled(x, d, _toward))
define("TRUNC")(lambda x, d=0: _scaled(x, d, _toward))
define("ROUNDUP")(lambda x, d=0: _scaled(x, d, _away))
define("MROUND")(lambda x, m: F.when(_num(m) == 0, 0.0).when(_num(x) * _num(m) >= 0, F.signum(_num(x)) * F.floor(F.abs(_num(x) / F.nullif(_num(m), lit(0.0))) + 0.5) * F.abs(_num(m))))


def _step(x, s, f) -> Column:
    """Multiples of the step's size, up or down; signs that differ are an error."""
    x, s = _num(x), _num(s)
    size = F.nullif(F.abs(s), lit(0.0))
    return F.when(s == 0, 0.0).when(x * s >= 0, f(x / size) * size)


define("CEILING")(lambda x, s=1: _step(x, s, F.ceil))
define("FLOOR")(lambda x, s=1: _step(x, s, F.floor))
define("CEILING.PRECISE ISO.CEILING")(lambda x, s=1: F.when(_num(s) == 0, 0.0).otherwise(F.ceil(_num(x) / F.nullif(F.abs(_num(s)), lit(0.0))) * F.abs(_num(s))))
define("FLOOR.PRECISE")(lambda x, s=1: F.when(_num(s) == 0, 0.0).otherwise(F.floor(_num(x) / F.nullif(F.abs(_num(s)), lit(0.0))) * F.abs(_num(s))))


def _math_step(x, s, mode, up: bool) -> Column:
    x, s, m = _num(x), F.nullif(F.abs(_num(s)), lit(0.0)), _num(mode)
    normal, flipped = (F.ceil(x / s) * s, F.floor(x / s) * s) if up else (F.floor(x / s) * s, F.ceil(x / s) * s)
    return F.coalesce(F.when((x < 0) & (m != 0), flipped).otherwise(normal), F.when(x.isNotNull(), 0.0))


define("CEILING.MATH")(lambda x, s=1, mode=0: _math_step(x, s, mode, True))
define("FLOOR.MATH")(lambda x, s=1, mode=0: _math_step(x, s, mode, False))


def _product_of(n: Column, step: int) -> Column:
    n = F.floor(_num(n)).cast("int")
    return F.when((n >= -1) & (n <= 300), F.aggregate(F.when(n >= 1, F.sequence(n, F.when(n % 2 == 0, step).otherwise(1) if step == 2 else lit(1), lit(-step))).otherwise(F.array(lit(1))), lit(1.0), lambda a, b: a * b))


define("FACT")(lambda n: F.when(_num(n) >= 0, _product_of(n, 1)))
define("FACTDOUBLE")(lambda n: _product_of(n, 2))


def _choose(n, k) -> Column:
    n, k = F.floor(_num(n)), F.floor(_num(k))
    j = F.least(k, n - k).cast("int")
    seq = F.when(j >= 1, F.sequence(lit(1), j)).otherwise(F.array().cast("array<int>"))
    return F.when((n >= 0) & (k >= 0) & (k <= n), F.round(F.aggregate(seq, lit(1.0), lambda a, i: a * (n - j + i) / i), 0))


define("COMBIN")(_choose)
define("COMBINA")(lambda n, k: F.when((_num(n) == 0) & (_num(k) == 0), 1.0).otherwise(_choose(_num(n) + _num(k) - 1, k)))
define("PERMUT")(lambda n, k: F.when((F.floor(_num(k)) <= F.floor(_num(n))) & (_num(k) >= 0), F.aggregate(F.when(_num(k) >= 1, F.sequence(lit(0), F.floor(_num(k)).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lit(1.0), lambda a, i: a * (F.floor(_num(n)) - i))))
define("PERMUTATIONA")(lambda n, k: F.pow(F.floor(_num(n)), F.floor(_num(k))))
define("MULTINOMIAL")(lambda *xs: _product_of(reduce(lambda a, b: a + b, [F.floor(_num(x)) for x in xs]), 1) / reduce(lambda a, b: a * b, [_product_of(x, 1) for x in xs]))


def _gcd2(a: Column, b: Column) -> Column:
    """Euclid's rule by a fold that has enough turns for 53-bit numbers."""
    start = F.struct(F.abs(F.floor(a)).cast("double").alias("a"), F.abs(F.floor(b)).cast("double").alias("b"))
    end = F.aggregate(F.sequence(lit(1), lit(80)), start, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, lit(0.0)).otherwise(s["a"].cast("double") % F.nullif(s["b"].cast("double"), lit(0.0))).alias("b")))
    return end["a"].cast("double")


def _pair(a: Column, b: Column) -> Column:
    return _gcd2(a.cast("double"), b.cast("double"))


define("GCD")(lambda *xs: reduce(_pair, [_num(x) for x in xs]))
define("LCM")(lambda *xs: reduce(lambda a, b: F.when((a == 0) | (b == 0), 0.0).otherwise(F.abs(a * b) / _pair(a, b)), [F.floor(_num(x)) for x in xs]))
define("RAND")(lambda seed=42: F.rand(int(seed)))
define("RANDBETWEEN")(lambda lo, hi, seed=42: F.floor(F.rand(int(seed)) * (F.floor(_num(hi)) - F.ceil(_num(lo)) + 1)) + F.ceil(_num(lo)))
define("SERIESSUM", "array")(lambda x, n, m, a: F.aggregate(F.transform(a, lambda v, i: v * F.pow(_num(x), _num(n) + i * _num(m))), lit(0.0), lambda s, v: s + v))
define("SEQUENCE", "array")(lambda rows, columns=1, start=1, step=1: F.transform(F.sequence(lit(0), (_num(rows) - 1).cast("int")), lambda r: F.transform(F.sequence(lit(0), (_num(columns) - 1).cast("int")), lambda k: _num(start) + _num(step) * (r * _num(columns) + k))))
define("RANDARRAY", "array")(lambda rows=1, columns=1, lo=0, hi=1, seed=42: F.array(*[F.array(*[F.rand(int(seed) + r * int(columns) + k) * (hi - lo) + lo for k in range(int(columns))]) for r in range(int(rows))]))
define("MUNIT", "array")(lambda n: F.transform(F.sequence(lit(1), _num(n).cast("int")), lambda r: F.transform(F.sequence(lit(1), _num(n).cast("int")), lambda k: (r == k).cast("double"))))
define("DELTA")(lambda a, b=0: (_num(a) == _num(b)).cast("double"))
define("GESTEP")(lambda a, s=0: (_num(a) >= _num(s)).cast("double"))
define("STANDARDIZE")(lambda x, m, s: F.when(_num(s) > 0, (_num(x) - _num(m)) / F.nullif(_num(s), lit(0.0))))
define("EXPON.DIST EXPONDIST")(lambda x, r, cum=True: F.when((_num(x) >= 0) & (_num(r) > 0), F.when(col(cum), 1 - F.exp(-_num(r) * _num(x))).otherwise(_num(r) * F.exp(-_num(r) * _num(x)))))
define("WEIBULL.DIST WEIBULL")(lambda x, a, b, cum=True: F.when((_num(x) >= 0) & (_num(a) > 0) & (_num(b) > 0), F.when(col(cum), 1 - F.exp(-F.pow(_num(x) / _num(b), _num(a)))).otherwise(_num(a) / F.pow(_num(b), _num(a)) * F.pow(_num(x), _num(a) - 1) * F.exp(-F.pow(_num(x) / _num(b), _num(a))))))

# --- logical

define("TRUE")(lambda: lit(True))
define("FALSE")(lambda: lit(False))
define("NOT")(lambda x: ~col(x).cast("boolean"))
define("AND")(lambda *xs: reduce(lambda a, b: a & b, [F.coalesce(col(x).cast("boolean"), lit(True)) for x in xs]))
define("OR")(lambda *xs: reduce(lambda a, b: a | b, [F.coalesce(col(x).cast("boolean"), lit(False)) for x in xs]))
define("XOR")(lambda *xs: reduce(lambda a, b: a + b, [F.coalesce(col(x).cast("boolean"), lit(False)).cast("int") for x in xs]) % 2 == 1)
define("IF")(lambda c, a, b=False: F.when(F.coalesce(col(c).cast("boolean"), lit(False)), col(a)).otherwise(col(b)))
define("IFERROR")(lambda x, alt: F.coalesce(col(x), col(alt)))
define("IFNA")(lambda x, alt: F.when(col(x).cast("string").eqNullSafe(lit("#N/A")) | col(x).isNull(), col(alt)).otherwise(col(x)))


@define("IFS")
def _ifs(*xs):
    out = None
    for c, v in zip(xs[::2], xs[1::2]):
        out = F.when(col(c), col(v)) if out is None else out.when(col(c), col(v))
    return out


@define("SWITCH")
def _switch(x, *rest):
    out = None
    for v, r in zip(rest[::2], rest[1::2]):
        test = col(x).eqNullSafe(col(v))
        out = F.when(test, col(r)) if out is None else out.when(test, col(r))
    return out.otherwise(col(rest[-1])) if len(rest) % 2 else out


@define("CHOOSE")
def _choose_value(i, *xs):
    out = None
    for k, x in enumerate(xs, 1):
        test = F.floor(_num(i)) == k
        out = F.when(test, col(x)) if out is None else out.when(test, col(x))
    return out


# --- information (error codes are text such as "#N/A"). Fixed values.
ERRORS = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7, "#GETTING_DATA": 8, "#SPILL!": 9, "#CONNECT!": 10, "#BLOCKED!": 11, "#UNKNOWN!": 12, "#FIELD!": 13, "#CALC!": 14}
_err = lambda x: col(x).cast("string").isin(*ERRORS)
_bool = lambda x: F.typeof(col(x)) == "boolean"
_isnum = lambda x: F.typeof(col(x)).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*|date|timestamp.*)$") & col(x).isNotNull()
_istext = lambda x: (F.typeof(col(x)) == "string") & col(x).isNotNull() & ~_err(x)
define("ISBLANK")(lambda x: col(x).isNull())
define("ISERROR")(lambda x: F.coalesce(_err(x), lit(False)))
define("ISNA")(lambda x: col(x).cast("string").eqNullSafe(lit("#N/A")))
define("ISERR")(lambda x: F.coalesce(_err(x) & (col(x).cast("string") != "#N/A"), lit(False)))
define("ISLOGICAL")(lambda x: _bool(x) & col(x).isNotNull())
define("ISNUMBER")(lambda x: _isnum(x))
define("ISTEXT")(lambda x: F.coalesce(_istext(x), lit(False)))
define("ISNONTEXT")(lambda x: ~F.coalesce(_istext(x), lit(False)))
define("N")(lambda x: F.when(_isnum(x) | _bool(x), F.coalesce(col(x).cast("string").try_cast("double"), F.when(col(x).cast("string") == "true", 1.0).otherwise(0.0))).otherwise(0.0))
define("T")(lambda x: F.when(_istext(x), col(x).cast("string")).otherwise(""))
define("NA")(lambda: lit("#N/A"))
define("TYPE")(lambda x: F.when(_err(x), 16).when(_bool(x), 4).when(F.typeof(col(x)).startswith("array"), 64).when(_istext(x), 2).otherwise(1))
define("ERROR.TYPE")(lambda x: F.create_map(*[lit(v) for kv in ERRORS.items() for v in kv])[col(x)])
define("ISOMITTED")(lambda x=None: lit(x is None))
define("ISREF ISFORMULA")(lambda x: lit(False))
define("SHEET SHEETS")(lambda x=None: lit(1))
define("INFO")(lambda kind: F.when(F.lower(col(kind)) == "recalc", "Automatic").when(F.lower(col(kind)) == "numfile", "1"))
define("CELL")(lambda kind, x=None: F.when(F.lower(col(kind)) == "type", F.when(col(x).isNull(), "b").when(_istext(x), "l").otherwise("v")).when(F.lower(col(kind)) == "contents", col(x).cast("string")))
define("FORMULATEXT")(lambda x: lit("#N/A"))
define("IMAGE")(lambda source, alt="", *more: F.struct(col(source).alias("source"), col(alt).alias("alt")))
