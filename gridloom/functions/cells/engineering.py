"""Engineering functions: number bases, bits, complex numbers, units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.cells import define
from gridloom.functions.cells.math import _num, col

lit = F.lit
_WIDTH = {2: 10, 8: 30, 16: 40}
_NAMES = {2: "BIN", 8: "OCT", 16: "HEX"}


def _to_number(x, base: int) -> Column:
    t = F.upper(F.trim(col(x).cast("string")))
    v = F.conv(t, base, 10).cast("long")
    ok = t.rlike(f"^[{'0123456789ABCDEF'[:base]}]{{1,10}}$")
    return F.when(t == "", lit(0).cast("long")).when(ok, F.when(v >= 1 << (_WIDTH[base] - 1), v - (1 << _WIDTH[base])).otherwise(v))


def _from_number(n: Column, base: int, places=None) -> Column:
    n = n.cast("long")
    half = 1 << (_WIDTH[base] - 1)
    neg = F.upper(F.conv((n + (1 << _WIDTH[base])).cast("string"), 10, base))
    pos = F.upper(F.conv(n.cast("string"), 10, base))
    if places is not None:
        p = _num(places).cast("int")
        pos = F.when(F.char_length(pos) <= p, F.lpad(pos, p, lit("0")))
    return F.when((n >= -half) & (n < half), F.when(n < 0, neg).otherwise(pos))


for _b in (2, 8, 16):
    define(f"{_NAMES[_b]}2DEC")(lambda x, b=_b: _to_number(x, b).cast("double"))
    define(f"DEC2{_NAMES[_b]}")(lambda x, places=None, b=_b: _from_number(F.floor(_num(x)), b, places))
    for _c in (2, 8, 16):
        if _b != _c:
            define(f"{_NAMES[_b]}2{_NAMES[_c]}")(lambda x, places=None, b=_b, c=_c: _from_number(_to_number(x, b), c, places))
define("BASE")(lambda x, r, least=0: F.when(F.char_length(F.conv(F.floor(_num(x)).cast("long").cast("string"), 10, int(r))) < least, F.lpad(F.conv(F.floor(_num(x)).cast("long").cast("string"), 10, int(r)), int(max(1, least)), "0")).otherwise(F.conv(F.floor(_num(x)).cast("long").cast("string"), 10, int(r))))
define("DECIMAL")(lambda x, r: F.conv(col(x).cast("string"), int(r), 10).cast("double"))
_bits = lambda x: F.when((_num(x) >= 0) & (_num(x) < 1 << 48) & (_num(x) == F.floor(_num(x))), _num(x).cast("long"))
define("BITAND")(lambda a, b: _bits(a).bitwiseAND(_bits(b)))
define("BITOR")(lambda a, b: _bits(a).bitwiseOR(_bits(b)))
define("BITXOR")(lambda a, b: _bits(a).bitwiseXOR(_bits(b)))
_shift = lambda a, n: F.when(n >= 0, F.floor(_bits(a) * F.pow(lit(2.0), n))).otherwise(F.floor(_bits(a) / F.pow(lit(2.0), -n)))
define("BITLSHIFT")(lambda a, n: F.when(_shift(a, _num(n)) < 1 << 48, _shift(a, _num(n))))
define("BITRSHIFT")(lambda a, n: F.when(_shift(a, -_num(n)) < 1 << 48, _shift(a, -_num(n))))

# --- complex numbers as text such as "3+4i"


def _fmt(v: Column) -> Column:
    r = F.round(v, 15)
    return F.when(r == F.floor(r), F.format_string("%.0f", r)).otherwise(F.regexp_replace(r.cast("string"), r"\.0$", ""))


def complex_text(re: Column, im: Column, unit: str = "i") -> Column:
    one = F.when(F.round(im, 15) == 1, "").when(F.round(im, 15) == -1, "-").otherwise(_fmt(im))
    real, imag = F.round(re, 15) == 0, F.round(im, 15) == 0
    return F.when(re.isNull() | im.isNull(), None).when(imag, _fmt(re)).when(real, F.concat(one, lit(unit))).otherwise(F.concat(_fmt(re), F.when(im > 0, "+").otherwise(""), one, lit(unit)))


_PATTERN = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\d.eEij]))?\s*(?:([+-]?(?:\d+\.?\d*|\.\d+)?(?:[eE][+-]?\d+)?)([ij]))?\s*$"


def parts(x) -> tuple[Column, Column]:
    t = col(x).cast("string")
    ok = t.rlike(_PATTERN) & (F.trim(t) != "")
    re, im, unit = (F.regexp_extract(t, _PATTERN, k) for k in (1, 2, 3))
    i = F.when(unit == "", 0.0).when(im.isin("", "+"), 1.0).when(im == "-", -1.0).otherwise(im.try_cast("double"))
    return F.when(ok, F.when(re == "", 0.0).otherwise(re.try_cast("double"))), F.when(ok, i)


define("COMPLEX")(lambda re, im, unit="i": complex_text(_num(re), _num(im), unit))
define("IMREAL")(lambda x: parts(x)[0])
define("IMAGINARY")(lambda x: parts(x)[1])
define("IMABS")(lambda x: F.hypot(*parts(x)))
define("IMARGUMENT")(lambda x: (lambda p: F.when((p[0] != 0) | (p[1] != 0), F.atan2(p[1], p[0])))(parts(x)))
define("IMCONJUGATE")(lambda x: complex_text(parts(x)[0], -parts(x)[1]))


def _mul(p, q):
    return p[0] * q[0] - p[1] * q[1], p[0] * q[1] + p[1] * q[0]


def _div(p, q):
    d = F.nullif(q[0] * q[0] + q[1] * q[1], lit(0.0))
    return (p[0] * q[0] + p[1] * q[1]) / d, (p[1] * q[0] - p[0] * q[1]) / d


def _log(p):
    r = F.hypot(*p)
    return F.when(r > 0, F.ln(r)), F.atan2(p[1], p[0])


def _polar(r, t):
    return r * F.cos(t), r * F.sin(t)


define("IMDIV")(lambda a, b: complex_text(*_div(parts(a), parts(b))))
define("IMSUB")(lambda a, b: complex_text(parts(a)[0] - parts(b)[0], parts(a)[1] - parts(b)[1]))
define("IMSUM")(lambda *xs: complex_text(reduce(lambda a, b: a + b, [parts(x)[0] for x in xs]), reduce(lambda a, b: a + b, [parts(x)[1] for x in xs])))
define("IMPRODUCT")(lambda *xs: complex_text(*reduce(_mul, map(parts, xs))))
define("IMEXP")(lambda x: complex_text(*_polar(F.exp(parts(x)[0]), parts(x)[1])))
define("IMLN")(lambda x: complex_text(*_log(parts(x))))
define("IMLOG10")(lambda x: complex_text(*[v / F.ln(lit(10.0)) for v in _log(parts(x))]))
define("IMLOG2")(lambda x: complex_text(*[v / F.ln(lit(2.0)) for v in _log(parts(x))]))
define("IMPOWER")(lambda x, n: complex_text(*_polar(F.pow(F.hypot(*parts(x)), _num(n)), F.atan2(parts(x)[1], parts(x)[0]) * _num(n))))
define("IMSQRT")(lambda x: complex_text(*_polar(F.sqrt(F.hypot(*parts(x))), F.atan2(parts(x)[1], parts(x)[0]) / 2)))


def _sin(p):
    return F.sin(p[0]) * F.cosh(p[1]), F.cos(p[0]) * F.sinh(p[1])


def _cos(p):
    return F.cos(p[0]) * F.cosh(p[1]), -F.sin(p[0]) * F.sinh(p[1])


define("IMSIN")(lambda x: complex_text(*_sin(parts(x))))
define("IMCOS")(lambda x: complex_text(*_cos(parts(x))))
define("IMTAN")(lambda x: complex_text(*_div(_sin(parts(x)), _cos(parts(x)))))

#: Size of each unit in the base unit of its kind.
UNITS = {
    "mass": {"g": 1.0, "sg": 14593.9029372064, "lbm": 453.59237, "u": 1.66053100460465e-24, "ozm": 28.349523125, "grain": 0.06479891, "cwt": 45359.237, "uk_cwt": 50802.34544, "stone": 6350.29318, "ton": 907184.74, "uk_ton": 1016046.9088},
    "distance": {"m": 1.0, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ell": 1.143, "ly": 9.46073047258080e15, "parsec": 3.08567758128155e16, "pc": 3.08567758128155e16, "Pica": 0.0254 / 72, "pica": 0.0254 / 6, "survey_mi": 1609.347218694437},
    "time": {"sec": 1.0, "s": 1.0, "mn": 60.0, "min": 60.0, "hr": 3600.0, "day": 86400.0, "d": 86400.0, "yr": 31557600.0},
    "pressure": {"Pa": 1.0, "p": 1.0, "atm": 101325.0, "at": 101325.0, "mmHg": 133.322, "psi": 6894.757293168361, "Torr": 101325 / 760},
    "force": {"N": 1.0, "dyn": 1e-5, "dy": 1e-5, "lbf": 4.4482216152605, "pond": 0.00980665},
    "energy": {"J": 1.0, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.602176487e-19, "ev": 1.602176487e-19, "HPh": 2684519.537696173, "Wh": 3600.0, "flb": 1.3558179483314, "BTU": 1055.05585262, "btu": 1055.05585262},
    "power": {"W": 1.0, "w": 1.0, "HP": 745.6998715822702, "h": 745.6998715822702, "PS": 735.49875},
    "magnetism": {"T": 1.0, "ga": 1e-4},
    "volume": {"l": 1.0, "L": 1.0, "lt": 1.0, "tsp": 0.00492892159375, "tspm": 0.005, "tbs": 0.01478676478125, "oz": 0.0295735295625, "cup": 0.2365882365, "pt": 0.473176473, "us_pt": 0.473176473, "uk_pt": 0.56826125, "qt": 0.946352946, "gal": 3.785411784, "uk_gal": 4.54609, "m3": 1000.0, "ft3": 28.316846592, "in3": 0.016387064, "barrel": 158.987294928, "bushel": 35.23907016688},
    "area": {"m2": 1.0, "ha": 10000.0, "uk_acre": 4046.8564224, "us_acre": 4046.87260987425, "ft2": 0.09290304, "in2": 0.00064516, "mi2": 2589988.110336, "yd2": 0.83612736, "ar": 100.0},
    "information": {"bit": 1.0, "byte": 8.0},
    "speed": {"m/s": 1.0, "m/sec": 1.0, "m/h": 1 / 3600, "mph": 0.44704, "kn": 1852 / 3600, "admkn": 0.514773333333333},
}
#: Prefixes of metric units and of bits and bytes.
PREFIXES = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "e": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24}
BINARY = {"Yi": 2.0**80, "Zi": 2.0**70, "Ei": 2.0**60, "Pi": 2.0**50, "Ti": 2.0**40, "Gi": 2.0**30, "Mi": 2.0**20, "ki": 2.0**10}
_METRIC = {"g", "u", "m", "ang", "ly", "parsec", "pc", "sec", "s", "Pa", "p", "atm", "at", "mmHg", "Torr", "N", "dyn", "dy", "pond", "J", "e", "c", "cal", "eV", "ev", "Wh", "W", "w", "T", "ga", "l", "L", "lt", "m3", "m2", "ar", "bit", "byte", "m/s", "m/sec", "m/h"}


def unit(name: str) -> tuple[str, float]:
    for kind, units in UNITS.items():
        if name in units:
            return kind, units[name]
    for prefix, size in sorted([*PREFIXES.items(), *BINARY.items()], key=lambda p: -len(p[0])):
        base = name[len(prefix) :]
        if name.startswith(prefix) and base in _METRIC and (prefix not in BINARY or base in ("bit", "byte")):
            for kind, units in UNITS.items():
                if base in units:
                    power = {"m2": 2, "m3": 3}.get(base, 1)
                    return kind, units[base] * size**power
    raise ValueError(f"unknown unit {name!r}")


_TEMPERATURES = {"C": (1.0, 273.15), "cel": (1.0, 273.15), "F": (5 / 9, 459.67 * 5 / 9), "fah": (5 / 9, 459.67 * 5 / 9), "K": (1.0, 0.0), "kel": (1.0, 0.0), "Rank": (5 / 9, 0.0), "Reau": (1.25, 273.15)}


@define("CONVERT")
def convert(x, source: str, target: str):
    """Units are constants; null where their kinds differ."""
    if source in _TEMPERATURES and target in _TEMPERATURES:
        (a, b), (c, d) = _TEMPERATURES[source], _TEMPERATURES[target]
        return (_num(x) * a + b - d) / c
    try:
        (k, a), (m, b) = unit(source), unit(target)
    except ValueError:
        return lit(None).cast("double")
    return _num(x) * (a / b) if k == m else lit(None).cast("double")
