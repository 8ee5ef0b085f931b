"""Date and time functions over date and timestamp Columns; serial() and from_serial() cross to day numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.cells import define
from gridloom.functions.cells.math import _num, col

lit = F.lit
_int = lambda x: F.floor(_num(x)).cast("int")


def day(x) -> Column:
    c = col(x)
    return c.try_cast("date") if isinstance(x, str) else c.cast("date")


def serial(x, base1904: bool = False) -> Column:
    """A date as a day number; in the 1900 system the day after 28 February 1900 counts twice."""
    d = day(x)
    if base1904:
        return F.datediff(d, lit("1904-01-01").cast("date"))
    n = F.datediff(d, lit("1899-12-30").cast("date"))
    return F.when(n < 61, n - 1).otherwise(n)


def from_serial(n, base1904: bool = False) -> Column:
    n = _int(n)
    if base1904:
        return F.date_add(lit("1904-01-01").cast("date"), n)
    return F.when(n == 60, None).otherwise(F.date_add(lit("1899-12-30").cast("date"), F.when(n < 60, n + 1).otherwise(n)))


def _date(y, m, d) -> Column:
    y, m, d = _int(y), _int(m), _int(d)
    year = F.when((y >= 0) & (y < 1900), y + 1900).otherwise(y)
    return F.date_add(F.add_months(F.make_date(year, lit(1), lit(1)), m - 1), d - 1)


define("DATE")(_date)
define("DATEVALUE")(lambda x: serial(F.coalesce(col(x).try_cast("date"), F.try_to_date(col(x), "M/d/yyyy"))))
define("TIME")(lambda h, m, s: F.pmod((_num(h) * 3600 + _num(m) * 60 + _num(s)) / 86400, lit(1.0)))
define("TIMEVALUE")(lambda x: (lambda t: (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400)(F.concat(lit("2000-01-01 "), col(x)).try_cast("timestamp")))
for _n, _f in {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth}.items():
    define(_n)(lambda x, f=_f: f(day(x)))
for _n, _f in {"HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}.items():
    define(_n)(lambda x, f=_f: f(col(x).cast("timestamp")))
define("DAYS")(lambda end, start: F.datediff(day(end), day(start)))
define("EDATE")(lambda d, m: F.add_months(day(d), _int(m)))
define("EOMONTH")(lambda d, m: F.last_day(F.add_months(day(d), _int(m))))
define("ISO.WEEKNUM ISOWEEKNUM")(lambda d: F.weekofyear(day(d)))
define("NOW")(lambda: F.current_timestamp())
define("TODAY")(lambda: F.current_date())


@define("WEEKDAY")
def _weekday(d, kind=1):
    w = F.dayofweek(day(d))  # 1 is Sunday
    if kind == 1:
        return w
    if kind == 2:
        return (w + 5) % 7 + 1
    if kind == 3:
        return (w + 5) % 7
    return F.pmod(w - 2 - (kind - 11), lit(7)) + 1


@define("WEEKNUM")
def _weeknum(d, kind=1):
    if kind == 21:
        return F.weekofyear(day(d))
    first = {1: 1, 2: 2, 11: 2, 12: 3, 13: 4, 14: 5, 15: 6, 16: 7, 17: 1}[kind]
    jan = F.trunc(day(d), "year")
    shift = F.pmod(F.dayofweek(jan) - first, lit(7))
    return F.floor((F.dayofyear(day(d)) - 1 + shift) / 7).cast("int") + 1


def _days360(a: Column, b: Column, european) -> Column:
    d1, d2 = F.dayofmonth(a), F.dayofmonth(b)
    last = lambda x: (F.month(x) == 2) & (x == F.last_day(x))
    if european:
        x, y = F.least(d1, lit(30)), F.least(d2, lit(30))
    else:
        x = F.when(last(a) | (d1 == 31), 30).otherwise(d1)
        y = F.when(last(a) & last(b), 30).when((d2 == 31) & (x == 30), 30).otherwise(d2)
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + y - x


define("DAYS360")(lambda a, b, european=False: _days360(day(a), day(b), european))


@define("YEARFRAC")
def yearfrac(a, b, basis=0):
    a, b = F.least(day(a), day(b)), F.greatest(day(a), day(b))
    days = F.datediff(b, a)
    if basis == 0:
        return _days360(a, b, False) / 360.0
    if basis == 2:
        return days / 360.0
    if basis == 3:
        return days / 365.0
    if basis == 4:
        return _days360(a, b, True) / 360.0
    years = F.year(b) - F.year(a) + 1
    span = F.datediff(F.make_date(F.year(b) + 1, lit(1), lit(1)), F.make_date(F.year(a), lit(1), lit(1)))
    leap = lambda y: F.dayofyear(F.make_date(y, lit(12), lit(31))) == 366
    within = F.add_months(a, 12) >= b
    feb_a, feb_b = F.make_date(F.year(a), lit(3), lit(1)), F.make_date(F.year(b), lit(3), lit(1))
    has = (leap(F.year(a)) & (a < feb_a) & (b >= feb_a)) | (leap(F.year(b)) & (F.year(b) > F.year(a)) & (b >= feb_b)) | (leap(F.year(a)) & (F.year(a) == F.year(b)))
    return F.when(within, days / F.when(has, 366.0).otherwise(365.0)).otherwise(days / (span / years))


@define("DATEDIF")
def _datedif(a, b, unit):
    a, b, u = day(a), day(b), str(unit).upper()
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")
    if u == "Y":
        out = F.floor(months / 12).cast("int")
    elif u == "M":
        out = months
    elif u == "D":
        out = F.datediff(b, a)
    elif u == "YM":
        out = months % 12
    elif u == "MD":
        out = F.when(F.dayofmonth(b) >= F.dayofmonth(a), F.dayofmonth(b) - F.dayofmonth(a)).otherwise(F.dayofmonth(b) + F.dayofmonth(F.last_day(F.add_months(b, -1))) - F.dayofmonth(a))
    else:
        out = F.datediff(b, F.add_months(a, F.floor(months / 12).cast("int") * 12))
    return F.when(a <= b, out)


def _mask(weekend) -> str:
    """Seven characters from Monday on; 1 is a day off."""
    if isinstance(weekend, str):
        return weekend
    if weekend >= 11:
        return "".join("1" if k == (weekend - 11 + 6) % 7 else "0" for k in range(7))
    return "".join("1" if k in ((weekend - 1 + 5) % 7, (weekend - 1 + 6) % 7) else "0" for k in range(7))


def _works(d: Column, mask: str, holidays) -> Column:
    off = [k for k, c in enumerate(mask) if c == "1"]
    ok = ~F.weekday(d).isin(*off) if off else lit(True)
    return ok & ~F.array_contains(holidays, d) if holidays is not None else ok


def _networkdays(a, b, mask: str, holidays):
    lo, hi = F.least(day(a), day(b)), F.greatest(day(a), day(b))
    n = F.datediff(hi, lo) + 1
    full, rest, start = F.floor(n / 7).cast("int"), (n % 7), F.weekday(lo)
    per_week = mask.count("0")
    extra = F.aggregate(F.sequence(lit(0), lit(6)), lit(0), lambda s, k: s + F.when((k < rest) & (F.substring(lit(mask), (start + k) % 7 + 1, lit(1)) == "0"), 1).otherwise(0))
    total = full * per_week + extra
    if holidays is not None:
        total = total - F.size(F.filter(F.array_distinct(holidays), lambda d: (d >= lo) & (d <= hi) & _works(d, mask, None)))
    return F.when(day(a) <= day(b), total).otherwise(-total)


define("NETWORKDAYS")(lambda a, b, holidays=None: _networkdays(a, b, "0000011", holidays))
define("NETWORKDAYS.INTL")(lambda a, b, weekend=1, holidays=None: _networkdays(a, b, _mask(weekend), holidays))


def _workday(a, n, mask: str, holidays):
    """The n-th working day from a, n not 0; days are listed with room for weekends and holidays."""
    a, n = day(a), _int(n)
    extra = F.size(holidays) if holidays is not None else lit(0)
    span = (F.abs(n) * 7 / max(1, mask.count("0"))).cast("int") + 14 + extra * 2
    ahead = F.sequence(F.date_add(a, 1), F.date_add(a, span))
    back = F.transform(F.sequence(lit(1), span), lambda k: F.date_sub(a, k))
    days = F.filter(F.when(n >= 0, ahead).otherwise(back), lambda d: _works(d, mask, holidays))
    return F.when(n == 0, a).otherwise(F.try_element_at(days, F.greatest(F.abs(n), lit(1))))


define("WORKDAY")(lambda a, n, holidays=None: _workday(a, n, "0000011", holidays))
define("WORKDAY.INTL")(lambda a, n, weekend=1, holidays=None: _workday(a, n, _mask(weekend), holidays))
_THAI_DAYS = ["อาทิตย์", "จันทร์", "อังคาร", "พุธ", "พฤหัสบดี", "ศุกร์", "เสาร์"]
_THAI_MONTHS = ["มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม"]
define("THAIDAYOFWEEK")(lambda d: F.concat(lit("วัน"), F.element_at(F.array(*map(lit, _THAI_DAYS)), F.dayofweek(day(d)))))
define("THAIMONTHOFYEAR")(lambda d: F.element_at(F.array(*map(lit, _THAI_MONTHS)), F.month(day(d))))
define("THAIYEAR")(lambda d: F.year(day(d)) + 543)
