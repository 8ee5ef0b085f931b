"""Financial functions: closed forms as Columns, root finding and coupon schedules as Arrow-batched UDFs."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.cells import define
from gridloom.functions.cells.dates import day, yearfrac
from gridloom.functions.cells.math import _num, col
from gridloom.functions.cells.numeric import _arrays, _udf

lit = F.lit


def _grow(r: Column, n: Column) -> Column:
    return F.pow(1 + r, n)


def pv(rate, nper, pmt, fv=0, kind=0):
    r, n, p, f, k = map(_num, (rate, nper, pmt, fv, kind))
    return F.when(r == 0, -(f + p * n)).otherwise(-(f + p * (1 + r * k) * (_grow(r, n) - 1) / F.nullif(r, lit(0.0))) / _grow(r, n))


def fv(rate, nper, pmt, pv0=0, kind=0):
    r, n, p, v, k = map(_num, (rate, nper, pmt, pv0, kind))
    return F.when(r == 0, -(v + p * n)).otherwise(-(v * _grow(r, n) + p * (1 + r * k) * (_grow(r, n) - 1) / F.nullif(r, lit(0.0))))


def pmt(rate, nper, pv0, fv0=0, kind=0):
    r, n, v, f, k = map(_num, (rate, nper, pv0, fv0, kind))
    return F.when(r == 0, -(v + f) / n).otherwise(-(v * _grow(r, n) + f) * r / F.nullif((1 + r * k) * (_grow(r, n) - 1), lit(0.0)))


def ipmt(rate, per, nper, pv0, fv0=0, kind=0):
    r, t, k = _num(rate), _num(per), _num(kind)
    p = pmt(rate, nper, pv0, fv0, kind)
    before = fv(rate, t - 1, p, pv0, kind)
    return F.when((k == 1) & (t == 1), 0.0).when(k == 1, (fv(rate, t - 2, p, pv0, 1) - p) * r).otherwise(before * r)


define("PV")(pv)
define("FV")(fv)
define("PMT")(pmt)
define("IPMT")(ipmt)
define("PPMT")(lambda rate, per, nper, pv0, fv0=0, kind=0: pmt(rate, nper, pv0, fv0, kind) - ipmt(rate, per, nper, pv0, fv0, kind))
define("NPER")(lambda rate, p, v, f=0, kind=0: (lambda r, p, v, f, k: F.when(r == 0, -(v + f) / F.nullif(p, lit(0.0))).otherwise(F.ln((p * (1 + r * k) - f * r) / F.nullif(p * (1 + r * k) + v * r, lit(0.0))) / F.ln(1 + r)))(*map(_num, (rate, p, v, f, kind))))
define("ISPMT")(lambda rate, per, nper, v: -_num(v) * _num(rate) * (1 - _num(per) / _num(nper)))
_span = lambda a, b: F.sequence(_num(a).cast("int"), _num(b).cast("int"))
define("CUMIPMT")(lambda rate, nper, v, a, b, kind=0: F.aggregate(_span(a, b), lit(0.0), lambda s, t: s + ipmt(rate, t, nper, v, 0, kind)))
define("CUMPRINC")(lambda rate, nper, v, a, b, kind=0: F.aggregate(_span(a, b), lit(0.0), lambda s, t: s + pmt(rate, nper, v, 0, kind) - ipmt(rate, t, nper, v, 0, kind)))
define("EFFECT")(lambda r, n: F.when((_num(r) > 0) & (_num(n) >= 1), F.pow(1 + _num(r) / F.floor(_num(n)), F.floor(_num(n))) - 1))
define("NOMINAL")(lambda r, n: F.when((_num(r) > 0) & (_num(n) >= 1), (F.pow(1 + _num(r), 1 / F.floor(_num(n))) - 1) * F.floor(_num(n))))
define("RRI")(lambda n, v, f: F.pow(_num(f) / _num(v), 1 / _num(n)) - 1)
define("PDURATION")(lambda r, v, f: (F.ln(_num(f)) - F.ln(_num(v))) / F.ln(1 + _num(r)))
define("SLN")(lambda c, s, n: (_num(c) - _num(s)) / F.nullif(_num(n), lit(0.0)))
define("SYD")(lambda c, s, n, t: (_num(c) - _num(s)) * (_num(n) - _num(t) + 1) * 2 / (_num(n) * (_num(n) + 1)))
define("DOLLARDE")(lambda x, f: (lambda v, d: _sgn(v) * (F.floor(F.abs(v)) + (F.abs(v) - F.floor(F.abs(v))) * F.pow(lit(10.0), F.ceil(F.log10(d))) / d))(_num(x), F.floor(_num(f))))
define("DOLLARFR")(lambda x, f: (lambda v, d: _sgn(v) * (F.floor(F.abs(v)) + (F.abs(v) - F.floor(F.abs(v))) * d / F.pow(lit(10.0), F.ceil(F.log10(d)))))(_num(x), F.floor(_num(f))))


def _sgn(v: Column) -> Column:
    return F.signum(v)


def _ddb(cost, salvage, life, period, factor=2.0):
    value, out = cost, 0.0
    for _ in range(int(math.ceil(period))):
        out = min(value * factor / life, max(0.0, value - salvage))
        value -= out
    return out


def _db(cost, salvage, life, period, month=12.0):
    rate = round(1 - (salvage / cost) ** (1 / life), 3)
    total, out = 0.0, 0.0
    for t in range(1, int(period) + 1):
        out = cost * rate * month / 12 if t == 1 else (cost - total) * rate * (12 - month) / 12 if t == int(life) + 1 else (cost - total) * rate
        total += out
    return out


def _vdb(cost, salvage, life, start, end, factor=2.0, stay=False):
    """Declining balance, with a change to the straight line once that is more."""
    value, total = cost, 0.0
    t = 0.0
    while t < end - 1e-12:
        declining = min(value * factor / life, max(0.0, value - salvage))
        line = max(0.0, value - salvage) / max(life - t, 1e-300)
        whole = declining if stay else max(declining, line)
        whole = min(whole, max(0.0, value - salvage))
        lo, hi = max(start, t), min(end, t + 1)
        if hi > lo:
            total += whole * (hi - lo)
        value -= whole
        t += 1
    return total


def _root(f, guess: float) -> float:
    """A root near guess: Newton steps, then bisection over a widening bracket."""
    x = guess
    for _ in range(60):
        y = f(x)
        d = (f(x + 1e-7) - y) / 1e-7
        if d == 0 or not math.isfinite(y):
            break
        new = max(x - y / d, (x - 0.9999999) / 2 if x - y / d <= -1 else x - y / d)
        if abs(new - x) < 1e-13:
            return new
        x = new
    lo, hi = -0.999999, 1.0
    while f(lo) * f(hi) > 0 and hi < 1e9:
        hi *= 2
    if f(lo) * f(hi) > 0:
        raise ValueError
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(lo) * f(mid) <= 0 else (mid, hi)
    return (lo + hi) / 2


def _rate(n, p, v, f=0.0, kind=0.0, guess=0.1):
    def g(r):
        if abs(r) < 1e-12:
            return v + p * n + f
        z = (1 + r) ** n
        return v * z + p * (1 + r * kind) * (z - 1) / r + f

    return _root(g, guess)


_scalars = {"DDB": _ddb, "DB": _db, "VDB": _vdb, "RATE": _rate}
for _n, _f in _scalars.items():
    define(_n)(lambda *a, f=_f: _udf(f)(*[col(x) if isinstance(x, bool) else _num(x) for x in a]))
define("NPV", "array")(lambda r, values: F.aggregate(F.transform(values, lambda v, i: v / F.pow(1 + _num(r), i + 1.0)), lit(0.0), lambda s, v: s + v))
define("IRR", "array")(lambda values, guess=0.1: _arrays(lambda v, g: _root(lambda r: sum(x / (1 + r) ** i for i, x in enumerate(v)), g), "double")(values, _num(guess)))
define("MIRR", "array")(lambda values, fr, rr: _arrays(lambda v, a, b: (-sum(x * (1 + b) ** (len(v) - 1 - i) for i, x in enumerate(v) if x > 0) / sum(x / (1 + a) ** i for i, x in enumerate(v) if x < 0)) ** (1 / (len(v) - 1)) - 1, "double")(values, _num(fr), _num(rr)))
_day_no = lambda d: F.transform(d, lambda x: F.unix_date(x.cast("date")).cast("double"))
define("XNPV", "array")(lambda r, values, dates: F.aggregate(F.zip_with(values, dates, lambda v, d: v / F.pow(1 + _num(r), F.datediff(d, F.element_at(dates, 1)) / 365.0)), lit(0.0), lambda s, v: s + v))
define("XIRR", "array")(lambda values, dates, guess=0.1: _arrays(lambda v, d, g: _root(lambda r: sum(x / (1 + r) ** ((t - d[0]) / 365) for x, t in zip(v, d)), g), "double")(values, _day_no(dates), _num(guess)))
define("FVSCHEDULE", "array")(lambda v, rates: F.aggregate(rates, _num(v), lambda s, r: s * (1 + r)))

# --- discount securities
_yf = lambda a, b, basis: yearfrac(a, b, basis)
define("DISC")(lambda s, m, price, red, basis=0: (_num(red) - _num(price)) / _num(red) / _yf(s, m, basis))
define("INTRATE")(lambda s, m, inv, red, basis=0: (_num(red) - _num(inv)) / _num(inv) / _yf(s, m, basis))
define("RECEIVED")(lambda s, m, inv, disc, basis=0: _num(inv) / (1 - _num(disc) * _yf(s, m, basis)))
define("PRICEDISC")(lambda s, m, disc, red, basis=0: _num(red) * (1 - _num(disc) * _yf(s, m, basis)))
define("YIELDDISC")(lambda s, m, price, red, basis=0: (_num(red) / _num(price) - 1) / _yf(s, m, basis))
define("PRICEMAT")(lambda s, m, issue, rate, yld, basis=0: (100 + _yf(issue, m, basis) * _num(rate) * 100) / (1 + _yf(s, m, basis) * _num(yld)) - _yf(issue, s, basis) * _num(rate) * 100)
define("YIELDMAT")(lambda s, m, issue, rate, price, basis=0: ((1 + _yf(issue, m, basis) * _num(rate)) / (_num(price) / 100 + _yf(issue, s, basis) * _num(rate)) - 1) / _yf(s, m, basis))
define("ACCRINTM")(lambda issue, s, rate, par=1000, basis=0: _num(par) * _num(rate) * _yf(issue, s, basis))
_bill = lambda s, m: F.datediff(day(m), day(s)).cast("double")
define("TBILLPRICE")(lambda s, m, d: 100 * (1 - _num(d) * _bill(s, m) / 360))
define("TBILLYIELD")(lambda s, m, p: (100 - _num(p)) / _num(p) * 360 / _bill(s, m))
define("TBILLEQ")(lambda s, m, d: F.when(_bill(s, m) <= 182, 365 * _num(d) / (360 - _num(d) * _bill(s, m))).otherwise((lambda p, t: (-2 * t + 2 * F.sqrt(t * t - (2 * t - 1) * (1 - 1 / p))) / (2 * t - 1))(1 - _num(d) * _bill(s, m) / 360, _bill(s, m) / 365)))

# --- coupon schedules


def _shift(d: dt.date, months: int, end: bool) -> dt.date:
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    last = (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(1)).day
    return dt.date(y, m + 1, last if end else min(d.day, last))


def _is_end(d: dt.date) -> bool:
    return (d + dt.timedelta(1)).month != d.month


def _coupons(s: dt.date, m: dt.date, freq: float) -> tuple[dt.date, dt.date, int]:
    """The coupon dates around settlement and the number of coupons after it."""
    if not s < m or freq not in (1, 2, 4):
        raise ValueError
    step, n, end = int(12 / freq), 0, _is_end(m)
    while _shift(m, -step * n, end) > s:
        n += 1
    return _shift(m, -step * n, end), _shift(m, -step * (n - 1), end), n


def _d360(a: dt.date, b: dt.date, eu: bool = False) -> int:
    x, y = min(a.day, 30), b.day
    if eu:
        y = min(y, 30)
    elif y == 31 and x == 30:
        y = 30
    return (b.year - a.year) * 360 + (b.month - a.month) * 30 + y - x


def _count(a: dt.date, b: dt.date, basis: float) -> float:
    return float(_d360(a, b, basis == 4) if basis in (0, 4) else (b - a).days)


def _period(prev: dt.date, nxt: dt.date, freq: float, basis: float) -> float:
    return float((nxt - prev).days) if basis == 1 else 365 / freq if basis == 3 else 360 / freq


def _price(s, m, rate, yld, red, freq, basis=0.0):
    prev, nxt, n = _coupons(s, m, freq)
    e, a = _period(prev, nxt, freq, basis), _count(prev, s, basis)
    w = (e - a) / e if basis in (0, 4) else _count(s, nxt, basis) / e
    c = 100 * rate / freq
    if n == 1:
        return (red + c) / (1 + w * yld / freq) - c * a / e
    return red / (1 + yld / freq) ** (n - 1 + w) + sum(c / (1 + yld / freq) ** (k + w) for k in range(n)) - c * a / e


def _duration(s, m, rate, yld, freq, basis=0.0):
    prev, nxt, n = _coupons(s, m, freq)
    e, a = _period(prev, nxt, freq, basis), _count(prev, s, basis)
    w = (e - a) / e
    flows = [(k + w, 100 * rate / freq + (100 if k == n - 1 else 0)) for k in range(n)]
    v = [(t, c / (1 + yld / freq) ** t) for t, c in flows]
    return sum(t * x for t, x in v) / sum(x for _, x in v) / freq


def _odd_first(s, m, issue, first, rate, yld, red, freq, basis=0.0):
    """A first period that is shorter or longer than the others, as quasi-coupon periods before the first coupon."""
    step, c = int(12 / freq), 100 * rate / freq
    end = _is_end(m)
    n = 0
    while _shift(first, step * n, end) < m:
        n += 1
    edges = [first]
    while edges[-1] > issue:
        edges.append(_shift(first, -step * len(edges), end))
    edges.reverse()
    share, gone, wait = 0.0, 0.0, 0.0
    for lo, hi in zip(edges, edges[1:]):
        e = _period(lo, hi, freq, basis)
        share += _count(max(lo, issue), hi, basis) / e
        gone += max(0.0, _count(max(lo, issue), min(max(s, lo), hi), basis) / e) if s > max(lo, issue) else 0.0
        wait += _count(max(lo, s), hi, basis) / e if s < hi else 0.0
    q = 1 + yld / freq
    return red / q ** (n + wait) + c * share / q**wait + sum(c / q ** (k + wait) for k in range(1, n + 1)) - c * gone


def _odd_last(s, m, last, rate, yld, red, freq, basis=0.0):
    step, c = int(12 / freq), 100 * rate / freq
    end = _is_end(last)
    edges = [last]
    while edges[-1] < m:
        edges.append(_shift(last, step * len(edges), end))
    whole = gone = wait = 0.0
    for lo, hi in zip(edges, edges[1:]):
        e = _period(lo, hi, freq, basis)
        whole += _count(lo, min(hi, m), basis) / e
        gone += _count(lo, min(hi, s), basis) / e if s > lo else 0.0
        wait += _count(max(lo, s), min(hi, m), basis) / e if s < min(hi, m) else 0.0
    return (red + c * whole) / (1 + wait * yld / freq) - c * gone


def _amor_linc(cost, bought, first, salvage, period, rate, basis=0.0):
    part = _count(bought, first, basis) / (360 if basis in (0, 2, 4) else 365)
    one, p = cost * rate, int(period)
    start = one * part
    if p == 0:
        return start
    left = cost - salvage - start - one * (p - 1)
    return max(0.0, min(one, left))


def _amor_degrc(cost, bought, first, salvage, period, rate, basis=0.0):
    life = 1 / rate
    factor = 1.0 if life < 3 else 1.5 if life < 5 else 2.0 if life <= 6 else 2.5
    r, value = rate * factor, cost
    n = math.floor(_count(bought, first, basis) / (360 if basis in (0, 2, 4) else 365) * r * cost + 0.5)
    value -= n
    rest = value - salvage
    for k in range(int(period)):
        n = math.floor(r * value + 0.5)
        rest -= n
        if rest < 0:
            return float(math.floor(value * 0.5 + 0.5)) if int(period) - k in (1, 2) else 0.0
        value -= n
    return float(n)


def _accrint(issue, first, s, rate, par, freq, basis=0.0):
    step, end, edges = int(12 / freq), _is_end(first), [first]
    while edges[-1] > issue:
        edges.append(_shift(first, -step * len(edges), end))
    edges.reverse()
    while edges[-1] < s:
        edges.append(_shift(first, step * (len(edges)), end))
    total = sum(_count(max(lo, issue), min(hi, s), basis) / _period(lo, hi, freq, basis) for lo, hi in zip(edges, edges[1:]) if s > lo and hi > issue)
    return par * rate / freq * total


_DATED = {
    "COUPNUM": (2, lambda s, m, f, b=0.0: float(_coupons(s, m, f)[2])), "COUPPCD": (2, lambda s, m, f, b=0.0: _coupons(s, m, f)[0]), "COUPNCD": (2, lambda s, m, f, b=0.0: _coupons(s, m, f)[1]),
    "COUPDAYBS": (2, lambda s, m, f, b=0.0: _count(_coupons(s, m, f)[0], s, b)), "COUPDAYS": (2, lambda s, m, f, b=0.0: _period(*_coupons(s, m, f)[:2], f, b)), "COUPDAYSNC": (2, lambda s, m, f, b=0.0: _period(*_coupons(s, m, f)[:2], f, b) - _count(_coupons(s, m, f)[0], s, b) if b in (0, 4) else _count(s, _coupons(s, m, f)[1], b)),
    "PRICE": (2, _price), "YIELD": (2, lambda s, m, rate, price, red, f, b=0.0: _root(lambda y: _price(s, m, rate, y, red, f, b) - price, rate or 0.05)), "DURATION": (2, _duration), "MDURATION": (2, lambda s, m, rate, y, f, b=0.0: _duration(s, m, rate, y, f, b) / (1 + y / f)),
    "ODDFPRICE": (4, _odd_first), "ODDFYIELD": (4, lambda s, m, i, first, rate, price, red, f, b=0.0: _root(lambda y: _odd_first(s, m, i, first, rate, y, red, f, b) - price, rate or 0.05)),
    "ODDLPRICE": (3, _odd_last), "ODDLYIELD": (3, lambda s, m, last, rate, price, red, f, b=0.0: _root(lambda y: _odd_last(s, m, last, rate, y, red, f, b) - price, rate or 0.05)), "ACCRINT": (3, _accrint),
}
for _n, (_k, _f) in _DATED.items():
    define(_n)(lambda *a, k=_k, f=_f, n=_n: _udf(f, "date" if n in ("COUPPCD", "COUPNCD") else "double")(*[day(x) if i < k else _num(x) for i, x in enumerate(a)]))
for _n, _f in {"AMORLINC": _amor_linc, "AMORDEGRC": _amor_degrc}.items():
    define(_n)(lambda *a, f=_f: _udf(f)(*[day(x) if i in (1, 2) else _num(x) for i, x in enumerate(a)]))
