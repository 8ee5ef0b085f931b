"""Cell expressions compiled to Columns: =IF([qty]>10, ROUND([price]*1.2, 2), "none").

``[name]`` or ``Table[name]`` or a bare name is a column; operators are
``^ * / + - & = <> < <= > >=`` and the percent sign; LET binds names from left
to right, LAMBDA makes functions for MAP, REDUCE, SCAN, BYROW, BYCOL and
MAKEARRAY, and a bound name hides a built-in function.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import REGISTRY, call
from gridloom.functions.cells.math import _num
from gridloom.functions.cells.text import text

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|"(?P<str>(?:[^"]|"")*)"|(?:[A-Za-z_]\w*)?\[(?P<col>[^\]]+)\]|(?P<err>\#[A-Z/0!?]+[!?]?)|(?P<name>[A-Za-z_][\w.]*)|(?P<op><>|<=|>=|[-+*/^&=<>%(){},;]))""")
_LEVELS = [("=", "<>", "<", "<=", ">", ">="), ("&",), ("+", "-"), ("*", "/")]


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip().removeprefix("=").strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m or m.end() == at:
            raise SyntaxError(f"unexpected {source[at : at + 10]!r}")
        at = m.end()
        out.append((m.lastgroup, m[m.lastgroup]))
    return [*out, ("end", "")]


def parse(source: str):
    ts, at = _tokens(source), 0

    def peek(*ops):
        return ts[at][0] == "op" and ts[at][1] in ops

    def take(*ops):
        nonlocal at
        if ops and not peek(*ops):
            raise SyntaxError(f"expected {ops}, found {ts[at][1]!r}")
        at += 1
        return ts[at - 1]

    def level(k):
        if k == len(_LEVELS):
            return power()
        left = level(k + 1)
        while peek(*_LEVELS[k]):
            left = ("bin", take()[1], left, level(k + 1))
        return left

    def power():
        left = unary()
        while peek("^"):
            take()
            left = ("bin", "^", left, unary())
        return left

    def unary():
        if peek("-", "+"):
            op = take()[1]
            inner = unary()
            return ("neg", inner) if op == "-" else inner
        e = primary()
        while peek("%"):
            take()
            e = ("percent", e)
        return e

    def items(close):
        out = []
        while not peek(close):
            out.append(("missing",) if peek(",") else level(0))
            if peek(","):
                take()
        take(close)
        return out

    def primary():
        kind, value = take()
        if kind == "num":
            return ("value", float(value))
        if kind == "str":
            return ("value", value.replace('""', '"'))
        if kind == "err":
            return ("value", value)
        if kind == "col":
            return ("col", value.lstrip("@"))
        if kind == "name" and peek("("):
            take()
            return ("call", value, items(")"))
        if kind == "name":
            return ("name", value)
        if (kind, value) == ("op", "("):
            inner = level(0)
            take(")")
            return inner
        if (kind, value) == ("op", "{"):
            rows = [[]]
            while not peek("}"):
                rows[-1].append(level(0))
                if peek(";"):
                    rows.append([])
                if peek(",", ";"):
                    take()
            take("}")
            return ("array", rows)
        raise SyntaxError(f"unexpected {value!r}")

    tree = level(0)
    if ts[at][0] != "end":
        raise SyntaxError(f"unexpected {ts[at][1]!r}")
    return tree


def compile_cell(source: str, df: DataFrame) -> Column:
    """The cell expression as a Column over df; aggregates in it make it an aggregate Column."""
    columns = {c.casefold(): c for c in df.columns}

    def constant(e):
        """Plain Python values for arguments that have to be constants."""
        if e[0] == "value":
            return int(e[1]) if isinstance(e[1], float) and e[1].is_integer() else e[1]
        if e[0] == "neg" and isinstance(v := constant(e[1]), (int, float)):
            return -v
        if e[0] == "call" and e[1].upper() in ("TRUE", "FALSE") or e[0] == "name" and e[1].upper() in ("TRUE", "FALSE"):
            return e[1].upper() == "TRUE"
        return None

    def walk(e, names):
        kind = e[0]
        if kind == "value":
            return F.lit(e[1])
        if kind == "missing":
            return F.lit(None)
        if kind == "col" or kind == "name":
            key = e[1].casefold()
            if key in names:
                return names[key]
            if key in ("true", "false"):
                return F.lit(key == "true")
            if key not in columns:
                raise KeyError(f"unknown column {e[1]!r}")
            return F.col(f"`{columns[key]}`")
        if kind == "neg":
            return -_num(walk(e[1], names))
        if kind == "percent":
            return _num(walk(e[1], names)) / 100
        if kind == "array":
            rows = [F.array(*[walk(v, names) for v in r]) for r in e[1]]
            return rows[0] if len(rows) == 1 else F.array(*rows)
        if kind == "bin":
            a, b = walk(e[2], names), walk(e[3], names)
            if e[1] == "&":
                return F.concat(text(a), text(b))
            if e[1] in ("=", "<>"):
                same = a.eqNullSafe(b)
                return same if e[1] == "=" else ~same
            if e[1] in ("<", "<=", ">", ">="):
                return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e[1]]
            x, y = F.coalesce(_num(a), F.lit(0.0)), F.coalesce(_num(b), F.lit(0.0))
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "^": lambda: call("POWER", x, y)}[e[1]]()
        f, args = e[1].upper(), e[2]
        if e[1].casefold() in names and callable(names[e[1].casefold()]):
            return names[e[1].casefold()](*[walk(a, names) for a in args])
        if f == "LET":
            if len(args) < 3 or len(args) % 2 == 0:
                raise SyntaxError("LET takes pairs and a result")
            for n, v in zip(args[:-1:2], args[1:-1:2]):
                names = names | {n[1].casefold(): walk(v, names)}
            return walk(args[-1], names)
        if f == "LAMBDA":
            ps = [a[1].casefold() for a in args[:-1]]
            if len(set(ps)) != len(ps):
                raise SyntaxError("the parameters of LAMBDA have to differ")
            if len(ps) == 1:
                return lambda x: walk(args[-1], names | {ps[0]: x})
            return lambda x, y: walk(args[-1], names | dict(zip(ps, (x, y))))
        if f not in REGISTRY:
            raise KeyError(f"unknown function {e[1]!r}")
        out = []
        for a in args:
            c = constant(a)
            out.append(c if c is not None and REGISTRY[f].kind != "scalar" else c if isinstance(c, (str, int, float, bool)) else walk(a, names))
        return call(f, *out)

    return walk(parse(source), {})
