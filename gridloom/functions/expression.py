"""The small expression language of added and transformed columns, compiled to Columns.

Grammar, loosest first: ``a ? b : c``, ``||``, ``&&``, ``== != === !==``,
``< <= > >=``, ``+ -``, ``* / %``, unary ``! + -``. ``[Name]`` is a column,
``_`` the current cell. Only the functions in FUNCTIONS can be called.
Arithmetic counts null as 0 and booleans as 0 or 1; division by zero gives an
infinity; text that is not a number gives NaN.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: under this key the step format holds an expression.
EXPRESSION_KEY = "formula"
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>"(?:\\.|""|[^"\\])*"|'(?:\\.|[^'\\])*')|\[(?P<col>(?:\]\]|[^\]])+)\]|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>===|!==|==|!=|<=|>=|&&|\|\||[-+*/%<>!?:(),]))""")
_LEVELS = [("||",), ("&&",), ("===", "!==", "==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%")]
_WORDS = {"and": "&&", "or": "||", "not": "!"}


class Typed(NamedTuple):
    """A Column and what kind of value it holds: number, text, bool, date, datetime, null or other."""

    column: Column
    kind: str


def tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SyntaxError(f"unexpected {text[at : at + 10]!r} in the expression")
        at = m.end()
        if m["num"] is not None:
            out.append(("value", float(m["num"])))
        elif m["str"] is not None:
            body, quote = m["str"][1:-1], m["str"][0]
            out.append(("value", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), body.replace(quote * 2, quote) if quote == '"' else body)))
        elif m["col"] is not None:
            out.append(("column", m["col"].replace("]]", "]").strip()))
        elif m["name"] is not None:
            low = m["name"].lower()
            if low in _WORDS:
                out.append(("op", _WORDS[low]))
            elif low in ("true", "false", "null"):
                out.append(("value", {"true": True, "false": False, "null": None}[low]))
            else:
                out.append(("name", m["name"]))
        else:
            out.append(("op", m["op"]))
    return out


def parse(text: str):
    """The expression as nested tuples; a leading = is allowed."""
    text = text.strip()
    ts = [*tokens(text[1:] if text.startswith("=") and not text.startswith("==") else text), ("end", None)]
    at = 0

    def peek(*ops):
        return ts[at][0] == "op" and ts[at][1] in ops

    def want(op):
        nonlocal at
        if not peek(op):
            raise SyntaxError(f"expected {op!r}")
        at += 1

    def ternary():
        nonlocal at
        test = level(0)
        if peek("?"):
            at += 1
            yes = ternary()
            want(":")
            return ("ternary", test, yes, ternary())
        return test

    def level(k):
        nonlocal at
        if k == len(_LEVELS):
            return unary()
        left = level(k + 1)
        while peek(*_LEVELS[k]):
            op = ts[at][1]
            at += 1
            left = ("binary", op, left, level(k + 1))
        return left

    def unary():
        nonlocal at
        if peek("!", "+", "-"):
            op = ts[at][1]
            at += 1
            return ("unary", op, unary())
        kind, value = ts[at]
        at += 1
        if kind in ("value", "column"):
            return (kind, value)
        if kind == "op" and value == "(":
            inner = ternary()
            want(")")
            return inner
        if kind == "name" and value == "_":
            return ("cell",)
        if kind == "name":
            if value.lower() not in FUNCTIONS:
                raise SyntaxError(f"{value!r} is not known")
            want("(")
            args = []
            if not peek(")"):
                args.append(ternary())
                while peek(","):
                    at += 1
                    args.append(ternary())
            want(")")
            return ("call", value.lower(), args)
        raise SyntaxError("the expression ends too early")

    tree = ternary()
    if ts[at][0] != "end":
        raise SyntaxError(f"unexpected {ts[at][1]!r}")
    return tree


def columns_of(tree) -> set[str]:
    """Names of the columns that a parsed expression reads."""
    if tree[0] == "column":
        return {tree[1]}
    return set().union(*(columns_of(x) for part in tree[1:] for x in (part if isinstance(part, list) else [part]) if isinstance(x, tuple)))


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return {T.StringType: "text", T.BooleanType: "bool", T.NullType: "null"}.get(type(t), "other")


def _number(v: Typed) -> Column:
    if v.kind == "null":
        return F.lit(0.0)
    if v.kind == "text":
        text = F.trim(v.column)
        return F.when(v.column.isNull() | (text == ""), F.lit(0.0)).otherwise(F.coalesce(text.try_cast("double"), F.lit(math.nan)))
    if v.kind in ("date", "datetime"):
        return F.unix_millis(v.column.cast("timestamp")).cast("double")
    return F.coalesce(v.column.cast("double"), F.lit(0.0))


def _text(v: Typed) -> Column:
    if v.kind == "null":
        return F.lit("null")
    if v.kind == "number":
        d = v.column.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        return F.when(v.column.isNull(), "null").when(whole, d.cast("decimal(20,0)").cast("string")).otherwise(d.cast("string"))
    return F.coalesce(v.column.cast("string"), F.lit("null"))


def truth(v: Typed) -> Column:
    if v.kind == "bool":
        return F.coalesce(v.column, F.lit(False))
    if v.kind == "number":
        return F.coalesce((v.column != 0) & ~F.isnan(v.column.cast("double")), F.lit(False))
    if v.kind == "text":
        return F.coalesce(v.column != "", F.lit(False))
    return v.column.isNotNull() if v.kind != "null" else F.lit(False)


def _divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(F.isnan(a) | (a == 0), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))


def _same(a: Typed, b: Typed, strict: bool) -> Column:
    if "null" in (a.kind, b.kind):
        other = b if a.kind == "null" else a
        return other.column.isNull()
    if a.kind == b.kind or {a.kind, b.kind} == {"date", "datetime"}:
        left, right = (a.column, b.column) if a.kind == b.kind else (a.column.cast("timestamp"), b.column.cast("timestamp"))
        return left.eqNullSafe(right)
    if strict:
        return a.column.isNull() & b.column.isNull()
    return (a.column.isNull() & b.column.isNull()) | (a.column.isNotNull() & b.column.isNotNull() & (_number(a) == _number(b)) & ~F.isnan(_number(a)))


def _join_kinds(a: Typed, b: Typed) -> tuple[Column, Column, str]:
    """Two branches as one kind; unequal kinds meet as text."""
    if a.kind == b.kind or b.kind == "null":
        return a.column.cast("double") if a.kind == "number" else a.column, b.column.cast("double") if b.kind == "number" else b.column, a.kind
    if a.kind == "null":
        return a.column, b.column.cast("double") if b.kind == "number" else b.column, b.kind
    return a.column.cast("string"), b.column.cast("string"), "text"


def _binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("&&", "||"):
        x, y, kind = _join_kinds(a, b)
        t = truth(a)
        return Typed(F.when(t, y).otherwise(x) if op == "&&" else F.when(t, x).otherwise(y), kind)
    if op in ("==", "===", "!=", "!=="):
        same = _same(a, b, len(op) == 3)
        return Typed(same if op[0] == "=" else ~same, "bool")
    if op in ("<", "<=", ">", ">="):
        if a.kind == b.kind == "text":
            x, y = F.coalesce(a.column, F.lit("null")), F.coalesce(b.column, F.lit("null"))
            x, y = (F.when(a.column.isNull() | b.column.isNull(), F.lit(None)).otherwise(c) for c in (x, y))
        else:
            x, y = _number(a), _number(b)
        found = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if not a.kind == b.kind == "text":
            found = found & ~F.isnan(x) & ~F.isnan(y)
        return Typed(F.coalesce(found, F.lit(False)), "bool")
    if op == "+" and ("text" in (a.kind, b.kind) or {"date", "datetime"} & {a.kind, b.kind}):
        return Typed(F.concat(_text(a), _text(b)), "text")
    x, y = _number(a), _number(b)
    made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: _divide(x, y), "%": lambda: F.when(y != 0, x % F.nullif(y, F.lit(0.0))).otherwise(F.lit(math.nan))}[op]()
    return Typed(made, "number")


def _date(v: Typed) -> Typed:
    return Typed(v.column.cast("date") if v.kind in ("date", "datetime") else F.substring(v.column.cast("string"), 1, 10).try_cast("date"), "date")


def _add_days(v: Typed, n: Typed) -> Typed:
    if v.kind == "text":
        v = _date(v)
    days = n.column.cast("double")
    if v.kind == "date":
        return Typed(F.date_add(v.column, F.floor(days).cast("int")), "date")
    seconds = F.round(days * 86400.0, 3)
    return Typed(v.column + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")), v.kind)


def round_half_up(x: Column, digits: Column) -> Column:
    """Half toward plus infinity, at any number of digits."""
    scale = F.pow(F.lit(10.0), digits.cast("double"))
    return F.floor(x * scale + 0.5).cast("double") / scale


FUNCTIONS = {
    "date": _date,
    "date_from_text": _date,
    "date_add_days": _add_days,
    "text_upper": lambda v: Typed(F.upper(v.column.cast("string")), "text"),
    "text_lower": lambda v: Typed(F.lower(v.column.cast("string")), "text"),
    "text_trim": lambda v: Typed(F.regexp_replace(v.column.cast("string"), r"^\s+|\s+$", ""), "text"),
    "text_length": lambda v: Typed((F.octet_length(F.encode(v.column.cast("string"), "UTF-16BE")) / 2).cast("double"), "number"),
    "text_contains": lambda v, w: Typed(F.coalesce(F.lower(v.column.cast("string")).contains(F.lower(w.column.cast("string"))), F.lit(False)), "bool"),
    "number_round": lambda v, d=None: Typed(F.when(v.column.isNotNull(), round_half_up(_number(v), d.column if d else F.lit(0))), "number"),
}


def compile_expression(text: str, schema: T.StructType, cell: str | None = None) -> Typed:
    """The expression as a Column over a DataFrame of this schema; cell names the column that ``_`` means."""
    kinds = {f.name: kind_of(f.dataType) for f in schema}

    def column(name: str) -> Typed:
        if name not in kinds:
            raise KeyError(f"unknown column {name!r}")
        return Typed(F.col(f"`{name}`"), kinds[name])

    def walk(t) -> Typed:
        if t[0] == "value":
            v = t[1]
            return Typed(F.lit(v), "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, float) else "text")
        if t[0] == "column":
            return column(t[1])
        if t[0] == "cell":
            if cell is None:
                raise KeyError("'_' stands for no cell here")
            return column(cell)
        if t[0] == "unary":
            v = walk(t[2])
            return Typed(~truth(v), "bool") if t[1] == "!" else Typed(-_number(v) if t[1] == "-" else _number(v), "number")
        if t[0] == "binary":
            return _binary(t[1], walk(t[2]), walk(t[3]))
        if t[0] == "ternary":
            test, a, b = map(walk, t[1:])
            x, y, kind = _join_kinds(a, b)
            return Typed(F.when(truth(test), x).otherwise(y), kind)
        return FUNCTIONS[t[1]](*map(walk, t[2]))

    return walk(parse(text))
