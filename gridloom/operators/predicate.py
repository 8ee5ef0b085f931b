"""Predicate trees compiled to two-valued Columns.

A predicate is a dict: {"type": "comparison", "column", "operator", "value",
"caseSensitive"}, {"type": "and" | "or", "predicates": [...]} or
{"type": "not", "predicate": ...}. At places where a null drops the row
anyway (under an even number of "not"), the bare comparison is emitted, so
that filters reach the Parquet scan; elsewhere nulls count as false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORDER = {"greaterThan": "__gt__", "greaterThanOrEqual": "__ge__", "lessThan": "__lt__", "lessThanOrEqual": "__le__"}
_TEXT = {"contains": "contains", "startsWith": "startswith", "endsWith": "endswith"}


def compile_predicate(p: dict, bare: bool = True) -> Column:
    kind = p["type"]
    if kind == "and":
        return reduce(lambda a, b: a & b, [compile_predicate(x, bare) for x in p["predicates"]], F.lit(True)) if p["predicates"] else F.lit(True)
    if kind == "or":
        return reduce(lambda a, b: a | b, [compile_predicate(x, bare) for x in p["predicates"]]) if p["predicates"] else F.lit(False)
    if kind == "not":
        return ~compile_predicate(p["predicate"], False)
    if kind != "comparison":
        raise ValueError(f"unknown predicate {kind!r}")
    c, op, value = F.col(f"`{p['column']}`"), p["operator"], p.get("value")
    if op == "isNull":
        return c.isNull()
    if op == "isNotNull":
        return c.isNotNull()
    if op in ("equals", "notEquals"):
        if value is None:
            return c.isNull() if op == "equals" else c.isNotNull()
        if op == "equals":
            return c == F.lit(value) if bare else c.eqNullSafe(F.lit(value))
        return ~c.eqNullSafe(F.lit(value))
    if op in _ORDER:
        if value is None:
            return F.lit(False)
        found = getattr(c, _ORDER[op])(F.lit(value))
        return found if bare else F.coalesce(found, F.lit(False))
    if op in _TEXT:
        text, want = F.coalesce(c.cast("string"), F.lit("")), "" if value is None else str(value)
        if not p.get("caseSensitive"):
            text, want = F.lower(text), want.lower()
        return getattr(text, _TEXT[op])(want)
    raise ValueError(f"unknown operator {op!r}")
