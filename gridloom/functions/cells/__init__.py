"""The cell function library: name -> function of Columns (or of DataFrames for table functions).

REGISTRY holds Function(name, kind, call, least, most). Kinds: scalar (Columns
in, Column out), aggregate (Columns in, aggregate Column out), window, array
(array Columns), table (DataFrames). Where a spreadsheet gives an error value,
a Column is null; ERROR.TYPE, ISERROR and so on read error codes kept as text
("#N/A") in columns that hold them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple


class Function(NamedTuple):
    name: str
    kind: str
    call: Callable
    least: int
    most: int


REGISTRY: dict[str, Function] = {}


def define(names: str, kind: str = "scalar"):
    """Decorator: register a function under one or more names."""
    import inspect

    def add(f):
        ps = inspect.signature(f).parameters.values()
        least = sum(p.default is p.empty and p.kind is not p.VAR_POSITIONAL for p in ps)
        most = 255 if any(p.kind is p.VAR_POSITIONAL for p in ps) else len(ps)
        for n in names.split():
            REGISTRY[n] = Function(n, kind, f, least, most)
        return f

    return add


def call(name: str, *args):
    """Call a function by its spreadsheet name."""
    f = REGISTRY[name.upper()]
    if not f.least <= len(args) <= f.most:
        raise TypeError(f"{f.name} takes {f.least} to {f.most} arguments")
    return f.call(*args)


from gridloom.functions.cells import aggregates, dates, engineering, financial, lookup, math, numeric, text  # noqa: E402, F401
