"""Queries: a source and steps, compiled to one lazy DataFrame."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import steps as S
from gridloom.operators.merge import expand_table_column, merge
from gridloom.sources.readers import load


@dataclass
class Query:
    """source: a dict with type and options; steps: operation dicts, or dicts with an operation."""

    source: dict
    steps: list[dict] = field(default_factory=list)
    id: str = ""
    name: str = ""
    refreshPolicy: dict | None = None

    @classmethod
    def from_json(cls, text: str) -> Query:
        raw = json.loads(text)
        return cls(raw["source"], raw.get("steps", []), raw.get("id", ""), raw.get("name", ""), raw.get("refreshPolicy"))

    def operations(self) -> list[dict]:
        return [s.get("operation", s) for s in self.steps]

    def key(self) -> str:
        """A hash of source and steps: equal plans have equal keys."""
        return hashlib.sha256(json.dumps([self.source, self.operations()], sort_keys=True, default=str).encode()).hexdigest()


class PrivacyError(ValueError):
    pass


class Engine:
    """Runs queries. `queries` holds those that others refer to, `tables` resolves named tables."""

    def __init__(self, spark: SparkSession, queries: dict[str, Query] | None = None, tables: Callable[[str], DataFrame] | dict | None = None, privacy: dict[str, str] | None = None, block_mixing: bool = False):
        self.spark, self.queries, self.privacy, self.block_mixing = spark, queries or {}, privacy or {}, block_mixing
        self._tables = tables if callable(tables) else (tables or {}).get
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        found = self._tables(name)
        return found if found is not None else self.spark.table(name)

    def levels(self, query: Query, seen: frozenset = frozenset()) -> set[str]:
        """Privacy levels of all sources that feed a query; sources are named by their location."""
        src = query.source
        if src["type"] == "query":
            ids = [src["queryId"]]
            own: set[str] = set()
        else:
            ids, own = [], {self.privacy.get(src.get("path") or src.get("url") or src.get("table") or src.get("connection") or "", "unknown")}
        for op in query.operations():
            ids += [op["rightQuery"]] if op["type"] == "merge" else op["queries"] if op["type"] == "append" else []
        for i in ids:
            if i in seen:
                raise ValueError(f"query {i!r} refers to itself")
            own |= self.levels(self.queries[i], seen | {i})
        return own

    def run(self, query: Query, seen: frozenset = frozenset()) -> DataFrame:
        """The query as a lazy DataFrame (promoteHeaders and splitColumn without names look at the data)."""
        if self.block_mixing and not seen and {"public", "private"} <= self.levels(query):
            raise PrivacyError("public and private sources may not be combined")
        src = query.source
        ops = query.operations()
        df = self.reference(src["queryId"], seen) if src["type"] == "query" else self.table(src["table"]) if src["type"] == "table" else load(self.spark, src)
        if any(op["type"] in S.ORDERED for op in ops):
            df = S.add_row(df)
        at = 0
        while at < len(ops):
            op = dict(ops[at])
            kind = op.pop("type")
            following = ops[at + 1] if at + 1 < len(ops) else {}
            if kind == "merge":
                right = self.reference(op.pop("rightQuery"), seen)
                nested = op.get("joinMode") == "nested"
                if nested and following.get("type") == "expandTableColumn" and following["column"] == op.get("newColumnName") and op.get("joinType") in ("inner", "left"):
                    df = self._fused(df, right, op, following)
                    at += 1
                else:
                    df = merge(df, right, **op)
            elif kind == "append":
                df = S.append(df, [self.reference(i, seen) for i in op["queries"]])
                if S.ROW in df.columns:
                    df = S.add_row(df.drop(S.ROW))
            elif kind == "expandTableColumn":
                df = expand_table_column(df, **op)
            else:
                df = S.STEPS[kind](df, **op)
            at += 1
            if S.ROW not in df.columns and any(o["type"] in S.ORDERED for o in ops[at:]):
                df = S.add_row(df)
        return df.orderBy(S.ROW).drop(S.ROW) if S.ROW in df.columns else df

    @staticmethod
    def _fused(df: DataFrame, right: DataFrame, op: dict, expand: dict) -> DataFrame:
        """A nested merge that is expanded at once: a flat join, without lists."""
        shown = expand.get("columns") or op.get("rightColumns") or right.columns
        names = expand.get("newColumnNames") or shown
        keys = op.get("rightKeys") or [op["rightKey"]]
        lifted = right.select(*[S.c(k).alias(f"__key{i}") for i, k in enumerate(keys)], *[S.c(n).alias(m) for n, m in zip(shown, names)])
        flat = {k: v for k, v in op.items() if k not in ("joinMode", "newColumnName", "rightColumns", "rightKey")}
        return merge(df, lifted, **flat | {"rightKeys": [f"__key{i}" for i in range(len(keys))]})

    def reference(self, name: str, seen: frozenset = frozenset()) -> DataFrame:
        if name in seen:
            raise ValueError(f"query {name!r} refers to itself")
        query = self.queries[name]
        if (key := query.key()) not in self._cache:
            self._cache[key] = self.run(query, seen | {name})
        return self._cache[key]
