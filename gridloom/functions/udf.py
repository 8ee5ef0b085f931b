"""User functions: a registry of Python functions that run as Arrow-batched UDFs, also from SQL and cell expressions."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {"float": "double", "int": "long", "str": "string", "bool": "boolean"}
CUSTOM: dict[str, Callable[..., Column]] = {}


def custom_function(f: Callable | None = None, *, name: str | None = None, returns: str | None = None, vectorized: bool = False):
    """Decorator: register f; it keeps working as plain Python, and f.column(...) applies it to Columns.

    The return type comes from `returns` or the annotation. A function on
    single values is called for each row of an Arrow batch; with vectorized
    it gets pandas Series.
    """

    def add(f: Callable):
        hint = inspect.signature(f).return_annotation
        kind = returns or _KINDS.get(hint if isinstance(hint, str) else getattr(hint, "__name__", ""), "string")

        def column(*args) -> Column:
            cols = [a if isinstance(a, Column) else F.lit(a) for a in args]
            if vectorized:
                return F.pandas_udf(f, kind)(*cols)
            return F.udf(f, kind, useArrow=True)(*cols)

        f.column, f.kind, f.vectorized = column, kind, vectorized
        CUSTOM[(name or f.__name__).upper()] = column
        from gridloom.functions.cells import Function, REGISTRY

        n = len(inspect.signature(f).parameters)
        REGISTRY[(name or f.__name__).upper()] = Function((name or f.__name__).upper(), "scalar", column, 0, n)
        return f

    return add(f) if f else add


def register_sql(spark: SparkSession, f: Callable, name: str | None = None) -> None:
    """Make a custom function callable from SQL."""
    spark.udf.register(name or f.__name__, F.pandas_udf(f, f.kind) if f.vectorized else F.udf(f, f.kind))


def range_to_dataframe(df: DataFrame, most: int = 1_000_000):
    """A range as a pandas frame; refuses more than `most` rows."""
    got = df.limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    return got


def range_from_dataframe(spark: SparkSession, frame) -> DataFrame:
    return spark.createDataFrame(frame)
