"""What-if analysis: goal seek, scenarios, Monte Carlo."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def goal_seek(f: Callable[[float], float], target: float, start: float = 0.0, tolerance: float = 1e-9, most: int = 200) -> float:
    """x with f(x) near target, by secant steps, then bisection of a bracket."""
    a, b = start, start + (abs(start) * 0.01 or 1.0)
    fa, fb = f(a) - target, f(b) - target
    for _ in range(most):
        if abs(fb) <= tolerance:
            return b
        if fa == fb:
            break
        a, b, fa = b, b - fb * (b - a) / (fb - fa), fb
        fb = f(b) - target
    lo, hi = start - 1.0, start + 1.0
    while (f(lo) - target) * (f(hi) - target) > 0:
        lo, hi = lo * 2 - hi, hi * 2 - lo
        if hi - lo > 1e12:
            raise ValueError("no value found")
    for _ in range(most):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (f(lo) - target) * (f(mid) - target) <= 0 else (mid, hi)
    return (lo + hi) / 2


def scenarios(df: DataFrame, named: dict[str, dict[str, object]], outputs: dict[str, str]) -> DataFrame:
    """Outputs (SQL expressions of aggregates) under each named set of column values; scenarios are a few rows on the driver."""
    parts = []
    for name, changes in named.items():
        changed = df.withColumns({c: F.expr(v) if isinstance(v, str) else F.lit(v) for c, v in changes.items()}) if changes else df
        parts.append(changed.agg(*[F.expr(e).alias(n) for n, e in outputs.items()]).withColumn("scenario", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def monte_carlo(spark: SparkSession, n: int, inputs: dict[str, dict], correlation: list[list[float]] | None = None, seed: int = 1) -> DataFrame:
    """n draws of the inputs. Kinds: normal, uniform, triangular, lognormal, discrete, beta, exponential, poisson.

    correlation (in the order of the inputs) joins the normal drivers of all
    inputs by its Cholesky factor; each input is then read off its inverse
    distribution.
    """
    import numpy as np

    from gridloom.functions.cells.numeric import _beta_inv, _poisson, norm_cdf, norm_inv

    names = list(inputs)
    low = np.linalg.cholesky(np.array(correlation, float)) if correlation else np.eye(len(names))
    df = spark.range(n)
    df = df.withColumns({f"__z{k}": F.randn(seed + k) for k in range(len(names))})
    mixed = {f"__y{i}": sum((F.col(f"__z{j}") * float(low[i, j]) for j in range(i + 1)), F.lit(0.0)) for i in range(len(names))}
    df = df.withColumns(mixed)

    @F.pandas_udf("double")
    def uniform(z: pd.Series) -> pd.Series:
        return z.map(norm_cdf)

    for k, name in enumerate(names):
        p, z = inputs[name], F.col(f"__y{k}")
        u, kind = uniform(z), p["kind"]
        if kind == "normal":
            v = z * p["sd"] + p["mean"]
        elif kind == "lognormal":
            v = F.exp(z * p["sd"] + p["mean"])
        elif kind == "uniform":
            v = u * (p["high"] - p["low"]) + p["low"]
        elif kind == "exponential":
            v = -F.ln(1 - u) / p["rate"]
        elif kind == "triangular":
            a, c, b = p["low"], p["mode"], p["high"]
            v = F.when(u < (c - a) / (b - a), a + F.sqrt(u * (b - a) * (c - a))).otherwise(b - F.sqrt((1 - u) * (b - a) * (b - c)))
        elif kind == "discrete":
            at, v = 0.0, None
            for x, w in zip(p["values"], p["probabilities"]):
                at += w
                v = F.when(u <= at, float(x)) if v is None else v.when(u <= at, float(x))
            v = v.otherwise(float(p["values"][-1]))
        elif kind == "beta":
            a, b = p["alpha"], p["beta"]
            v = F.pandas_udf(lambda s: s.map(lambda q: _beta_inv(min(max(q, 1e-12), 1 - 1e-12), a, b)), "double")(u)
        else:
            mean = p["mean"]

            def draw(q, mean=mean):
                k = max(0, int(mean + math.sqrt(mean) * norm_inv(min(max(q, 1e-12), 1 - 1e-12))))
                while k > 0 and _poisson(k - 1, mean) >= q:
                    k -= 1
                while _poisson(k, mean) < q:
                    k += 1
                return float(k)

            v = F.pandas_udf(lambda s, draw=draw: s.map(draw), "double")(u)
        df = df.withColumn(name, v)
    return df.select("id", *names)
