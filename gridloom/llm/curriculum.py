"""Operator 10: mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.llm.common import free_name, names_apart, range_ranked, small_or_shuffled
from gridloom.runtime import materialize

Schedule = list[tuple[float, float]]


def default_weights(rank: int) -> float:
    return 1.0 + rank % 3


def default_schedule(rank: int) -> Schedule:
    """Sources of even rank rise along the training, the others fall."""
    return [(0.0, 0.5), (0.5, 0.9), (1.0, 1.6)] if rank % 2 == 0 else [(0.0, 1.5), (0.5, 1.1), (1.0, 0.4)]


def targets(sizes: list[tuple[str | None, int]], weights=default_weights, most: float = 3.0) -> dict[str | None, float]:
    """Words to take from each source: shares of the whole by weight, none above `most` times its size."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    total = float(sum(n for _, n in order))
    weight = {s: weights(k) for k, (s, _) in enumerate(order)}
    limit = {s: most * n for s, n in order}
    found: dict[str | None, float] = {}
    while len(found) < len(order):
        rest = [s for s, _ in order if s not in found]
        room, per = total - sum(found.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if room * weight[s] / per > limit[s]]
        if not over:
            return found | {s: room * weight[s] / per for s in rest}
        found |= {s: limit[s] for s in over}
    return found


def _integral(knots: Schedule) -> tuple[list[float], list[float], list[float]]:
    """Times, weights scaled so that they integrate to 1, and the integral up to each time."""
    area = [0.0]
    for (t, a), (u, b) in zip(knots, knots[1:]):
        area.append(area[-1] + (u - t) * (a + b) / 2)
    if knots[0][0] != 0 or knots[-1][0] != 1 or min(w for _, w in knots) <= 0:
        raise ValueError("a schedule runs from 0 to 1 with positive weights")
    return [t for t, _ in knots], [w / area[-1] for _, w in knots], [x / area[-1] for x in area]


def plan(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", weights=default_weights, schedule=default_schedule, most: int = 3) -> DataFrame:
    """docs with source_size, target, taken, copies and positions (array of double, one for each copy that is taken).

    Inside a source, documents stand in the order of a hash of their key. The
    source's words, repeated `most` times, form a line that is taken up to
    the source's target; the position of a copy is the time at which the
    source's cumulative demand (target times the integral of its schedule)
    reaches the copy's first word. taken counts words: the last copy of a
    source is cut at the target, so a source's taken words are its target
    rounded down. positions and copies count whole copies: those whose middle
    lies before the target. Reruns agree.

    Null sources are one source, the last; null sizes count as 0, and a
    document without words is never taken. Rows that agree in key and size
    are interchangeable. Only one row for each source (its words) and one for
    each partition and source leave the tasks. Columns with the new names are
    replaced. An empty table gives an empty result.
    """
    made = ["source_size", "target", "taken", "copies", "positions"]
    keep = [c for c in names_apart(docs, made)]
    rows = materialize(docs.select(*keep, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__size"), F.xxhash64(key).alias("__h")), "mix")
    spark = docs.sparkSession
    sizes = [(r[0], int(r[1])) for r in rows.groupBy(source).agg(F.sum("__size")).collect()]
    goal = targets(sizes, weights, float(most))
    table = []
    for k, (s, n) in enumerate(sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))):
        table.append((s, n, float(goal[s]), *_integral(schedule(k))))
    per_source = spark.createDataFrame(table, "__src string, source_size long, target double, __times array<double>, __heights array<double>, __areas array<double>")
    ranked = range_ranked(rows, [source, "__h", key, "__size"], "mix-ranked")
    seg = ranked.groupBy("__part", F.col(source).alias("__s")).agg(F.sum("__size").alias("__n"))
    line = Window.partitionBy("__s").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("__before", F.coalesce(F.sum("__n").over(line), F.lit(0)))
    seg = seg.join(per_source, F.col("__s").eqNullSafe(F.col("__src"))).drop("__src").withColumnRenamed("__part", "__p")
    inner = Window.partitionBy("__part", source).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    found = ranked.withColumn("__in", F.coalesce(F.sum("__size").over(inner), F.lit(0))).join(seg, (F.col("__part") == F.col("__p")) & F.col(source).eqNullSafe(F.col("__s")))

    def time_of(word):
        y = word / F.col("target")
        j = F.least(F.size(F.filter("__areas", lambda a: a <= y)), F.size("__areas") - 1)  # segment, from 1
        left = F.try_element_at("__times", j)
        span = F.try_element_at("__times", j + 1) - left
        h, g = F.try_element_at("__heights", j), F.try_element_at("__heights", j + 1)
        rest, bend = y - F.try_element_at("__areas", j), (g - h) / span
        return F.least(F.lit(1.0), left + 2 * rest / (h + F.sqrt(F.greatest(h * h + 2 * bend * rest, F.lit(0.0)))))

    at = F.col("__before") + F.col("__in")
    places = [F.when((F.col("__size") > 0) & (k * F.col("source_size") + at + F.col("__size") / 2 <= F.col("target")), time_of(k * F.col("source_size") + at)) for k in range(most)]
    end = F.floor(F.col("target") + 1e-6)
    taken = sum(F.greatest(F.lit(0), F.least(F.col("__size"), end - k * F.col("source_size") - at)) for k in range(most))
    positions = F.filter(F.array(*places), lambda x: x.isNotNull())
    return found.select(*keep, "source_size", "target", taken.cast("long").alias("taken"), positions.alias("positions")).withColumn("copies", F.size("positions")).select(*keep, *made)


def ordered(planned: DataFrame) -> DataFrame:
    """One row for each copy that is taken, range-sorted by training position."""
    rows = planned.withColumn("position", F.explode("positions")).drop("positions", "copies")
    return rows.orderBy("position", *[c for c in ("doc_id",) if c in rows.columns])


def mixed(docs: DataFrame) -> DataFrame:
    """Every row of docs as often as the mix takes it, range-sorted by training position; columns unchanged.

    Size is the number of words of the text. Null and empty texts have size 0
    and are never taken; null sources are one source. Rows, repeated ones too,
    are told apart by a row number, very long texts count whole. An empty
    table gives an empty result.
    """
    row, other, at = (free_name(docs, n) for n in ("__row", "__taken", "__position"))
    base = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-input")
    small = base.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    planned = plan(small).where("copies > 0").select(F.col("row").alias(other), F.explode("positions").alias(at))
    rows = base.join(small_or_shuffled(materialize(planned, "mix-plan"), 200_000), F.col(row) == F.col(other))
    return rows.orderBy(at, "doc_id", row).select(*[F.col(f"`{c}`") for c in docs.columns])


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """The query's rows, sorted by the position of a document's first copy; documents not taken come last.

    Null and empty texts have size 0 and taken 0. Only doc_id, source and text are read.
    """
    small = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"))
    rows = plan(small)
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("position"), "source").orderBy(F.asc_nulls_last("position"), "doc_id")
