"""Refresh: cron schedules, dependency order, result caches, incremental upserts; windows over event streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cron:
    """Five fields: minute, hour, day of month, month, day of week (0 and 7 are Sunday)."""

    minutes: frozenset
    hours: frozenset
    days: frozenset
    months: frozenset
    weekdays: frozenset
    any_day: bool
    any_weekday: bool

    @classmethod
    def parse(cls, text: str) -> Cron:
        fields = text.split()
        if len(fields) != 5:
            raise ValueError("a cron schedule has five fields")
        sets = [cls._field(f, lo, hi) for f, (lo, hi) in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)))]
        return cls(*sets[:4], frozenset(d % 7 for d in sets[4]), fields[2] == "*", fields[4] == "*")

    @staticmethod
    def _field(text: str, lo: int, hi: int) -> frozenset:
        out: set[int] = set()
        for part in text.split(","):
            body, _, step = part.partition("/")
            every = int(step) if step else 1
            a, _, b = body.partition("-")
            first, last = (lo, hi) if body == "*" else (int(a), int(b) if b else (hi if step else int(a)))
            if every < 1 or not lo <= first <= last <= hi:
                raise ValueError(f"cron field {text!r} is out of range")
            out |= set(range(first, last + 1, every))
        return frozenset(out)

    def matches(self, t: dt.datetime) -> bool:
        day, week = t.day in self.days, t.isoweekday() % 7 in self.weekdays
        ok = day and week if self.any_day or self.any_weekday else day or week
        return t.minute in self.minutes and t.hour in self.hours and t.month in self.months and ok

    def next_after(self, t: dt.datetime, years: int = 8) -> dt.datetime:
        t = t.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
        end = t.replace(year=t.year + years) if t.month != 2 or t.day != 29 else t + dt.timedelta(days=366 * years)
        while t < end:
            if t.month not in self.months:
                t = (t.replace(day=1, hour=0, minute=0) + dt.timedelta(days=32)).replace(day=1)
            elif not self.matches(t.replace(hour=min(self.hours), minute=min(self.minutes))):
                t = t.replace(hour=0, minute=0) + dt.timedelta(days=1)
            elif t.hour not in self.hours:
                t = t.replace(minute=0) + dt.timedelta(hours=1)
            elif t.minute not in self.minutes:
                t += dt.timedelta(minutes=1)
            else:
                return t
        raise ValueError("the schedule never comes")


def refresh_order(depends: dict[str, list[str]]) -> list[str]:
    """Queries in an order in which each follows those it reads."""
    out: list[str] = []
    state: dict[str, int] = {}

    def visit(n: str) -> None:
        if state.get(n) == 1:
            raise ValueError(f"{n!r} depends on itself")
        if n not in state:
            state[n] = 1
            for d in depends.get(n, []):
                visit(d)
            state[n] = 2
            out.append(n)

    for n in sorted(depends):
        visit(n)
    return out


def refresh_all(engine, names: list[str], on_result: Callable[[str, DataFrame], None]) -> list[str]:
    """Run queries after those they refer to; equal plans run once."""
    depends = {n: [o["rightQuery"] for o in q.operations() if o["type"] == "merge"] + [i for o in q.operations() if o["type"] == "append" for i in o["queries"]] + ([q.source["queryId"]] if q.source["type"] == "query" else []) for n, q in engine.queries.items()}
    done = []
    for n in refresh_order(depends):
        if n in names:
            on_result(n, engine.reference(n))
            done.append(n)
    return done


class ResultCache:
    """Parquet results by plan key and source state, with an age limit and at most `most` entries (least recently used go first)."""

    def __init__(self, folder: str, ttl: float | None = None, most: int = 100, clock: Callable[[], float] | None = None):
        import time

        self.folder, self.ttl, self.most, self.clock = folder.rstrip("/"), ttl, most, clock or time.time
        self.entries: dict[str, tuple[float, float, str]] = {}

    def get(self, spark, key: str, state: str, make: Callable[[], DataFrame]) -> DataFrame:
        import hashlib

        full, now = hashlib.sha256(f"{key}|{state}".encode()).hexdigest(), self.clock()
        hit = self.entries.get(full)
        if hit and (self.ttl is None or now - hit[0] < self.ttl):
            self.entries[full] = (hit[0], now, hit[2])
            return spark.read.parquet(hit[2])
        path = f"{self.folder}/{full}-{int(now * 1000)}"
        make().write.parquet(path)
        self.entries[full] = (now, now, path)
        while len(self.entries) > self.most:
            del self.entries[min(self.entries, key=lambda k: self.entries[k][1])]
        return spark.read.parquet(path)


def incremental(stream: DataFrame, target: str, key: list[str], version: str, checkpoint: str):
    """A streaming upsert: each micro-batch is merged into the Parquet table at target (new folder for each version)."""
    from gridloom.operators.columnar import upsert

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = f"{target}/v{epoch:012d}"
        base = spark.read.parquet(f"{target}/v{epoch - 1:012d}") if epoch else None
        rows = batch if base is None else base.unionByName(batch, allowMissingColumns=True)
        upsert(rows.limit(0), rows, key, version).write.mode("overwrite").parquet(now)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, length: str, slide: str | None = None, lateness: str | None = None, by: str = "event_type") -> DataFrame:
    """Counts and sums of event windows (an extension); with lateness, a watermark bounds the state of a stream."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness:
        df = df.withWatermark("ts", lateness)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return df.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, lateness: str | None = None, user: str = "user_id") -> DataFrame:
    """Sessions of a user with gaps below `gap` (an extension)."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness:
        df = df.withWatermark("ts", lateness)
    s = F.session_window("ts", gap)
    return df.groupBy(user, s.alias("s")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
