"""Operator 5: exact dedup over a log-structured merge index of digests."""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import small_or_shuffled
from gridloom.runtime import materialize

_NONE = np.iinfo(np.int64).min  # stands for a null doc_id in runs
_FAN = 8


def _filter(keys: np.ndarray) -> np.ndarray:
    size = 1 << max(6, int(np.ceil(np.log2(12 * max(1, len(keys))))))
    bits = np.zeros(size, bool)
    for k in range(3):
        bits[(keys >> np.uint64(20 * k)) & np.uint64(size - 1)] = True
    return bits


def _may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for k in range(3):
        hit &= bits[(keys >> np.uint64(20 * k)) & np.uint64(len(bits) - 1)]
    return hit


class Run:
    """A sorted run: digests as four big-endian words, the row that stays, and how many rows there are."""

    def __init__(self, words, ids, rows, counts, bits=None):
        self.words, self.ids, self.rows, self.counts = words, ids, rows, counts
        self.key = words[:, 1].astype(np.uint64) ^ words[:, 0].astype(np.uint64)
        self.bits = _filter(self.key) if bits is None else bits


def _merge(runs: list[Run]) -> Run:
    """One run out of several. What no other run's filter may hold passes; the rest is sorted and folded."""
    alone = []
    for r in runs:
        hit = np.zeros(len(r.key), bool)
        for other in runs:
            if other is not r:
                hit |= _may_hold(other.bits, r.key)
        alone.append(~hit)
    cat = lambda name, pick: np.concatenate([getattr(r, name)[a if pick else ~a] for r, a in zip(runs, alone)])
    w, i, o, c = (cat(name, False) for name in ("words", "ids", "rows", "counts"))
    order = np.lexsort((o, -i.astype(float), w[:, 3], w[:, 2], w[:, 1], w[:, 0])) if len(i) < 2 or np.abs(i[i != _NONE]).max(initial=0) < 1 << 53 else np.array(sorted(range(len(i)), key=lambda k: (w[k].tolist(), -int(i[k]), int(o[k]))))
    w, i, o, c = w[order], i[order], o[order], c[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    sums = np.add.reduceat(c, at) if len(c) else c
    w, i, o = (np.concatenate([x[at], cat(name, True)]) for x, name in ((w, "words"), (i, "ids"), (o, "rows")))
    c = np.concatenate([sums, cat("counts", True)])
    order = np.lexsort((w[:, 3], w[:, 2], w[:, 1], w[:, 0]))
    return Run(w[order], i[order], o[order], c[order])


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d.ljust(32, b"\0") for d in digests), ">u8").reshape(-1, 4)


RUNS = "bucket int, digests binary, ids binary, row_ids binary, counts binary, filter binary"


def _flush(table: dict[bytes, tuple[int, int, int]], buckets: int):
    """A memtable as sorted runs, one for each bucket of leading digest bits."""
    keys = sorted(table)
    words = _words(keys)
    vals = np.array([table[k] for k in keys], np.int64).reshape(-1, 3)
    bucket = ((words[:, 0] >> np.uint64(40)).astype(np.int64) * buckets) >> 24
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    cols: list[list] = [[] for _ in range(6)]
    for b in np.flatnonzero(np.diff(edge)).tolist():
        s = slice(edge[b], edge[b + 1])
        run = Run(words[s], vals[s, 0], vals[s, 1], vals[s, 2])
        for col, x in zip(cols, (b, words[s].tobytes(), vals[s, 0].tobytes(), vals[s, 1].tobytes(), vals[s, 2].tobytes(), np.packbits(run.bits).tobytes())):
            col.append(x)
    kinds = [pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in RUNS.split(", ")])


def index(rows: DataFrame, digest_bytes: int, memtable: int = 50_000, bucket_rows: int = 50_000) -> DataFrame:
    """(digest, keep_id, keep_row, n) of the digests that two or more rows of (doc_id, row_id, sha) share.

    Each task fills memtables of at most `memtable` digests and flushes them
    as sorted runs with filters. Compaction merges the runs of a bucket, eight
    at a time, and keeps the largest doc_id, then the smallest row_id. A group
    of copies is one entry in each memtable, so no bucket holds more than its
    share of distinct digests and one entry for each flush. There is a bucket
    for every `bucket_rows` rows, so buckets do not grow with the input, and
    no more files and tasks with rows than these, however many partitions a
    shuffle has.
    """
    buckets = max(1, -(-rows.count() // bucket_rows))

    def fill(batches):
        table: dict[bytes, tuple[int, int, int]] = {}
        for b in batches:
            for i, r, d in zip(b.column(0).fill_null(_NONE).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                d = d[:digest_bytes]
                if (x := table.get(d)) is None:
                    table[d] = (i, r, 1)
                else:
                    table[d] = (i, r, x[2] + 1) if (i, -r) > (x[0], -x[1]) else (x[0], x[1], x[2] + 1)
                if len(table) >= memtable:
                    yield _flush(table, buckets)
                    table = {}
        if table:
            yield _flush(table, buckets)

    def compact(group: pa.Table) -> pa.Table:
        runs = []
        for d, i, o, c, f in zip(*(group.column(x).to_pylist() for x in ("digests", "ids", "row_ids", "counts", "filter"))):
            runs.append(Run(np.frombuffer(d, ">u8").reshape(-1, 4), *(np.frombuffer(x, np.int64) for x in (i, o, c)), np.unpackbits(np.frombuffer(f, np.uint8)).astype(bool)))
        while len(runs) > 1:
            runs = [_merge(runs[k : k + _FAN]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), _FAN)]
        r = runs[0]
        many = r.counts > 1
        raw = r.words[many].astype(">u8").tobytes()
        ids = r.ids[many]
        return pa.table([pa.array([raw[k : k + digest_bytes] for k in range(0, len(raw), 32)], pa.binary()), pa.array(ids, mask=ids == _NONE), pa.array(r.rows[many]), pa.array(r.counts[many])], ["digest", "keep_id", "keep_row", "n"])

    runs = rows.select("doc_id", "row_id", "sha").mapInArrow(fill, RUNS)
    return runs.groupBy("bucket").applyInArrow(compact, "digest binary, keep_id long, keep_row long, n long")


def _folded(text) -> F.Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextmanager
def _text_batches(spark: SparkSession, size: str = "4m"):
    """While texts go to Python, Arrow batches of this size at most (or of one longer text): each is held in the JVM and the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def collisions(docs: DataFrame, found: DataFrame, digest_bytes: int) -> DataFrame:
    """Digests of the index under which texts of different bytes are found: the byte verification of all hits.

    Flags tell which rows may be hits; there are 16 for each digest of the
    index, 2 ** 28 at most (beyond that more rows are looked at, with the same
    result). A task compares the bytes of each hit with the first text of that
    digest that it met and passes on a length and a second hash of each text,
    which the tasks' findings are compared by, so no text leaves a task.
    """
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, found.count()))), 20, 28))
    place = F.shiftright(F.conv(F.rpad(F.hex(F.substring("digest", 1, 4)), 8, "0"), 16, 10).cast("long"), 32 - bits) + 1
    maps = found.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    flags = np.zeros(1 << bits >> 3, np.uint8)
    for r in maps:
        flags[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(flags.tobytes())

    def hits(batches):
        known = np.frombuffer(shared.value, np.uint8)
        seen: dict[bytes, bytes] = {}
        for b in batches:
            digests = b.column(0).to_pylist()
            at = np.array([int.from_bytes(d[:4].ljust(4, b"\0"), "big") >> (32 - bits) for d in digests], np.int64)
            out = []
            for i in np.flatnonzero((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1).tolist():
                d, text = digests[i], b.column(1)[i].as_py()
                if seen.get(d) != text:  # bytes against bytes
                    seen.setdefault(d, text)
                    out.append((d, len(text), hashlib.blake2b(text, digest_size=16).digest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in ((0, pa.binary()), (1, pa.int64()), (2, pa.binary()))], ["digest", "size", "second"])

    text = _folded(F.col("text"))
    rows = docs.select(F.substring(F.unhex(F.sha2(text, 256)), 1, digest_bytes).alias("digest"), text.cast("binary").alias("text"))
    texts = rows.mapInArrow(hits, "digest binary, size long, second binary").distinct()
    return texts.groupBy("digest").count().where("count > 1").select("digest")


def dedup(docs: DataFrame, digest_bytes: int = 32, memtable: int = 50_000, small: int = 500_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal text (after lower-casing A-Z; null counts as empty),
    the one with the largest doc_id stays; a null doc_id is below all others,
    and of rows with the same doc_id exactly one stays. `digest_bytes` below
    32 makes different texts share digests; byte verification finds these,
    and their rows are grouped by the texts themselves. Very long texts are
    hashed and compared whole. An empty table gives an empty result; other
    columns are not read. An index of at most `small` digests is sent to the
    tasks that hold the rows, a larger one meets them in a shuffle.
    """
    base = docs.select(F.col("doc_id").cast("long"), _folded(F.col("text")).cast("binary").alias("text"))
    rows = materialize(base.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha")).withColumn("row_id", F.monotonically_increasing_id()), "digests")
    found = materialize(index(rows, digest_bytes, memtable), "index")
    with _text_batches(docs.sparkSession):
        bad = materialize(collisions(docs, found, digest_bytes), "collisions")
    rows = rows.withColumn("digest", F.substring("sha", 1, digest_bytes))
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    clean = rows
    if not bad.isEmpty():
        clean = rows.join(bad, "digest", "left_anti")
    joined = clean.join(small_or_shuffled(found, small), "digest", "left")
    result = joined.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), (F.col("n").isNull() | (F.col("row_id") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")).select(*out)
    if bad.isEmpty():
        return result

    again = base.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("digest", F.substring("sha", 1, digest_bytes)).join(bad, "digest", "left_semi")
    again = materialize(again.withColumn("row_id", F.monotonically_increasing_id()), "collided")
    best = again.groupBy("text").agg(F.max(F.struct(F.col("doc_id"), (-F.col("row_id")).alias("r"))).alias("best"), F.count(F.lit(1)).alias("n"))
    more = again.join(best, "text").select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row_id") == -F.col("best.r")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return result.unionByName(more.select(*out))
