"""Operator 4: token ids as directly addressable codes.

The ids of a segment are cut into chunk levels of 8 bits. Level 1 holds the
lowest byte of every id. An id that needs more has its continuation bit set
in that level's bitmap, and its next byte stands in level 2 at the place that
the rank of the bit tells; and so on. A rank directory (set bits before each
block of 512) makes any id reachable by a few array reads, without decoding
what is before it.

Segment layout, all integers little-endian: 8 bytes magic ``GLDAC\\0\\1\\0``,
u64 ids n, u64 documents m, u32 levels, u32 zero, m + 1 u64 document starts
inside the segment, then for each level: u64 length, its bytes, its bitmap
(length bits, padded to 8 bytes; bit i at byte i // 8, bit i % 8) and its
rank directory (u32 for each 512 bits). Each part is padded to 8 bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import encoder as E
from gridloom.llm import words as W
from gridloom.llm.common import token_file
from gridloom.runtime import discard, materialize

MAGIC = b"GLDAC\0\1\0"
BLOCK = 512
READ = 1 << 14


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def encode_segment(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """ids (unsigned, below 2**32) and the m + 1 document starts as one segment."""
    rest = ids.astype(np.uint32)
    levels = []
    while len(rest) or not levels:
        more = rest > 0xFF
        levels.append(((rest & 0xFF).astype(np.uint8), more))
        rest = rest[more] >> 8
    out = [MAGIC, np.array([len(ids), len(starts) - 1], "<u8").tobytes(), np.array([len(levels), 0], "<u4").tobytes(), starts.astype("<u8").tobytes()]
    for low, more in levels:
        ranks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        before = np.concatenate(([0], np.cumsum(ranks)[:-1])) if len(ranks) else ranks
        out += [np.array([len(low)], "<u8").tobytes(), _padded(low.tobytes()), _padded(np.packbits(more, bitorder="little").tobytes()), _padded(before.astype("<u4").tobytes())]
    return b"".join(out)


class Segment:
    """A segment's views; nothing is decoded on opening."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a segment of this format")
        self.n, self.documents = (int(x) for x in np.frombuffer(raw, "<u8", 2, 8))
        levels = int(np.frombuffer(raw, "<u4", 1, 24)[0])
        at = 32
        self.starts = np.frombuffer(raw, "<u8", self.documents + 1, at)
        at += 8 * (self.documents + 1)
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(raw, "<u8", 1, at)[0])
            at += 8
            low = np.frombuffer(raw, np.uint8, n, at)
            at += -(-n // 8) * 8
            bitmap = np.frombuffer(raw, np.uint8, -(-n // 8), at)
            at += -(-len(bitmap) // 8) * 8
            ranks = np.frombuffer(raw, "<u4", -(-n // BLOCK), at)
            at += -(-4 * len(ranks) // 8) * 8
            self.levels.append((low, bitmap, ranks))

    def get(self, i: int) -> int:
        """Id i of the segment, read directly."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (low, bitmap, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            bits = np.unpackbits(bitmap[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(ranks[block]) + int(bits.sum())
        return value

    def all(self) -> np.ndarray:
        """All ids of the segment."""
        value = None
        for low, bitmap, _ in reversed(self.levels):
            own = low.astype(np.uint32)
            if value is not None:
                own[np.unpackbits(bitmap, count=len(low), bitorder="little").astype(bool)] |= value << np.uint32(8)
            value = own
        return value

    def document(self, d: int) -> np.ndarray:
        """The ids of document d, by direct access."""
        return self.between(int(self.starts[d]), int(self.starts[d + 1]))

    def between(self, lo: int, hi: int) -> np.ndarray:
        """The ids from lo to hi, by direct access: ranks are taken for this range only."""
        values = np.zeros(hi - lo, np.uint32)
        where = np.arange(hi - lo)
        for k, (low, bitmap, ranks) in enumerate(self.levels):
            if hi <= lo:
                break
            values[where] |= low[lo:hi].astype(np.uint32) << np.uint32(8 * k)
            block = lo // BLOCK
            bits = np.unpackbits(bitmap[block * BLOCK // 8 : (hi + 7) >> 3], bitorder="little")
            skip = lo - block * BLOCK
            own = bits[skip : skip + hi - lo].astype(bool)
            lo = int(ranks[block]) + int(bits[:skip].sum())
            hi = lo + int(own.sum())
            where = where[own]
        return values


SEGMENTS = "part int, segment int, n_tokens long, documents long, doc_ids binary, null_ids binary, codes binary"
SLICE = 4 << 20


def encoded(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """(doc_id, hash of the text, width of an id in bytes, ids) of every row, encoded where the texts are read."""

    def run(batches):
        last = [] if end_id is None else [end_id]
        for b in W.small_batches(batches, most=SLICE, keeps="encoder"):
            ids, edge = E.encode_column(path, b.column(1))
            ids, many = np.insert(ids, edge[1:].repeat(len(last)), last * (len(edge) - 1)), np.diff(edge) + len(last)
            width = 2 if ids.max(initial=0) < 1 << 16 else 4
            raw, cut = ids.astype(f"<u{width}").tobytes(), np.concatenate(([0], np.cumsum(many) * width))
            blobs = pa.Array.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.full(len(many), width, np.int8)), blobs.cast(pa.binary())], ["doc_id", "mark", "width", "ids"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("mark")).mapInArrow(run, "doc_id long, mark long, width byte, ids binary")


def write(docs: DataFrame, path: str | None = None, end_id: int | None = 2, most_tokens: int = 1 << 21) -> DataFrame:
    """Encode docs (doc_id, text) and write their segments, in rising order of doc_id; returns the written table.

    Texts are encoded without a shuffle; only packed ids are dealt out by
    ranges of doc_id. Null doc_ids come first; rows with one doc_id stand in
    the order of a hash of their texts. Null and empty texts have no ids; a
    document without ids still has its end id. A segment is closed when it has
    `most_tokens` ids, so memory is one segment and one Arrow batch; a longer
    document makes a longer segment. Other columns are not read; an empty
    table gives no segment. Files are written by Spark into the shared scratch
    folder, as Parquet: each row is one segment, its bytes in the column codes.
    """
    path = path or token_file("word_bpe_49k.json")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = materialize(encoded(docs, path, end_id), "dac-ids", "zstd")

    def segments(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, sizes, names, number = [], [], [], 0

        def close():
            flat = np.concatenate(held)
            starts = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
            missing = np.array([x is None for x in names], bool)
            known = np.array([x or 0 for x in names], "<i8")
            row = [[part], [number], [len(flat)], [len(names)], [known.tobytes()], [np.packbits(missing).tobytes()], [encode_segment(flat, starts)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], [x.split()[0] for x in SEGMENTS.split(", ")])

        filled = 0
        for b in batches:
            for i, width, raw in zip(*(b.column(c).to_pylist() for c in (0, 2, 3))):
                own = np.frombuffer(raw, f"<u{width}")
                held.append(own)
                names.append(i)
                sizes.append(len(own))
                filled += len(own)
                if filled >= most_tokens:
                    yield close()
                    held, sizes, names, number, filled = [], [], [], number + 1, 0
        if names:
            yield close()

    dealt = ids.repartitionByRange(n, "doc_id", "mark").sortWithinPartitions("doc_id", "mark")
    files = materialize(dealt.mapInArrow(segments, SEGMENTS), "dac", "zstd")
    discard(ids)
    return files


def read_back(files: DataFrame) -> DataFrame:
    """From the segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Documents are read by direct access through the rank directories of
    their segment, neighbouring short ones together. Null doc_ids, documents
    without ids, documents longer than a segment and repeated rows come back
    as they were written; no segment, no rows.
    """
    seg = files.select("part", "segment", "n_tokens")
    parts = seg.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of the writer
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(line), F.lit(0))).drop("n")
    inner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    first = seg.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(parts, "part").select(F.col("part").alias("p"), F.col("segment").alias("s"), (F.col("base") + F.col("inner")).alias("start"))

    def documents(batches):
        for b in batches:
            for part, number, m, doc_ids, nulls, codes in zip(*(b.column(c).to_pylist() for c in ("part", "segment", "documents", "doc_ids", "null_ids", "codes"))):
                seg = Segment(codes)
                cut = seg.starts.astype(np.int64)
                crc, d = [], 0
                while d < m:  # neighbours are read together, up to READ ids or one longer document
                    to = max(d + 1, int(np.searchsorted(cut, cut[d] + READ, side="right")) - 1)
                    own, edge = seg.between(int(cut[d]), int(cut[to])).astype("<u4"), (cut[d : to + 1] - cut[d]).tolist()
                    crc += [zlib.crc32(own[x:y]) for x, y in zip(edge[:-1], edge[1:])]
                    d = to
                missing = np.unpackbits(np.frombuffer(nulls, np.uint8), count=m).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, number, np.int32)), pa.array(np.frombuffer(doc_ids, "<i8"), mask=missing), pa.array(cut[:-1]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], ["part", "segment", "doc_id", "inner", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(documents, "part int, segment int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(first, (F.col("part") == F.col("p")) & (F.col("segment") == F.col("s"))).select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The query's rows: encode, write, read back. Nulls, ties, empty and long texts: see write and read_back."""
    return read_back(write(docs, path))
