"""Operator 3: sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import names_apart, range_ranked
from gridloom.runtime import materialize


def ring_points(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in rising order, shard of each): `virtual` points for each shard."""
    points = sorted((int.from_bytes(hashlib.blake2b(f"shard {s} point {v}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def spread(counts: np.ndarray, owner: np.ndarray, shards: int, slack: float) -> list[list[tuple[int, int]]]:
    """For each arc of the ring, (shard, keys) in the order in which its keys are dealt out.

    Keys first try the shard whose point ends their arc. In each further
    round, the keys that found their shard full try the next other shard
    clockwise. Without slack the bounds are n // shards or one more, so that
    they sum to n and every shard ends full.
    """
    n = int(counts.sum())
    bound = np.full(shards, n // shards, np.int64)
    bound[: n % shards] += 1
    if slack > 0:
        bound[:] = int(np.ceil((1 + slack) * n / shards))
    free, left = bound.copy(), counts.astype(np.int64).copy()
    arcs = len(owner)
    ways = []
    for a in range(arcs):
        ways.append(list(dict.fromkeys(np.roll(owner, -a).tolist())))
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(counts))]
    for r in range(shards):
        for a in np.flatnonzero(left).tolist():
            s = ways[a % arcs][r]
            if take := int(min(left[a], free[s])):
                out[a].append((s, take))
                free[s] -= take
                left[a] -= take
    return out


def assign(docs: DataFrame, shards: int = 24, virtual: int = 64, slack: float = 0.0, key: str = "doc_id") -> DataFrame:
    """docs with shard int and slot long (gapless from 0 in each shard).

    Keys are ranked along the ring by a range partition of their hashes; only
    the number of keys in each arc (shards * virtual of them) and in each
    partition reaches the driver, whatever the input size. A null key hashes
    like any other value. Rows with one key, repeated rows too, are rows of
    their own and may go to neighbouring shards when one is full; they stand
    in the order of a hash of all their columns, so reruns agree and a hot key
    is spread over partitions. Texts are not read here. Columns named shard or slot are replaced. An empty table gives an empty result.
    """
    tokens, owner = ring_points(shards, virtual)
    keep = names_apart(docs, ["shard", "slot"])
    placed = docs.select(*keep, F.xxhash64(key).alias("__pos"), F.xxhash64(*[F.col(f"`{c}`") for c in keep]).alias("__tie"))
    ranked = range_ranked(materialize(placed, "ring"), ["__pos", key, "__tie"], "ring-ranked")

    def arcs(batches):
        for b in batches:
            part = b.column(0).to_numpy()
            arc = np.searchsorted(tokens, b.column(1).to_numpy(zero_copy_only=False))
            both, n = np.unique(part.astype(np.int64) * (len(tokens) + 1) + arc, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both // (len(tokens) + 1)), pa.array(both % (len(tokens) + 1)), pa.array(n.astype(np.int64))], ["part", "arc", "n"])

    found = ranked.select(F.col("__part").cast("long"), "__pos").mapInArrow(arcs, "part long, arc long, n long").groupBy("part", "arc").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(tokens) + 1, np.int64)
    parts: dict[int, int] = {}
    for r in found:
        counts[r["arc"]] += r["n"]
        parts[r["part"]] = parts.get(r["part"], 0) + r["n"]
    before, total = {}, 0
    for p in sorted(parts):
        before[p] = total
        total += parts[p]
    starts, to, slots, filled, rank = [0], [0], [0], [0] * shards, 0
    for dealt in spread(counts, owner, shards, slack):
        for s, n in dealt:
            starts.append(rank)
            to.append(s)
            slots.append(filled[s])
            filled[s] += n
            rank += n
    first, shard_of, slot_of = (np.array(x, np.int64) for x in (starts, to, slots))

    def place(batches):
        for b in batches:
            at = b.column(b.schema.get_field_index("__at")).to_numpy()
            part = b.column(b.schema.get_field_index("__part")).to_numpy()
            rank = at + np.array([before.get(int(p), 0) for p in part], np.int64)
            k = np.searchsorted(first, rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(shard_of[k].astype(np.int32)), pa.array(slot_of[k] + rank - first[k])], [*keep, "shard", "slot"])

    return ranked.mapInArrow(place, docs.select(*keep).schema.add("shard", "integer").add("slot", "long"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The query's rows: law "rows", as the bounds of the loads are counts of documents.

    Null and empty texts have size 8 and checksum 0; very long ones are read
    whole. Rows with one doc_id, or none, are told apart as assign says.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    small = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign(small, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
