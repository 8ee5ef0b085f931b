"""Operator 2: n-gram Jaccard join by a count-vector R-tree.

The shingles of a text hash into groups (ranges of their hash values), and the
counts of the groups are a point. Two uses are made of the groups:

* Routing. If two sets reach the similarity, they differ in at most D
  shingles, D following from their sizes. Cut into more than D groups, they
  agree wholly in some group. So each text is routed by a hash of what each of
  its groups holds; only texts that agree in a group are candidates, and no
  linked pair is lost. Texts with a passage in common may agree in a group by
  chance, and such pairs would chain a growing part of a corpus together. So
  pairs pass a parity sketch before components are made: bit i of a sketch is
  the parity of the shingles that fall to it, so two sketches differ in no
  more bits than the sets in shingles, and no linked pair is lost here either.
* Search. The points of a component of candidates are packed into an R-tree.
  The sum over groups of the smaller of a query's count and a node's largest
  count bounds the overlap with every text below the node; nodes and points
  below the needed overlap are skipped, the others verified on whole sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.common import connected_components, edge_table, free_name, grouped, in_blocks, small_or_shuffled
from gridloom.runtime import materialize

_U = np.uint64
LEAF = 32
PAIRED = 8  # texts that agree in a group: up to so many are taken as pairs
_KEYS, _SURE, _SKETCH, _PAIR, _LIST = range(5)


@lru_cache(maxsize=None)
def _classes(percent: int, upto: int = 1 << 40) -> list[int]:
    """Size classes [b[i], b[i + 1]): partners of a text in class i that are not smaller are in class i or i + 1."""
    b = [1]
    while b[-1] < upto:
        b.append(b[-1] * 100 // percent + 1)
    return b


@lru_cache(maxsize=512)
def _groups(percent: int, i: int):
    """(spare, thresholds between groups, salts of the groups) for pairs of class i with classes i and i + 1."""
    b = _classes(percent)
    small = b[i + 1] - 1
    differ = (100 - percent) * (small + small * 100 // percent) // (100 + percent)
    empty = (differ + 1) * np.exp(-b[i] / (differ + 1)) if differ else 0.0
    spare = int(np.ceil(empty + 3 * np.sqrt(empty))) + 1 if differ else 0
    m = differ + 1 + spare
    cut = np.array([(j << 64) // m for j in range(1, m)], _U) if m > 1 else np.zeros(0, _U)
    return spare, cut, W.mix(np.arange(m, dtype=_U) + (_U(i + 1) << _U(40)))


def routes(s: np.ndarray, percent: int) -> np.ndarray:
    """The routing keys of a sorted set of shingle hashes.

    Groups without shingles agree trivially. There are `spare` more groups
    than needed, so a pair of which one text has no more than `spare` empty
    groups agrees in a group with shingles; a text with more routes by its
    empty groups too.
    """
    n = len(s)
    i = int(np.searchsorted(_classes(percent), n, side="right")) - 1
    total = np.zeros(n + 1, _U)
    np.cumsum(W.mix(s + _U(0x5851F42D4C957F2D)), out=total[1:])
    keys = []
    for c in (i, i - 1):
        if c >= 0:
            spare, cut, salt = _groups(percent, c)
            edge = np.empty(len(cut) + 2, np.int64)
            edge[0], edge[-1] = 0, n
            edge[1:-1] = np.searchsorted(s, cut)
            held = total[edge[1:]] - total[edge[:-1]]
            full = edge[1:] > edge[:-1]
            own = W.mix(held ^ salt)
            keys.append(own if int((~full).sum()) > spare else own[full])
    return np.concatenate(keys)


def needed(a: int, b, percent: int):
    """The least overlap of sets of sizes a and b that reaches the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def sketch_words(n):
    """64-bit words of the sketch of a set of size n: a power of two that gives n to 2 n bits, 64 at least."""
    return 1 << np.maximum(np.frexp(np.asarray(n, float))[1].astype(np.int64) - 6, 0)


def sketch(s: np.ndarray) -> bytes:
    """The parities of the numbers of hashes that fall to each bit; a sketch of half the width is the XOR of both halves."""
    bits = 64 * int(sketch_words(len(s)))
    return np.packbits(np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches (one a row) of fewer words."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def may_link(x: np.ndarray, y: np.ndarray, a, b, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with these sketches (one a row, of one width) can reach the similarity."""
    differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (differ <= a + b - 2 * needed(a, b, percent))


def sketch_pairs(a: np.ndarray, x: list[bytes], b: np.ndarray, y: list[bytes], percent: int) -> np.ndarray:
    """may_link of each pair of rows: sizes a and b, sketches x and y."""
    out = np.zeros(len(a), bool)
    wa, wb = sketch_words(a), sketch_words(b)
    fits = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    for u, v in set(zip(wa[fits].tolist(), wb[fits].tolist())):
        at = np.flatnonzero(fits & (wa == u) & (wb == v))
        one, two = (np.frombuffer(b"".join([z[k] for k in at.tolist()]), _U).reshape(-1, w) for z, w in ((x, u), (y, v)))
        out[at] = may_link(folded(one, min(u, v)), folded(two, min(u, v)), a[at], b[at], percent)
    return out


def sketch_links(ids: list[int], sizes: list[int], sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Pairs (id, another id) that connect all of these texts that may_link connects."""
    order = sorted(range(len(ids)), key=sizes.__getitem__)
    n = np.array([sizes[k] for k in order], np.int64)
    width = sketch_words(n)
    edge = [*np.flatnonzero(np.diff(width, prepend=0)).tolist(), len(n)]
    classes = [(lo, hi, np.frombuffer(b"".join([sketches[order[k]] for k in range(lo, hi)]), _U).reshape(hi - lo, -1)) for lo, hi in zip(edge[:-1], edge[1:])]
    low = np.searchsorted(100 * n, percent * n)
    root, first, out = np.arange(len(n)), np.ones(len(n), bool), []
    for c, (start, end, rows) in enumerate(classes):
        for a in range(start, end):
            own = rows[a - start : a - start + 1]
            # the first member of each tree is tried before all members of the trees that a is not in
            for leaders in (True, False):
                for lo, hi, others in classes[c::-1]:
                    lo_, hi_ = max(lo, int(low[a])), min(hi, a)
                    if lo_ >= hi_:
                        continue
                    pick = lo_ + np.flatnonzero(first[lo_:hi_] if leaders else root[lo_:hi_] != root[a])
                    if not len(pick):
                        continue
                    hits = pick[may_link(folded(own, others.shape[1]), others[pick - lo], n[a], n[pick], percent)]
                    for b in hits[np.unique(root[hits], return_index=True)[1]].tolist():
                        if root[b] != root[a]:
                            gone, kept = max(root[a], root[b]), min(root[a], root[b])
                            root[root == gone], first[gone] = kept, False
                            if ids[order[a]] != ids[order[b]]:
                                out.append((ids[order[a]], ids[order[b]]))
    return out


class CountTree:
    """An R-tree over count vectors, packed in the order of the points (see packing), with coordinate maxima and the sizes' range in each node."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.levels = [(counts, sizes, sizes)]
        while len(self.levels[-1][1]) > LEAF:
            c, low, high = self.levels[-1]
            at = np.arange(0, len(low), LEAF)
            self.levels.append((np.maximum.reduceat(c, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, query: np.ndarray, size: int, percent: int, upto: int) -> np.ndarray:
        """Points before `upto` whose bound reaches the overlap needed with a set of this size."""
        pick = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            pick = pick[pick * LEAF**depth < upto]
            counts, low, high = self.levels[depth]
            pick = pick[(100 * high[pick] >= percent * size) & (percent * low[pick] <= 100 * size)]
            bound = np.minimum(counts[pick], query).sum(axis=1)
            least = np.maximum(low[pick], -(-percent * size // 100))
            pick = pick[bound >= needed(size, least, percent)]
            if depth:
                pick = (pick[:, None] * LEAF + np.arange(LEAF)).ravel()
                pick = pick[pick < len(self.levels[depth - 1][1])]
        return pick


def packing(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An order in which near points are neighbours: tiles by size, inside a tile by a fixed projection of the shares."""
    by_size = np.argsort(sizes, kind="stable")
    tile = np.empty(len(sizes), np.int64)
    tile[by_size] = np.arange(len(sizes)) // (LEAF * LEAF)
    along = (counts / np.maximum(sizes, 1)[:, None]) @ np.cos(np.arange(counts.shape[1]) * 2.399963)
    return np.lexsort((along, tile))


def local_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all of these texts that the similarity connects: (id, another id)."""
    first: dict[bytes, int] = {}
    out, keep = [], []
    for k, (i, s) in enumerate(zip(ids, sets)):
        j = first.setdefault(s.tobytes(), k)
        if j == k:
            keep.append(k)
        elif ids[j] != i:
            out.append((i, ids[j]))
    n = len(keep)
    if n < 2:
        return out
    sizes = np.array([len(sets[k]) for k in keep], np.int64)
    bits = int(np.clip(np.log2(max(1, np.median(sizes)) / 4), 4, 8))
    counts = np.stack([np.bincount((sets[k] >> _U(64 - bits)).astype(np.int64), minlength=1 << bits) for k in keep]).astype(np.int32)
    order = packing(counts, sizes)
    keep, sizes, counts = [keep[k] for k in order.tolist()], sizes[order], counts[order]
    own = [sets[k] for k in keep]
    tree = CountTree(counts, sizes)
    root = np.arange(n)
    for a in range(1, n):
        found = tree.search(counts[a], int(sizes[a]), percent, a)
        for b in found[found < a][::-1].tolist():
            if root[b] != root[a]:
                common = overlap(own[a], own[b])
                if 100 * common >= percent * (int(sizes[a]) + int(sizes[b]) - common):
                    root[root == root[a]] = root[b]
                    out.append((ids[keep[a]], ids[keep[b]]))
    return out


def groups(docs: DataFrame, k: int = 4, percent: int = 85, block: int = 500_000, bucket_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) and split at ASCII white space; a text's set
    holds its distinct k-word shingles, as 64-bit hashes. Texts link when
    100 * intersection >= percent * union; component_id is the smallest doc_id
    reachable. Texts without words (null, empty) have no set and no link.
    Rows with one doc_id are one node. A null doc_id has a null component and
    no links. Other columns are not read; an empty table gives an empty result.

    Very long texts are read whole.

    Memory: a task holds its Arrow batch, one key for each distinct set that
    it met, one bucket of keys (there is one for every `bucket_bytes` of text,
    so buckets do not grow with the input), sketches of `block` words, or a
    block of at most `block` shingles.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes))

    def sets_of(column):
        first, hashes = W.word_hashes(*W.text_buffers(column), lower=True)
        return W.shingle_sets(first, hashes, k)

    def route(batches):
        seen: dict[bytes, int] = {}
        for b in W.small_batches(batches, most=3 << 20):
            keys, owners, many, same, rep, marks = [], [], [], [], [], []
            for i, s in zip(b.column(0).to_pylist(), sets_of(b.column(1))):
                if i is None or not len(s):
                    continue
                mark = np.array([len(s), W.mix(s).sum(dtype=_U), W.mix(s ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U)], _U).tobytes()
                if (j := seen.setdefault(mark, i)) != i:  # this task routes one text of each set
                    same.append(i)
                    rep.append(j)
                    continue
                own = routes(s, percent)
                keys.append(own)
                owners.append(i)
                many.append(len(own))
                marks.append((i, len(s), sketch(s)))
            flat = np.concatenate(keys) if keys else np.zeros(0, _U)
            owner = np.repeat(np.array(owners, np.int64), many)
            bucket = ((flat >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            flat, owner = flat[order], owner[order]
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(x, _KEYS, flat[edge[x] : edge[x + 1]].tobytes(), owner[edge[x] : edge[x + 1]].tobytes()) for x in np.flatnonzero(np.diff(edge)).tolist()]
            if same:
                rows.append((hash(same[0]) % buckets, _SURE, np.array(same, np.int64).tobytes(), np.array(rep, np.int64).tobytes()))
            if marks:
                rows.append((hash(owners[0]) % buckets, _SKETCH, b"".join([x for _, _, x in marks]), np.array([m[:2] for m in marks], np.int64).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int8(), pa.binary(), pa.binary()))], ["bucket", "kind", "keys", "owners"])

    def meet(table: pa.Table) -> pa.Table:
        W.release()
        kinds = table.column("kind").to_pylist()
        keys, owners = table.column("keys").to_pylist(), table.column("owners").to_pylist()
        join = lambda x, w, kind: np.frombuffer(b"".join(v for v, s in zip(x, kinds) if s == w), kind)
        sure = edge_table(join(keys, _SURE, np.int64), join(owners, _SURE, np.int64))
        marks = join(owners, _SKETCH, np.int64).reshape(-1, 2)
        cut = np.concatenate(([0], np.cumsum(8 * sketch_words(marks[:, 1])))).astype(np.int64)
        raw = b"".join(v for v, s in zip(keys, kinds) if s == _SKETCH)
        blobs = pa.Array.from_buffers(pa.large_binary(), len(marks), [None, pa.py_buffer(cut), pa.py_buffer(raw)]).cast(pa.binary())
        key, owner = join(keys, _KEYS, _U), join(owners, _KEYS, np.int64)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[new], owner[new]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        many = np.diff(start, append=len(key))
        size = np.repeat(many, many)
        ends = []  # small groups as pairs
        for d in range(1, PAIRED):
            at = np.flatnonzero((size[d:] <= PAIRED) & (key[d:] == key[: len(key) - d]) if len(key) > d else np.zeros(0, bool))
            ends.append((owner[at], owner[at + d]))
        pairs = edge_table(*(np.concatenate(x) for x in zip(*ends)))
        # larger ones as lists; equal ones once
        name = W.mix(np.add.reduceat(W.mix(owner.astype(_U)), start) + many.astype(_U)) if len(start) else np.zeros(0, _U)
        wide = np.flatnonzero(many > PAIRED)
        wide = wide[np.unique(name[wide], return_index=True)[1]]
        listed = np.zeros(len(start), bool)
        listed[wide] = True
        inside = np.repeat(listed, many)
        lists = (np.repeat(name, many)[inside].view(np.int64), owner[inside])
        none = lambda n: pa.nulls(n, pa.binary())
        parts = [
            (_SURE, sure.column(0), sure.column(1), none(len(sure))),
            (_PAIR, pairs.column(0), pairs.column(1), none(len(pairs))),
            (_LIST, pa.array(lists[0]), pa.array(lists[1]), none(len(lists[0]))),
            (_SKETCH, pa.array(marks[:, 0]), pa.array(marks[:, 1]), blobs),
        ]
        return pa.concat_tables([pa.table([pa.array(np.full(len(u), kind, np.int8)), u, v, x], ["kind", "u", "v", "sketch"]) for kind, u, v, x in parts])

    def pass_pairs(batches):
        for b in batches:
            u, v, a, c = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2, 4))
            good = sketch_pairs(a, b.column(3).to_pylist(), c, b.column(5).to_pylist(), percent)
            if good.any():
                yield edge_table(u[good], v[good])

    def pass_lists(batches):
        for group in grouped(batches, ["list", "__i", "__j", "node", "n", "sketch"]):
            links = sketch_links([r[3] for r in group], [r[4] for r in group], [r[5] for r in group], percent)
            if links:
                yield edge_table(*np.array(links, np.int64).T)
        W.release()

    routed = base.mapInArrow(route, "bucket int, kind byte, keys binary, owners binary")
    met = materialize(routed.groupBy("bucket").applyInArrow(meet, "kind byte, u long, v long, sketch binary"), "routes")
    edges = met.where(F.col("kind") == _SURE).select("u", "v")
    marks = met.where(F.col("kind") == _SKETCH).select(F.col("u").alias("node"), F.col("v").alias("n"), "sketch").distinct()
    pairs = met.where(F.col("kind") == _PAIR).select("u", "v").distinct()
    for end in ("u", "v"):
        pairs = pairs.join(marks.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")), end)
    pairs = pairs.select("u", "v", "n_u", "s_u", "n_v", "s_v").mapInArrow(pass_pairs, "u long, v long")
    lists = met.where(F.col("kind") == _LIST).select(F.col("u").alias("list"), F.col("v").alias("node")).distinct().join(marks, "node")
    lists = in_blocks(lists.withColumn("words", F.octet_length("sketch") / 8), "list", "node", "words", block).mapInArrow(pass_lists, "u long, v long")
    candidates = materialize(connected_components(pairs.unionByName(lists)).select(F.col("node").alias("__node"), F.col("component").alias("comp")), "candidates")

    def fetch(batches):
        for b in W.small_batches(batches, most=3 << 20):
            n, blobs = [], []
            for comp, s in zip(b.column(2).to_pylist(), sets_of(b.column(1))):
                n.append(len(s))
                blobs.append(s.tobytes() if comp is not None and len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2), pa.array(blobs, pa.binary())], ["doc_id", "n", "comp", "shingles"])

    with_comp = base.join(small_or_shuffled(candidates), F.col("doc_id") == F.col("__node"), "left").select("doc_id", "text", "comp")
    rows = materialize(with_comp.mapInArrow(fetch, "doc_id long, n long, comp long, shingles binary"), "sets")

    def verify(batches):
        for group in grouped(batches, ["comp", "__i", "__j", "doc_id", "shingles"]):
            links = local_links([r[3] for r in group], [np.frombuffer(r[4], _U) for r in group], percent)
            if links:
                u, v = np.array(links, np.int64).T
                yield edge_table(u, v)
        W.release()

    members = rows.where("shingles IS NOT NULL").select("comp", "doc_id", "n", "shingles")
    links = in_blocks(members, "comp", "doc_id", "n", block).mapInArrow(verify, "u long, v long")
    found = connected_components(links.unionByName(edges))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(found.select(F.col("node").alias("__n"), "component"), F.col("doc_id") == F.col("__n"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 4_000_000) -> DataFrame:
    """docs without the texts that link to one with a smaller doc_id in their group; columns unchanged.

    Rows without doc_id, text or words stay, as do rows that share the doc_id
    that stays; long texts are compared whole. An empty table gives an empty
    result. A block holds 32 MB of hashes: smaller ones copy the rows of a large
    candidate component too often.
    """
    name = free_name(docs, "__gone")
    gone = materialize(groups(docs, k, percent, block).where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    return docs.join(small_or_shuffled(gone), docs["doc_id"].cast("long") == F.col(name), "left_anti")
