"""Operator 1: line dedup by an exact set-similarity join.

A line's set holds its distinct words (A-Z lower-cased, split at ASCII white
space). Words are ordered by rarity; two sets that reach the similarity share
a word of their prefixes, so lines meet at the words of their prefixes, where
length, positional and parity filters drop pairs. What passes is verified on
the words themselves, pair by pair. A line goes if a line at an earlier
position reaches the similarity, whether that one stays or not.

A position is (doc_id, hash of doc_id and text, line number), null ids first.

Bounds on hot groups:

* A line needs one earlier match only. Of the earlier lines that pass the
  filters at a word, the nearest few are taken, so pairs grow with the lines
  and not with the square of a group. Lines none of whose pairs is confirmed
  while others were left out go through a second round that takes them all;
  it looks only at lines with a word that these have in their prefixes.
* Words with more than `hot` occurrences do not make groups on their own.
  Prefixes that are longer by one word share two words, so lines meet at pairs
  of hot words instead.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.common import free_name, names_apart, small_or_shuffled
from gridloom.runtime import discard, materialize

_U = np.uint64
_NONE = np.iinfo(np.int64).min
TOKEN_BITS = 44
_SLOT_BITS = 24
_RANGES = 64
_LONG = 100  # sets with more words carry 256 bits of parity, others 64
_PIECE = 1 << 12  # lines: 12 bits of line, 8 of rank and 44 of token make 64
_FULL = 65_535
SLICE = 1 << 20


def rank_of(count) -> np.ndarray:
    """The rank of a word by its count: 0, 1 (it occurs once), then by logarithm."""
    count = np.asarray(count, float)
    return np.where(count > 1, 2 + np.minimum(253, np.floor(4 * np.log2(np.maximum(count, 1)))), count).astype(np.uint8)


def rarity(base: DataFrame) -> tuple[np.ndarray, int]:
    """(a rank for each of 2**24 slots of words, number of words), from all words of the column text.

    The table has that size for every input; where words share a slot the
    order is only less sharp. Counts above 1 may be off by a few per cent.
    """

    def count(batches):
        total = np.zeros(1 << _SLOT_BITS, np.uint16)  # a task's counts end at 65,535
        words = 0
        for b in W.small_batches(batches, 0, SLICE):
            _, hashes = W.word_hashes(*W.text_buffers(b.column(0)), lower=True)
            words += len(hashes)
            slots, n = np.unique((hashes >> _U(64 - _SLOT_BITS)).astype(np.uint32), return_counts=True)
            total[slots] = np.minimum(total[slots].astype(np.int64) + n, 65_535)
        levels = np.zeros(1 << 16, np.uint8)
        levels[1:] = 1 + np.round(8 * np.log2(np.arange(1, 1 << 16)))
        for r, part in enumerate(np.split(total, _RANGES)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([words], pa.int64()), pa.array([zlib.compress(levels[part].tobytes(), 1)], pa.binary())], ["r", "words", "levels"])
                words = 0

    def ranks(table: pa.Table) -> pa.Table:
        worth = np.concatenate(([0.0], 2.0 ** (np.arange(255) / 8)))
        total = np.zeros((1 << _SLOT_BITS) // _RANGES)
        for blob in table.column("levels"):
            total += worth[np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)]
        return pa.table([table.column("r").slice(0, 1), pa.array([sum(table.column("words").to_pylist())], pa.int64()), pa.array([rank_of(total).tobytes()], pa.binary())], ["r", "words", "ranks"])

    found = base.select("text").mapInArrow(count, "r int, words long, levels binary").groupBy("r").applyInArrow(ranks, "r int, words long, ranks binary").collect()
    table = np.zeros(1 << _SLOT_BITS, np.uint8)
    width = len(table) // _RANGES
    for row in found:
        table[row["r"] * width : (row["r"] + 1) * width] = np.frombuffer(bytes(row["ranks"]), np.uint8)
    return table, sum(row["words"] for row in found)


class Lines:
    """The word sets of the lines of a batch of texts, of lines with a word; words stand in order of rarity."""

    def __init__(self, column: pa.Array, ranks: np.ndarray, only: np.ndarray | None = None):
        """With `only` (a flag for each slot of words), lines without a word of a flagged slot are passed over."""
        data, offs = W.text_buffers(column)
        first, hashes, starts, _ = W.word_hashes(data, offs, lower=True, spans=True)
        breaks = np.flatnonzero(data == 10)
        text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        line = np.searchsorted(breaks, starts) + text  # rises by one at each line feed and each new text
        if only is not None:
            hit = np.zeros(len(breaks) + len(offs), bool)
            hit[line[only[hashes >> _U(64 - _SLOT_BITS)]]] = True
            hashes, line = hashes[hit[line]], line[hit[line]]
        parts, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        done = 0
        while done < len(line):
            to = int(np.searchsorted(line, line[done] + _PIECE))
            token = hashes[done:to] >> _U(64 - TOKEN_BITS)
            rank = ranks[token >> _U(TOKEN_BITS - _SLOT_BITS)].astype(_U)
            all_ = ((line[done:to] - line[done]).astype(_U) << _U(52)) | (rank << _U(TOKEN_BITS)) | token
            all_.sort()
            new = np.ones(len(all_), bool)
            new[1:] = all_[1:] != all_[:-1]
            all_ = all_[new]
            parts.append(all_)
            owners.append((all_ >> _U(52)).astype(np.int64) + line[done])
            done = to
        both, owner = np.concatenate(parts), np.concatenate(owners)
        self.token = both & _U((1 << TOKEN_BITS) - 1)
        self.rank = ((both >> _U(TOKEN_BITS)) & _U(255)).astype(np.uint8)
        new = np.ones(len(owner), bool)
        new[1:] = owner[1:] != owner[:-1]
        self.start = np.append(np.flatnonzero(new), len(owner))
        self.size = np.diff(self.start)
        at = owner[new]
        head = np.searchsorted(breaks, offs[:-1]) + np.arange(len(offs) - 1)  # index of each text's first line
        self.text = np.searchsorted(head, at, side="right") - 1
        self.number = at - head[self.text] if len(at) else at
        if len(at):
            heads = self.start[:-1]
            bit, word = _U(1) << (self.token & _U(63)), (self.token >> _U(6)) & _U(3)
            self.parity = np.bitwise_xor.reduceat(bit, heads)
            self.wide = np.stack([np.bitwise_xor.reduceat(np.where(word == w, bit, _U(0)), heads) for w in (1, 2, 3)], axis=1)
            self.key = W.mix(np.add.reduceat(W.mix(self.token + _U(0x632BE59BD9B4E019)), heads) + self.size.astype(_U))
        else:
            self.parity = self.key = np.zeros(0, _U)
            self.wide = np.zeros((0, 3), _U)


_ENTRY = np.dtype([("key", "<u4"), ("size", "<u2"), ("place", "<u2"), ("parity", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("line", "<i4")])
_SPOT = np.dtype([("doc", "<i8"), ("rid", "<i8"), ("line", "<i4")])
_ASKED = 1 << 15


def _planes(rows: np.ndarray) -> bytes:
    """Entries as byte planes: what is zero in all of them stands together, and the shuffle's codec takes it out."""
    return rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes()


def _rows(planes: bytes) -> bytes:
    return np.frombuffer(planes, np.uint8).reshape(_ENTRY.itemsize, -1).T.tobytes()


def _prefix(size, percent: int):
    return size - (-(-percent * size // 100)) + 1


def keys_of(lines: Lines, pick: np.ndarray, percent: int, hot_rank: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, 64-bit key) of all keys of the picked lines; with `only`, of keys at words of flagged slots.

    A word that no other line holds is left out, as nothing can meet there.
    Sets too small to be near another one meet equal ones only, by the set.
    """
    size, start = lines.size[pick], lines.start[:-1][pick]
    least = -(-percent // max(1, 100 - percent))  # a set of n words nears another at n / (n + 1) at best
    short = np.flatnonzero((size < least) & (lines.rank[start] > 1)) if len(pick) else np.zeros(0, np.int64)
    long_ = np.flatnonzero(size >= least)
    many = np.minimum(_prefix(size[long_], percent) + 1, size[long_])
    owner = np.repeat(long_, many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at = start[owner] + place
    rank, token = lines.rank[at], lines.token[at]
    own = (rank > 1) & (rank < hot_rank) & (place < _prefix(size[owner], percent))
    hot = rank >= hot_rank  # the last ones of their prefix
    if only is not None:
        asked = only[token >> _U(TOKEN_BITS - _SLOT_BITS)]
        own, hot = own & asked, hot & asked
    hot = np.flatnonzero(hot)
    who, where, keys = [short, owner[own]], [np.zeros(len(short), np.int64), place[own]], [W.mix(lines.key[pick][short] ^ _U(0x9E6C63D0876A9A47)), W.mix(token[own])]
    for step in range(1, int(np.bincount(owner[hot]).max(initial=0)) if len(hot) else 0):
        first, second = hot[:-step], hot[step:]
        same = owner[first] == owner[second]
        first, second = first[same], second[same]
        who.append(owner[first])
        where.append(place[first])
        keys.append(W.mix(W.mix(token[first]) + token[second]))
    return np.concatenate(who), np.concatenate(where), np.concatenate(keys)


def _likely(bits: int, upto: int = 1 << 12) -> np.ndarray:
    """The parity distance to expect of sets that differ in 0, 1, 2, ... words."""
    return np.ceil(bits / 2 * (1 - np.exp(-2 * np.arange(upto) / bits))).astype(np.int32)


_LIKELY, _LIKELY_WIDE = _likely(64), _likely(256)


def _fits(e: dict, x: np.ndarray, y: np.ndarray, percent: int):
    """(which pairs of entries of one key pass the length, positional and parity filters, their parity distance, whether that speaks for a match)."""
    a, b = e["size"][x], e["size"][y]
    need = -(-percent * (a + b) // (100 + percent))
    most = a + b - 2 * need
    differ = np.bitwise_count(e["parity"][x] ^ e["parity"][y]).astype(np.int32)
    fit = (differ <= most) & (need <= np.minimum(a - e["place"][x], b - e["place"][y]))
    fit |= np.maximum(a, b) == _FULL
    at = np.flatnonzero(fit)
    x, y, differ, most = x[at], y[at], differ[at], most[at]
    long_ = np.flatnonzero((a[at] > _LONG) & (b[at] > _LONG))
    likely = differ <= _LIKELY[np.minimum(most, len(_LIKELY) - 1)]
    if len(long_):
        u, v = e["at_wide"][x[long_]], e["at_wide"][y[long_]]
        d = e["wide"][u] ^ e["wide"][v]
        rest = e["parity"][x[long_]] ^ e["parity"][y[long_]] ^ d[:, 0] ^ d[:, 1] ^ d[:, 2]
        differ[long_] = np.bitwise_count(d).sum(axis=1, dtype=np.int32) + np.bitwise_count(rest)
        likely[long_] = differ[long_] <= _LIKELY_WIDE[np.minimum(most[long_], len(_LIKELY_WIDE) - 1)]
    full = np.maximum(a[at], b[at]) == _FULL
    keep = np.flatnonzero(((differ <= most) | full) & ((e["doc"][x] != e["doc"][y]) | (e["rid"][x] != e["rid"][y]) | (e["line"][x] != e["line"][y])))
    return at[keep], differ[keep], (likely | full)[keep]


def _allowed(size: np.ndarray, percent: int) -> np.ndarray:
    """For each size a share of the parity distance that _fits allows: those of two sets add up to as much or more, or to all of 64 bits."""
    return np.where(size == _FULL, 64, np.minimum(size.astype(np.int64) * (100 - percent) // (100 + percent) + 1, 64)).astype(np.uint8)


def _runs(same: np.ndarray) -> np.ndarray:
    """Which rows are equal to the one before or after; same: which are equal to the one before, without the first."""
    out = np.zeros(len(same) + 1, bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _by_place(entries: np.ndarray) -> np.ndarray:
    """Row numbers of the entries whose key another one has, by key, doc, rid, line and place."""
    if not len(entries):
        return np.zeros(0, np.int64)
    doc = entries["doc"]
    known = doc[doc != _NONE]
    low = int(known.min()) - 1 if len(known) else 0
    if len(known) and int(known.max()) - low >= 1 << 32:
        order = np.argsort(entries["key"])
        order = order[_runs(np.diff(entries["key"][order]) == 0)]
        return order[np.lexsort([entries[c][order] for c in ("place", "line", "rid", "doc", "key")])]
    both = (entries["key"].astype(_U) << _U(32)) | np.where(doc != _NONE, doc - low, 0).astype(_U)
    order = np.argsort(both)
    both = both[order]
    many = _runs((both[1:] >> _U(32)) == (both[:-1] >> _U(32)))
    order, both = order[many], both[many]
    tied = np.flatnonzero(_runs(both[1:] == both[:-1])) if len(both) else np.zeros(0, np.int64)
    own = order[tied]
    order[tied] = own[np.lexsort([entries[c][own] for c in ("place", "line", "rid")] + [both[tied]])]
    return order


def candidates(entries: np.ndarray, wide: np.ndarray, percent: int, most: int | None, best: int, small: int = 64):
    """(later line, earlier line, whether others were left out) as row numbers of entries.

    wide: the further parity words of the entries with more than 100 words,
    in order. For each line and key, of the earlier lines that pass the
    filters: where the parity of some speaks for a match, the `best` nearest
    of them; else the `most` nearest. Groups above `small` are looked through
    from the earliest line on until a line has found enough. With most None
    all are taken, for entries marked as asked only.
    """
    order = _by_place(entries)
    e: dict = {c: np.ascontiguousarray(entries[c][order]) for c in _ENTRY.names}
    if len(order):  # rows that are equal in doc_id and text come from several tasks
        again = np.ones(len(order), bool)
        again[0] = False
        for c in ("key", "doc", "rid", "line", "place"):
            again[1:] &= e[c][1:] == e[c][:-1]
        order, e = order[~again], {c: v[~again] for c, v in e.items()}
    asked = (e["place"] & _ASKED) > 0
    e["place"] = (e["place"] & ~np.uint16(_ASKED)).astype(np.int32)
    e["wide"], e["at_wide"] = wide, (np.cumsum(entries["size"] > _LONG) - 1)[order]
    e["size"] = e["size"].astype(np.int32)
    n = len(order)
    start = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(start, n))
    end = np.repeat(start + size, size)
    xs, ys, ds, ls = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
    stopped = np.zeros(n, bool)
    parity, allowed = e["parity"], _allowed(e["size"], percent)

    def add(x, y):
        at, d, likely = _fits(e, x, y, percent)
        xs.append(x[at])
        ys.append(y[at])
        ds.append(d)
        ls.append(likely)
        return x[at], likely

    y = np.flatnonzero(np.repeat(size <= small, size))
    for step in range(1, small):
        y = y[y + step < end[y]]
        if not len(y):
            break
        use = y if most is not None else y[asked[y + step]]
        use = use[np.bitwise_count(parity[use] ^ parity[use + step]) <= allowed[use] + allowed[use + step]]
        add(use + step, use)
    for s, m in zip(start[size > small].tolist(), size[size > small].tolist()):
        for a in range(s, s + m, 256):
            x = np.arange(a, min(a + 256, s + m))
            x = x if most is not None else x[asked[x]]
            found, good = np.zeros(n if not len(x) else 256, np.int64), np.zeros(256, np.int64)
            lo, width = s, 64
            while len(x) and lo < x[-1]:
                if most is not None:
                    enough = (found[x - a] > 8 * most) | (good[x - a] >= 4 * best)
                    stopped[x[enough]] = True
                    x = x[~enough]
                    if not len(x):
                        break
                y2 = np.arange(lo, min(lo + width, int(x[-1])))
                u, v = np.nonzero(np.bitwise_count(parity[x][:, None] ^ parity[y2]) <= allowed[x][:, None] + allowed[y2])
                u, v = x[u], y2[v]
                before = v < u
                hit, likely = add(u[before], v[before])
                found += np.bincount(hit - a, minlength=256)
                good += np.bincount(hit[likely] - a, minlength=256)
                lo, width = lo + width, min(1024, width * 4)
    x, y, d, likely = np.concatenate(xs), np.concatenate(ys), np.concatenate(ds), np.concatenate(ls)
    more = np.zeros(len(x), bool)
    if most is not None and len(x):
        by = np.lexsort((y, d, ~likely, x))
        x, y, likely = x[by], y[by], likely[by]
        head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        count = np.diff(np.append(head, len(x)))
        place = np.arange(len(x)) - np.repeat(head, count)
        take = np.repeat(np.where(likely[head], best, most), count)
        more = (np.repeat(count, count) > take) | stopped[x]
        keep = place < take
        x, y, more = x[keep], y[keep], more[keep]
    return order[x], order[y], more


_MET = "xdoc long, xrid long, xline int, ydoc long, yrid long, yline int, more boolean"


def _based(docs: DataFrame) -> DataFrame:
    """doc (null: the least long), rid and text of docs; rows equal in doc_id and text have one rid."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(doc, F.lit(_NONE)).alias("doc"), F.xxhash64(doc, text).alias("rid"), text.alias("text"))


def _bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """2**bits flags, packed, set at the values of the column p; of this size whatever the input."""
    p = F.col("p") + 1
    found = places.groupBy(F.bitmap_bucket_number(p).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("m")).collect()
    out = np.zeros(max(4096, 1 << bits >> 3), np.uint8)
    for r in found:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def _asked_lines(b: pa.RecordBatch, lines: Lines) -> np.ndarray:
    """Which lines of a batch (its fourth column lists line numbers) are asked for."""
    asked = np.zeros(len(lines.key), bool)
    for t, numbers in enumerate(b.column(3).to_pylist()):
        if numbers:
            lo, hi = np.searchsorted(lines.text, [t, t + 1])
            asked[lo:hi] = np.isin(lines.number[lo:hi], numbers)
    return asked


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def later_matches(docs: DataFrame, percent: int = 80, most: int = 8, best: int = 1, hot: int = 100_000, bucket_words: int = 2_000_000) -> DataFrame:
    """(doc, rid, gone): the sorted line numbers (from 0) that go, for each row of docs that loses lines.

    doc is doc_id (null: the least long), rid the hash of doc_id and text.
    Lines without a word never match. Rows that are equal in doc_id and text
    are one document: they lose the same lines, and equal lines at their equal
    numbers do not remove each other. Other rows with one doc_id, or without
    one, stand in the order of their rid. An empty table gives an empty result.

    most, best: see candidates. hot: a word with more occurrences makes no
    group alone. bucket_words: words of the corpus for each bucket of entries,
    so that their number follows the corpus; a quarter of the words or less
    become entries of 36 bytes (60 in lines of over 100 words). Memory: a
    task's rank table (16 MB) and flags (32 MB at most), its slice of text,
    the line sets that it met, or one bucket.
    """
    if not 50 < percent <= 100 or best < 1:
        raise ValueError("percent has to be over 50 and up to 100, best 1 or more")
    spark = docs.sparkSession
    base = _based(docs)
    ranks, words = rarity(base)
    table = spark.sparkContext.broadcast(ranks.tobytes())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // bucket_words))
    hot_rank = int(rank_of(hot)) + 1
    spot = ["doc", "rid", "line"]

    def met(source: DataFrame, limit: int | None, flags=None) -> DataFrame:
        """Lines that a task itself found earlier copies of (without y), and candidate pairs; without a limit, of the asked lines of source alone."""

        def entries(batches):
            own = np.frombuffer(table.value, np.uint8)
            only = None if flags is None else np.unpackbits(np.frombuffer(flags.value, np.uint8), bitorder="little").view(bool)
            seen: dict[int, tuple[int, int, int]] = {}
            for b in W.small_batches(batches, 2, SLICE):
                lines = Lines(b.column(2), own, only)
                doc, rid = (np.asarray(b.column(c))[lines.text] for c in (0, 1))
                line = lines.number
                order = np.lexsort((line, rid, doc, lines.key))
                key = lines.key[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                lead = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else order
                later = (doc[order] != doc[lead]) | (rid[order] != rid[lead]) | (line[order] != line[lead])
                firsts = order[new]
                pick, known = [], []
                for i, k, *at in zip(firsts.tolist(), lines.key[firsts].tolist(), doc[firsts].tolist(), rid[firsts].tolist(), line[firsts].tolist()):
                    old = seen.get(k)
                    if old is None or tuple(at) < old:
                        seen[k] = tuple(at)
                        pick.append(i)
                    elif tuple(at) > old:
                        known.append(i)
                gone, pick = np.concatenate((order[later], np.array(known, np.int64))), np.array(pick, np.int64)
                who, place, keys = keys_of(lines, pick, percent, hot_rank, only)
                who = pick[who] if len(pick) else who
                if limit is None:
                    asked = _asked_lines(b, lines)
                    gone, place = gone[asked[gone]], place | np.where(asked[who], _ASKED, 0)
                bucket = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                sort = np.argsort(bucket, kind="stable")
                who, place, keys, bucket = who[sort], place[sort], keys[sort], bucket[sort]
                e, size = np.zeros(len(who), _ENTRY), lines.size[who]
                e["key"], e["size"], e["place"], e["parity"] = keys & _U(0xFFFFFFFF), np.where(size < _ASKED, size, _FULL), np.where(size < _ASKED, place, place & _ASKED), lines.parity[who]
                for c, x in zip(spot, (doc, rid, line)):
                    e[c] = x[who]
                wide, before = lines.wide[who[size > _LONG]], np.concatenate(([0], np.cumsum(size > _LONG)))
                g = np.zeros(len(gone), _SPOT)
                for c, x in zip(spot, (doc, rid, line)):
                    g[c] = x[gone]
                edge = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = [(x, _planes(e[edge[x] : edge[x + 1]]), wide[before[edge[x]] : before[edge[x + 1]]].tobytes(), b"") for x in np.flatnonzero(np.diff(edge)).tolist()]
                if len(g):
                    rows.append((int(g["rid"][0]) % buckets, b"", b"", g.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "entries", "wide", "gone"])

        def join(group: pa.Table) -> pa.Table:
            e = b"".join(_rows(x.as_py()) for x in group.column("entries"))
            w, g = (b"".join(x.as_py() for x in group.column(c)) for c in ("wide", "gone"))
            e, w, g = np.frombuffer(e, _ENTRY), np.frombuffer(w, _U).reshape(-1, 3), np.frombuffer(g, _SPOT)
            x, y, more = candidates(e, w, percent, limit, best)
            ex, ey = e[x], e[y]
            none = pa.nulls(len(g), pa.int64())
            whole = [pa.concat_arrays([pa.array(g[c]), pa.array(ex[c])]) for c in spot]
            whole += [pa.concat_arrays([none.cast(t), pa.array(ey[c])]) for c, t in zip(spot, (pa.int64(), pa.int64(), pa.int32()))]
            whole.append(pa.concat_arrays([pa.array(np.zeros(len(g), bool)), pa.array(more)]))
            W.release()
            return pa.table(whole, [c.split()[0] for c in _MET.split(", ")])

        found = source.mapInArrow(entries, "bucket int, entries binary, wide binary, gone binary").groupBy("bucket").applyInArrow(join, _MET)
        return materialize(found.groupBy("xdoc", "xrid", "xline", "ydoc", "yrid", "yline").agg(F.max("more").alias("more")), "line-pairs")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """(doc, rid, line) of the later lines of pairs whose words reach the similarity."""
        goal = F.xxhash64("ydoc", "yrid", "yline").alias("goal")
        later = pairs.select(F.col("xdoc").alias("doc"), F.col("xrid").alias("rid"), F.col("xline").alias("line"), goal, F.lit(False).alias("lead"))
        early = pairs.select(F.col("ydoc").alias("doc"), F.col("yrid").alias("rid"), F.col("yline").alias("line"), goal, F.lit(True).alias("lead")).distinct()
        wanted = materialize(later.unionByName(early), "wanted-lines")
        bits = int(np.clip(np.ceil(np.log2(16 * max(1, wanted.count()))), 20, 28))
        low = F.lit((1 << bits) - 1)
        flags = spark.sparkContext.broadcast(_bitmap(wanted.select(F.shiftrightunsigned("rid", 64 - bits).bitwiseXOR(F.col("line").cast("long").bitwiseAND(low)).alias("p")), bits).tobytes())

        def lines_of(batches):
            maybe = np.frombuffer(flags.value, np.uint8)
            seen: set[tuple[int, int]] = set()
            for b in W.small_batches(batches, 2, SLICE):
                data, offs = W.text_buffers(b.column(2))
                breaks = np.flatnonzero(data == 10)
                cut = np.searchsorted(breaks, offs)
                text = np.repeat(np.arange(len(offs) - 1), 1 + np.diff(cut))
                head = cut[:-1] + np.arange(len(offs) - 1)  # index of each text's first line
                number = np.arange(len(text)) - head[text]
                starts, ends = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
                inner = number > 0
                starts[head], starts[inner] = offs[:-1], breaks + 1
                ends[head + np.diff(cut)], ends[np.flatnonzero(inner) - 1] = offs[1:], breaks
                rid = np.asarray(b.column(1))
                at = (rid.view(_U) >> _U(64 - bits)).astype(np.int64)[text] ^ (number & ((1 << bits) - 1))
                hit = np.flatnonzero((maybe[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                raw, out = data.tobytes(), []
                for i, r, k, s, z in zip(text[hit].tolist(), rid[text[hit]].tolist(), number[hit].tolist(), starts[hit].tolist(), ends[hit].tolist()):
                    if (r, k) not in seen:
                        seen.add((r, k))
                        own = dict.fromkeys(raw[s:z].translate(_LOWER).split())
                        out.append((i, r, k, len(own), b" ".join(own)))
                cols = list(zip(*out)) or [()] * 5
                doc = b.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(x, t) for x, t in zip(cols[1:], (pa.int64(), pa.int32(), pa.int32(), pa.binary())))], ["doc", "rid", "line", "n", "words"])

        lines = base.mapInArrow(lines_of, "doc long, rid long, line int, n int, words binary").groupBy("rid", "doc", "line").agg(F.first("n").alias("n"), F.first(F.col("words").cast("string")).alias("words"))
        known = materialize(wanted.join(lines, ["rid", "doc", "line"]).select("goal", "lead", *spot, "n", "words"), "asked-lines")
        x = known.where("NOT lead").select("goal", *spot, F.col("n").alias("a"), F.col("words").alias("x"))
        y = known.where("lead").select(F.col("goal").alias("g"), F.col("n").alias("b"), F.col("words").alias("y"))
        common = F.size(F.array_intersect(F.split("x", " "), F.split("y", " ")))
        near = x.join(y, F.col("goal") == F.col("g")).where((100 + percent) * common >= percent * (F.col("a") + F.col("b")))
        out = materialize(near.select(*spot), "matched-lines")
        discard(wanted, known)
        return out

    def prefix_words(asking: DataFrame) -> np.ndarray:
        """Flags for the slots of the prefix words of asked lines."""

        def slots(batches):
            own = np.frombuffer(table.value, np.uint8)
            for b in W.small_batches(batches, 2, SLICE):
                lines = Lines(b.column(2), own)
                pick = np.flatnonzero(_asked_lines(b, lines))
                many = np.minimum(_prefix(lines.size[pick], percent) + 1, lines.size[pick])
                at = np.repeat(lines.start[pick] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(lines.token[at] >> _U(TOKEN_BITS - _SLOT_BITS)).astype(np.int64))], ["p"])

        return _bitmap(asking.where("asked IS NOT NULL").mapInArrow(slots, "p long"), _SLOT_BITS)

    first = met(base, most)
    pairs = first.where("yrid IS NOT NULL")
    found = confirmed(pairs)
    x = [F.col(f"x{c}").alias(c) for c in spot]
    later = first.where("yrid IS NULL").select(*x).unionByName(found)
    open_ = pairs.where("more").select(*x).distinct().join(found, spot, "left_anti")
    open_ = materialize(open_.groupBy("doc", "rid").agg(F.collect_list("line").alias("asked")), "open-lines")
    done = [first, found, open_]
    if not open_.isEmpty():
        asking = base.join(small_or_shuffled(open_, 100_000), ["doc", "rid"], "left").select("doc", "rid", "text", "asked")
        second = met(asking, None, spark.sparkContext.broadcast(prefix_words(asking).tobytes()))
        rest = confirmed(second.where("yrid IS NOT NULL"))
        done += [second, rest]
        later = later.unionByName(second.where("yrid IS NULL").select(*x)).unionByName(rest)
    out = materialize(later.groupBy("doc", "rid").agg(F.sort_array(F.collect_set("line")).alias("gone")), "gone-lines")
    discard(*done)
    return out


def _with_gone(docs: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """docs with the numbers of the lines that each row loses, and the name of that column."""
    own = {c: free_name(docs, f"__{c}") for c in ("doc", "rid", "gone")}
    gone = later_matches(docs, percent).select(*[F.col(c).alias(n) for c, n in own.items()])
    doc, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    same = (F.xxhash64(doc, text) == F.col(own["rid"])) & (F.coalesce(doc, F.lit(_NONE)) == F.col(own["doc"]))
    return docs.join(small_or_shuffled(gone, 200_000), same, "left").drop(own["doc"], own["rid"]), own["gone"]


def _left(gone: str) -> F.Column:
    """The text without its lines that go."""
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with the remaining lines as text, and n_lines, n_gone (long) before and after.

    Null texts stay null with no lines; an empty text has one line. Extra
    columns stay; those named n_lines or n_gone are replaced. Every row stays
    a row, repeated ones too; what they lose is told at later_matches. Very
    long texts are cut into lines as others. An empty table gives an empty result.
    """
    keep = names_apart(docs, ["n_lines", "n_gone"])
    rows, gone = _with_gone(docs.select(*keep), percent)
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines")
    return rows.select(*[_left(gone).alias(c) if c == "text" else F.col(f"`{c}`") for c in keep], n_lines, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_gone"))


def clean(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with the remaining lines as text and the same columns; documents that lost lines and have no word left go.

    Where there is a column n_chars, it follows a text that changed. Nulls,
    empty and long texts, ties, repeated rows and empty tables: as for dedup.
    """
    rows, gone = _with_gone(docs, percent)
    made = {"text": _left(gone), "n_chars": F.when(F.col(gone).isNotNull(), F.length(_left(gone)).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    out = rows.where(F.col(gone).isNull() | _left(gone).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns])
