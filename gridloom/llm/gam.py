"""Operator 7: quality classifier, a generalised additive model with pairwise interactions."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.common import free_name, small_or_shuffled
from gridloom.runtime import materialize

#: What the model sees of a text; nothing of lang, source, ids or labels.
NAMES = ("log_words", "word_len", "word_len_sd", "distinct_share", "next_same", "upper_share", "digit_share", "sign_share", "bang_share", "bar_share", "line_words", "dup_lines", "stop_share", "period_share", "long_words", "high_share", "repeat_share", "top_share", "title_share", "line_end_stop")
_CLASS = np.zeros((256, 6), np.float64)
for _c in range(256):
    ch = chr(_c)
    _CLASS[_c] = [65 <= _c <= 90, 48 <= _c <= 57, ch in "#*$%&<>@^~_=+\\{}[]", ch == "!", ch == "|", ch in ".?!"]
_KINDS = _CLASS.argmax(axis=1)
_ANY = _CLASS.any(axis=1)


def measure(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text; null counts as empty, and an empty text has zeros."""
    data, offs = W.text_buffers(column)
    first, hashes, starts, ends = W.word_hashes(data, offs, lower=False, spans=True)
    n = len(offs) - 1
    out = np.zeros((n, len(NAMES)))
    words = np.diff(first)
    some = np.maximum(words, 1)
    size = np.maximum(np.diff(offs), 1)
    text = np.repeat(np.arange(n), words)
    mean = lambda x: np.bincount(text, weights=x, minlength=n) / some
    lengths = (ends - starts).astype(float)
    out[:, 0] = np.log1p(words)
    out[:, 1] = mean(lengths)
    out[:, 2] = np.sqrt(np.maximum(mean(lengths**2) - out[:, 1] ** 2, 0))
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    out[:, 4] = mean(same)
    for col, kind in ((5, 0), (6, 1), (7, 2), (8, 3), (9, 4), (13, 5)):
        flag = _CLASS[:, kind][data] if kind == 5 else (_ANY[data] & (_KINDS[data] == kind))
        total = np.concatenate(([0.0], np.cumsum(flag)))
        out[:, col] = (total[offs[1:]] - total[offs[:-1]]) / (some if kind == 5 else size)
    total = np.concatenate(([0], np.cumsum(data >= 128)))
    out[:, 15] = (total[offs[1:]] - total[offs[:-1]]) / size
    out[:, 14] = mean(lengths > 14)
    out[:, 12] = mean(lengths <= 3)
    if len(starts):
        head, tail = data[starts], data[ends - 1]
        out[:, 18] = mean((head >= 65) & (head <= 90))
        out[:, 19] = mean((tail == 46) | (tail == 63) | (tail == 33))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            kinds, counts = np.unique(hashes[a:b], return_counts=True)
            out[i, 3] = len(kinds) / (b - a)
            out[i, 17] = counts.max() / (b - a)
            if b - a > 2:
                pairs = np.unique(W.windows(hashes[a:b], 2))
                out[i, 16] = 1 - len(pairs) / (b - a - 1)
    for i, t in enumerate(column.to_pylist()):
        if t:
            lines = [x for x in t.split("\n") if x.strip()]
            if lines:
                out[i, 10] = words[i] / len(lines)
                out[i, 11] = 1 - len(set(lines)) / len(lines)
    return out


class Gam:
    """Lookup tables for each feature and for some pairs of features, over quantile bins."""

    def __init__(self, cuts, singles, pairs, base):
        self.cuts, self.singles, self.pairs, self.base = cuts, singles, pairs, base

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: sums of bin values, vectorised."""
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.singles):
            z += table[b[:, j]]
        for (i, j), (bi, bj, table) in self.pairs.items():
            z += table[bi[b[:, i]], bj[b[:, j]]]
        return 1 / (1 + np.exp(-z))


def _step(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A shallow tree over ordered bins: greedy splits into at most `leaves` ranges; the value of each bin."""
    cg, ch = np.concatenate(([0], np.cumsum(grad))), np.concatenate(([0], np.cumsum(hess)))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    ranges = [(0, len(grad))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(ranges):
            if b - a > 1:
                m = np.arange(a + 1, b)
                g = gain(a, m) + gain(m, b) - gain(a, b)
                at = int(g.argmax())
                if g[at] > best[0]:
                    best = (g[at], k, int(m[at]))
        if best[1] is None:
            break
        a, b = ranges.pop(best[1])
        ranges += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in ranges:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def train(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 150, rate: float = 0.15, leaves: int = 3, pairs: int = 6, ridge: float = 2.0) -> Gam:
    """Cyclic boosting: each round fits one shallow tree to every feature in turn; then pairs in the same way on what is left."""
    features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(features)]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(cuts, [np.zeros(len(c) + 1) for c in cuts], {}, float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    z = np.full(len(y), model.base)

    def parts():
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(features):
            if len(cuts[j]):
                g, h = parts()
                m = len(cuts[j]) + 1
                step = rate * _step(np.bincount(b[:, j], g, m), np.bincount(b[:, j], h, m), leaves, ridge)
                model.singles[j] += step
                z += step[b[:, j]]
    wide = [np.minimum(np.arange(len(c) + 1) * coarse // (len(c) + 1), coarse - 1) for c in cuts]
    small = np.stack([wide[j][b[:, j]] for j in range(features)], axis=1)
    g, h = parts()
    worth = []
    for i in range(features):
        for j in range(i + 1, features):
            cell = small[:, i] * coarse + small[:, j]
            gs, hs = np.bincount(cell, g, coarse * coarse), np.bincount(cell, h, coarse * coarse)
            worth.append((float((gs**2 / (hs + ridge)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(worth, reverse=True)[:pairs]]
    tables = {p: np.zeros((coarse, coarse)) for p in chosen}
    for _ in range(rounds // 3):
        for i, j in chosen:
            g, h = parts()
            cell = small[:, i] * coarse + small[:, j]
            gs, hs = np.bincount(cell, g, coarse * coarse).reshape(coarse, coarse), np.bincount(cell, h, coarse * coarse).reshape(coarse, coarse)
            best = None
            for a in range(1, coarse):
                for c in range(1, coarse):
                    quarters = [(slice(0, a), slice(0, c)), (slice(0, a), slice(c, None)), (slice(a, None), slice(0, c)), (slice(a, None), slice(c, None))]
                    value = sum(gs[q].sum() ** 2 / (hs[q].sum() + ridge) for q in quarters)
                    if best is None or value > best[0]:
                        best = (value, quarters)
            step = np.zeros((coarse, coarse))
            for q in best[1]:
                step[q] = rate * gs[q].sum() / (hs[q].sum() + ridge)
            tables[(i, j)] += step
            z += step[small[:, i], small[:, j]]
    model.pairs = {(i, j): (wide[i], wide[j], t) for (i, j), t in tables.items()}
    return model


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, x array of double) of every whole text; rid is a hash of doc_id and text."""

    def run(batches):
        for b in W.small_batches(batches, most=1 << 19):
            x = measure(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))], ["doc_id", "rid", "x"])

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("rid")).mapInArrow(run, "doc_id long, rid long, x array<double>")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(rows: DataFrame, labels: DataFrame, sample: int = 20_000) -> Gam:
    """Train on at most `sample` labelled rows outside the held-out third: those with the smallest hash of doc_id.

    `sample` is the documented bound of what reaches the driver. Labels other
    than 0 and 1 are ignored; of several labels for a doc_id the smallest counts,
    of several texts the one with the smallest rid, so reruns learn the same.
    """
    known = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("rid", "x")).alias("r")).select("doc_id", "r.x", "quality").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy())
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES))[order]
    return train(x, got.column("quality").to_numpy().astype(float)[order])


def scored(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, rid, score) of every row; texts are measured once, the model is fitted and applied to what was measured."""
    rows = materialize(features(docs), "features")
    model = fit(rows, labels, sample)

    def run(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(x))], ["doc_id", "rid", "score"])

    return rows.mapInArrow(run, "doc_id long, rid long, score double")


def scores(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, score (higher: label 1 likelier), predicted.

    Null and empty texts are scored like any text of zeros, very long ones
    whole (a slice holds 0.5 MB or one longer text). Without labels every
    score is 0.5. Repeated rows are scored one by one, equal texts equally.
    Other columns are not read; an empty table gives an empty result.
    """
    found = scored(docs, labels, sample)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """docs without those that the classifier rejects (score below 0.5); columns and repeated rows unchanged.

    Nulls, empty and very long texts, ties and empty tables: as for scores. A
    row is found again by its doc_id (null too) and the hash of doc_id and
    text, so columns of any other name pass through untouched.
    """
    own, other = free_name(docs, "__doc"), free_name(docs, "__rid")
    bad = scored(docs, labels, sample).where("score < 0.5").select(F.col("doc_id").alias(own), F.col("rid").alias(other)).distinct()
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    return docs.join(small_or_shuffled(materialize(bad, "rejected")), (F.xxhash64(doc_id, text) == F.col(other)) & doc_id.eqNullSafe(F.col(own)), "left_anti")
