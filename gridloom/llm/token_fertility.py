"""Operator 8: quality rules by tokeniser fertility."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.common import token_file
from gridloom.llm.encoder import Memo
from gridloom.runtime import materialize

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = " \t\n\r\x0b\x0c"
#: Code point ranges that tell scripts apart; the first that holds most letters wins. Fixed values.
_SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3))
_pieces: dict[tuple[str, str], tuple] = {}
W.HELD["pieces"] = _pieces.clear

FEATURES = "doc_id long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, chars_per_token2 double, fallback_share double, token_entropy double"


def _vocabulary(path: str, other: str):
    """(memo from word to packed values, which ids are raw bytes), once for each worker; the values are the word's tokens in the other vocabulary, then its ids."""
    if (path, other) not in _pieces:
        import base64

        import sentencepiece
        import tiktoken

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
        with open(other, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        # fixed value: how this vocabulary family splits text before merging
        split = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        second = tiktoken.Encoding("second", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        _pieces[path, other] = (Memo(lambda w: np.array([len(second.encode_ordinary(" " + w)), *sp.encode(w)], np.uint32).tobytes()), raw)
    return _pieces[path, other]


_EDGES = np.array([x for _, lo, hi in _SCRIPTS for x in (lo, hi + 1)], np.uint32)


def script_of(text: str) -> str:
    """The script of most characters, by code point ranges."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(np.searchsorted(_EDGES, points, side="right"), minlength=2 * len(_SCRIPTS) + 1)[1::2]
    return _SCRIPTS[int(counts.argmax())][0] if counts.any() else "none"


def _repeat_words(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each text, its words in three-word windows found twice or more in it."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    if len(hashes) < 3:
        return np.zeros(n, np.int64)
    whole = text[:-2] == text[2:]
    runs = W.mix(W.windows(hashes, 3) + text[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(whole)
    order = at[np.argsort(runs[at])]
    ranked = runs[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(hashes), bool)
    for j in range(3):
        hit[order[twice] + j] = True
    return np.bincount(text[hit], minlength=n).astype(np.int64)


def features(docs: DataFrame, path: str | None = None, other: str | None = None) -> DataFrame:
    """Base counts and token statistics of every whole text, one row per input row.

    Null and empty texts have counts and ratios of 0. band is the document's
    lang, or where that is null or absent the text's main script. Hashes of 64
    bits stand for three-word windows. Words are tokenised one by one, each
    different one of a slice once. Memory: a slice of 1 MB of text, or one
    longer text, with some 60 bytes for each of its bytes.
    """
    path, other = path or token_file("piece_bpe_32k.model"), other or token_file("byte_bpe_multi_50k.tiktoken")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches):
        for b in W.small_batches(batches, most=1 << 20, keeps="pieces"):
            memo, raw = _vocabulary(path, other)
            data, offs = W.text_buffers(b.column(1))
            first, hashes, starts, ends = W.word_hashes(data, offs, lower=False, spans=True)
            many = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offs])
            chars = many(((data & 0xC0) != 0x80) & ~W.IS_SPACE[data])
            dups, bands = [], []
            for text, band in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                seen, dup = set(), 0
                for line in (text or "").split("\n"):
                    if line in seen:
                        dup += bool(line.strip(_SPACE))
                    else:
                        seen.add(line)
                dups.append(dup)
                bands.append(band if band is not None else script_of(text or ""))
            at, which = W.distinct_runs(data, hashes, starts, ends)
            whole = data.tobytes()
            codes = [memo[whole[s:e].decode()] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            second = np.array([int.from_bytes(x[:4], "little") for x in codes], np.int64)
            ids, edge = W.spread(np.array([len(x) // 4 - 1 for x in codes], np.int64), which, np.frombuffer(b"".join(x[4:] for x in codes), np.uint32))
            edge = edge[first]
            tokens = np.diff(edge)
            some = np.maximum(tokens, 1)
            tokens2 = np.diff(np.concatenate(([0], np.cumsum(second[which])))[first])
            fallback = np.diff(np.concatenate(([0], np.cumsum(raw[ids])))[edge]) / some
            text_of = np.repeat(np.arange(len(tokens)), tokens)
            kinds, times = np.unique((text_of << 20) | ids, return_counts=True)
            share = times / some[kinds >> 20]
            entropy = np.bincount(kinds >> 20, weights=-share * np.log2(share), minlength=len(tokens)) / np.maximum(1.0, np.log2(some))
            out = [b.column(0), pa.array(bands, pa.string()), np.diff(first).astype(np.int64), chars.astype(np.int64), many(_IS_SYMBOL[data]).astype(np.int64), np.array(dups, np.int64), _repeat_words(first, hashes), tokens, chars / some, chars / np.maximum(tokens2, 1), fallback, entropy]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], [x.split()[0] for x in FEATURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lang).mapInArrow(run, FEATURES)


#: What the bands bound, and the least interquartile range of each.
MEASURES = {"chars_off": 0.5, "chars2_off": 0.5, "fallback_share": 0.02, "entropy_off": 0.005}
_GRID = 3  # decimals to which measures are rounded where quantiles are taken


def quantiles(rows: DataFrame, measures: list[str], shares: list[float]) -> DataFrame:
    """For each band, an array of the quantiles of each measure: the least value that a share of its rows does not exceed.

    Values are counted on a grid, so reruns agree and a band's counts, not
    its rows, meet in one task.
    """
    out = None
    for m in measures:
        counts = rows.groupBy("band", F.round(m, _GRID).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        line = Window.partitionBy("band").orderBy("v")
        ranked = counts.withColumn("upto", F.sum("n").over(line)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
        one = ranked.groupBy("band").agg(F.array(*[F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("v"))) for share in shares]).alias(m))
        out = one if out is None else out.join(one, "band")
    return out


def deviations(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """rows with chars_off, chars2_off and entropy_off: what is left of characters per token and token entropy once length is allowed for.

    The mean of a text's characters per token strays from its band's median
    as 1 / sqrt(words), and its entropy falls with the logarithm of its
    words, along a line that is fitted to the band.
    """
    r = rows.join(fitted, "band", "left")
    size = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    off = {f"{m}_off": (F.col(full) - F.col(f"{m}_middle")) * F.sqrt(size) for m, full in (("chars", "chars_per_token"), ("chars2", "chars_per_token2"))}
    return r.withColumns(off | {"entropy_off": F.col("token_entropy") - F.col("level") - F.col("slope") * F.ln(size)}).drop("chars_middle", "chars2_middle", "level", "slope")


def fit(rows: DataFrame) -> DataFrame:
    """For each band: the medians of characters per token, and the line of entropy over the logarithm of words."""
    x = F.ln(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    lines = rows.groupBy("band").agg(F.round(F.coalesce(F.regr_slope("token_entropy", x), F.lit(0.0)), 9).alias("slope"), F.round(F.coalesce(F.regr_intercept("token_entropy", x), F.avg("token_entropy")), 9).alias("level"))
    middle = quantiles(rows, ["chars_per_token", "chars_per_token2"], [0.5])
    return lines.join(middle.select("band", F.col("chars_per_token")[0].alias("chars_middle"), F.col("chars_per_token2")[0].alias("chars2_middle")), "band")


def bands(rows: DataFrame, width: float) -> DataFrame:
    """For each band, the accepted range of each measure: quartiles widened by `width` interquartile ranges.

    The least ranges of MEASURES keep a measure that hardly varies (the byte
    share of plain Latin text is 0) from rejecting small deviations.
    """
    cols = [F.col("band")]  # with a width of 3 these are the outer fences of a box plot
    for m, least in MEASURES.items():
        spread = F.greatest(F.col(m)[1] - F.col(m)[0], F.lit(least))
        cols += [(F.col(m)[0] - width * spread).alias(f"{m}_low"), (F.col(m)[1] + width * spread).alias(f"{m}_high")]
    return quantiles(rows, list(MEASURES), [0.25, 0.75]).select(*cols)


def rules(docs: DataFrame, path: str | None = None, other: str | None = None, width: float = 3.0) -> DataFrame:
    """One row per document with the base counts, base_failed and kept.

    kept is false where base_failed, else where characters per token (of
    either vocabulary), byte-fallback share or token entropy lies outside its
    language's band. Bands come from all documents that pass the base rules.
    Null and empty texts fail the base rules; very long ones are measured
    whole. Repeated rows are judged one by one, equal texts of one band
    equally. Only doc_id, text and lang are read, so other names cannot clash.
    An empty table gives an empty result.
    """
    rows = features(docs, path, other).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = materialize(rows, "fertility")
    fitted = materialize(fit(rows.where(~F.col("base_failed"))), "fitted")
    rows = deviations(rows, fitted)
    ranges = materialize(bands(rows.where(~F.col("base_failed")), width), "bands")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    joined = rows.join(ranges, "band", "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "chars_per_token", "chars_per_token2", "fallback_share", "token_entropy")
