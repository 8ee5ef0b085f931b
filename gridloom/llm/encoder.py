"""BPE encoding with forced cuts, exactly as the tokenizers library encodes.

Merges only ever build vocabulary tokens. So where two neighbouring symbols
occur side by side inside no vocabulary token, no merge can cross that place:
it is a certain cut. A pre-token is split at its certain cuts, the fragments
are encoded on their own (only the last one carries the end-of-word suffix),
and their ids are joined. White space always separates pre-tokens in this
vocabulary family, so texts are handled as their white-space runs, and each
distinct run of a slice is encoded once. Runs of letters and ASCII signs are
lower-cased, split and cut as arrays of bytes, and of their fragments only
those go to the library that a bounded two-generation memo does not know.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import chain
from operator import add

import numpy as np
from tokenizers import Tokenizer, models, pre_tokenizers

from gridloom.llm import words as W


def _byte_sign(b: int) -> str:
    """The character that stands for a byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return chr(b) if b in shown else chr(0x100 + [x for x in range(256) if x not in shown].index(b))


class Memo(dict):
    """A dict that computes what it lacks and forgets the less recent half beyond about 2 * limit bytes."""

    def __init__(self, compute, limit: int = 24 << 20):
        super().__init__()
        self.compute, self.limit, self.used, self.old = compute, limit, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        size = 220 + 2 * len(key) + (len(value) if isinstance(value, (bytes, str)) else sum(map(len, value)))
        if size > self.limit >> 3:
            return  # one very long run
        if self.used >= self.limit:
            self.old = dict(self)
            self.clear()
            self.used = 0
        self.used += size
        self[key] = value


#: Of plain bytes: 1 letters, 2 ASCII signs that form one pre-token; 0 all others.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[*range(0x21, 0x27), *range(0x28, 0x30), 0x3A, 0x3B, 0x3D, 0x3E, 0x3F, 0x40, *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
_INNER, _LAST, _OTHER = 0, 1, 2  # fragments before the last one of a pre-token, last ones, runs that are not plain


class CutEncoder:
    """Encodes texts as the tokenizer file at path does with add_special_tokens=False, without truncation or padding.

    The file has to hold a BPE model with an end-of-word suffix or none, no
    continuing prefix, no dropout and no byte fallback; others are refused.
    """

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("unk_token"):
            raise ValueError("a plain BPE model is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.last = self.library.model
        self.inner = models.BPE(vocab=self.vocab, merges=merges, cache_capacity=0)
        self.joined: set[str] = set()
        for token in self.vocab:
            core = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            self.joined.update(map(add, core, core[1:]))
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError("added tokens are needed to match raw text")
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pretokens = Memo(self._pretoken)
        # the two models behind a splitter at white space, which no fragment holds: many different fragments are encoded in one call
        self.many_last, self.many_inner = Tokenizer(models.BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.suffix or None, cache_capacity=0)), Tokenizer(self.inner)
        self.many_last.pre_tokenizer = self.many_inner.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # letters that are composed already and lower-case one by one, then ASCII signs that form one pre-token
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)\Z").match
        sign = [_byte_sign(b) for b in range(256)]
        self.by_sign = str.maketrans({chr(b): sign[b] for b in range(256) if b != 0x20})
        self.near = np.array([a + b in self.joined for a in sign for b in sign])  # by two bytes
        # fragments of up to 64 bytes by kind: those met lately, those met before; about 200 bytes each
        self.known: list[tuple[dict[bytes, bytes], dict[bytes, bytes]]] = [({}, {}), ({}, {})]
        self.most_known = 200_000
        self.signs = str.maketrans({chr(c): "".join(map(_byte_sign, chr(c).encode())) for c in (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))})

    def fragments(self, pretoken: str) -> list[str]:
        """The pretoken split at its certain cuts."""
        if all(map(self.joined.__contains__, map(add, pretoken, pretoken[1:]))):
            return [pretoken]
        cuts = [i for i, pair in enumerate(map(add, pretoken, pretoken[1:]), 1) if pair not in self.joined]
        return [pretoken[a:b] for a, b in zip([0, *cuts], [*cuts, len(pretoken)])]

    def _pretoken(self, pretoken: str) -> bytes:
        parts = self.fragments(pretoken)
        ids = [t.id for t in self.last.tokenize(parts[-1])]
        if len(parts) > 1:
            ids = [t.id for part in parts[:-1] for t in self.inner.tokenize(part)] + ids
        return packed(ids)

    def pieces(self, chunk: str) -> list[str | int]:
        """The pre-tokens of a run of characters without white space (or of any text), and the ids of its special tokens."""
        if plain := self.plain(chunk):  # letters only: one pre-token, equal to its lower-cased form
            letters, signs = plain.groups()
            letters = letters.lower()
            letters = letters if letters.isascii() else letters.translate(self.signs)
            return [letters, signs] if signs else [letters]
        out: list[str | int] = []
        for part in self.split_special.split(chunk) if self.split_special and "<" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def run(self, chunk: str) -> bytes:
        """Packed ids of a run."""
        return b"".join([self.pretokens[x] if isinstance(x, str) else packed([x]) for x in self.pieces(chunk)])

    def runs(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of many runs: the fragments of pre-tokens that are not known yet are encoded together."""
        split = list(map(self.pieces, chunks))
        memo, old, found, new = self.pretokens, self.pretokens.old, {}, {}
        for x in set(chain.from_iterable(split)):
            if x.__class__ is int:
                found[x] = packed([x])
            elif (ids := memo.get(x) or old.get(x)) is not None:
                found[x] = ids
            else:
                new[x] = self.fragments(x)
        last, inner = list({f[-1] for f in new.values()}), list({x for f in new.values() if len(f) > 1 for x in f[:-1]})
        last, inner = dict(zip(last, self._bulk(self.many_last, last))), dict(zip(inner, self._bulk(self.many_inner, inner)))
        for x, f in new.items():
            found[x] = ids = last[f[0]] if len(f) == 1 else b"".join([inner[y] for y in f[:-1]]) + last[f[-1]]
            memo.put(x, ids)
        return [found[own[0]] if len(own) == 1 else b"".join([found[x] for x in own]) for own in split]

    @staticmethod
    def _bulk(tokenizer: Tokenizer, fragments: list[str], most: int = 1000) -> list[bytes]:
        """Packed ids of each of these fragments; for the tokenizer, which splits at white space, each is a word."""
        out = []
        for lo in range(0, len(fragments), most):
            part = fragments[lo : lo + most]
            made = tokenizer.encode(" ".join(part), add_special_tokens=False)
            edge = (4 * np.searchsorted(np.array(made.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            raw = np.array(made.ids, "<u4").tobytes()
            out += [raw[a:b] for a, b in zip(edge[:-1], edge[1:])]
        return out

    def cut(self, part: np.ndarray, head: np.ndarray):
        """(bytes, begins, kinds) of the units of the runs that begin at head: fragments of lower-cased plain runs, other runs as they are."""
        kind, low = _CLASS[part], W.lowered(part)
        lead = np.flatnonzero(part[:-1] == 0xC3)
        after = part[lead + 1]
        letter = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)  # composed letters
        lead, after = lead[letter], after[letter]
        kind[lead] = kind[lead + 1] = 1
        low[lead[after <= 0x9E] + 1] += 32
        first = np.zeros(len(part), bool)
        first[head] = True
        wrong = kind == 0
        wrong[1:] |= (kind[1:] < kind[:-1]) & ~first[1:]
        plain = ~np.logical_or.reduceat(wrong, head) & (kind[head] == 1)
        inside = np.repeat(plain, np.diff(np.append(head, len(part))))
        turn = first.copy()  # where a pre-token begins
        turn[1:] |= inside[1:] & (kind[1:] != kind[:-1])
        begin = turn.copy()
        begin[1:] |= inside[1:] & ~self.near[(low[:-1].astype(np.uint16) << 8) | low[1:]]
        at = np.flatnonzero(begin)
        kinds = np.where(inside[at], np.append(turn[at[1:]], True).astype(np.uint8), np.uint8(_OTHER))
        return np.where(inside, low, part), at, kinds

    def coded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of runs one after the other, where each run's begin and the last one's end); runs are byte ranges of data."""
        size = ends - starts
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        parts, begins, kinds, hashes, lo = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint64)], 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + W.SEGMENT, side="right")) - 1)
            own, head = size[lo:hi], upto[lo:hi] - upto[lo]
            part, at, kind = self.cut(data[np.repeat(starts[lo:hi] - head, own) + np.arange(upto[hi] - upto[lo])], head)
            parts.append(part)
            begins.append(at + upto[lo])
            kinds.append(kind)
            hashes.append(W.mix(W.span_hashes(part, at, np.append(at[1:], len(part))) + kind))
            lo = hi
        part, begin, kind, hashed = map(np.concatenate, (parts, begins, kinds, hashes))
        end = np.append(begin[1:], len(part))[: len(begin)]
        at, which = W.distinct_runs(part, hashed, begin, end)
        if (kind != kind[at][which]).any():
            at = which = np.arange(len(kind))
        raw, codes = part.tobytes(), np.empty(len(at), object)
        for k in (_INNER, _LAST, _OTHER):
            pick = np.flatnonzero(kind[at] == k)
            keys = [raw[a:b] for a, b in zip(begin[at[pick]].tolist(), end[at[pick]].tolist())]
            codes[pick] = self.runs([x.decode() for x in keys]) if k == _OTHER else self._fragments(k, keys)
        flat = np.frombuffer(b"".join(codes), np.uint32)
        ids, edge = W.spread(np.fromiter(map(len, codes), np.int64, len(codes)) >> 2, which, flat)
        return ids, edge[np.searchsorted(begin, upto)]

    def _fragments(self, kind: int, keys: list[bytes]) -> list[bytes]:
        """Packed ids of different fragments, given as bytes."""
        known, old = self.known[kind]
        out = list(map(known.get, keys))
        new = []
        for i in [i for i, x in enumerate(out) if x is None]:
            out[i] = ids = old.get(keys[i])
            if ids is None:
                new.append(i)
            else:
                known[keys[i]] = ids
        listed = b" ".join([keys[i] for i in new]).decode("latin-1").translate(self.by_sign).split(" ") if new else []
        for i, ids in zip(new, self._bulk((self.many_inner, self.many_last)[kind], listed)):
            out[i] = ids
            if len(keys[i]) <= 64:
                known[keys[i]] = ids
        if len(known) > self.most_known:
            self.known[kind] = {}, known
        return out

    def words(self, text: str) -> list[str]:
        """The text's runs between ASCII white space."""
        for c in "\n\t\r\x0b\x0c":
            if c in text:
                text = text.replace(c, " ")
        return [w for w in text.split(" ") if w]


_by_path: dict[str, CutEncoder] = {}
W.HELD["encoder"] = _by_path.clear


def encoder(path: str) -> CutEncoder:
    """One encoder for each worker process and file."""
    if path not in _by_path:
        _by_path[path] = CutEncoder(path)
    return _by_path[path]


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def encode_packed(path: str, text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    enc = encoder(path)
    return b"".join(map(enc.run, enc.words(text)))


def encode_runs(path: str, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the different runs between white space, where each one's begin and the last one's end, which of them each run is, where each text's runs begin and the last one's end).

    Runs are told apart by their 64-bit hashes and then by their bytes, so
    that each different one of an Arrow column is encoded once.
    """
    data, offs = W.text_buffers(column)
    first, hashes, starts, ends = W.word_hashes(data, offs, lower=False, spans=True)
    at, which = W.distinct_runs(data, hashes, starts, ends)
    return *encoder(path).coded(data, starts[at], ends[at]), which, first


def encode_column(path: str, column) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts of an Arrow column one after the other, where each text's begin and the last one's end)."""
    flat, edge, which, first = encode_runs(path, column)
    ids, edge = W.spread(np.diff(edge), which, flat)
    return ids, edge[first]


def encode_texts(path: str, column) -> list[tuple[str, str]]:
    """For each text of an Arrow column its decimal ids joined by spaces, and its decoded text (tokens joined by spaces)."""
    name = encoder(path).name
    flat, edge, which, first = encode_runs(path, column)
    flat, spans = flat.tolist(), list(zip(edge[:-1].tolist(), edge[1:].tolist()))
    numbers = [" ".join(map(str, flat[a:b])) for a, b in spans]
    names = [" ".join(map(name.__getitem__, flat[a:b])) for a, b in spans]
    some = (np.diff(edge) > 0)[which] if len(spans) else np.zeros(0, bool)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        own = which[a:b][some[a:b]].tolist()  # a run may have no ids
        out.append((" ".join([numbers[k] for k in own]), " ".join([names[k] for k in own])))
    return out
