"""Fixtures and brute-force versions for the operators of gridloom.llm."""

import random
import re
from collections import Counter

import pytest

from gridloom.runtime import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(seed=3, n=60):
    """Texts with exact copies, near copies, shared lines, empty and null ones, other scripts and one long one."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    make = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = make(12)
    out = [None, "", " \n\t ", "one", "one two three", "Ünï code 漢字 <|endoftext|> it's á ΑΣ", "ONE", make(4000)]
    for i in range(n):
        t = "\n".join(make(rng.randint(1, 15)) for _ in range(rng.randint(1, 6)))
        out.append(t)
        if i % 4 == 0:
            out.append(t.upper() if i % 8 == 0 else t)
        if i % 3 == 0:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        if i % 5 == 0:
            out.append(make(5) + "\n" + shared + "\n" + make(5))
    return out


def rows(seed=3, n=60):
    made = [(i * 3 % 1009, t, None if i % 11 == 0 else "en", None if i % 7 == 0 else f"src{i % 4}", len(t or "")) for i, t in enumerate(texts(seed, n))]
    return [*made, made[9], made[9]]  # repeated rows


def frame(spark, data=None, extra=()):
    """Documents; extra columns have names that the operators use themselves."""
    from pyspark.sql import functions as F

    ship(spark)
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("x") for c in extra})


def shingles(text, k):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(sets, percent):
    """Smallest reachable id of each id, all pairs compared."""
    ids = sorted(sets)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def row_hashes(spark, data):
    """(doc_id, text) -> the hash that orders rows with one doc_id."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t, *_ in data], "doc_id long, text string")
    return {(r[0], r[1]): r[2] for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text")).collect()}


def gone_lines(data, hashes, percent=80):
    """{(doc_id, text): lines} that line dedup takes away; all pairs of lines of all different rows compared."""
    lines = []
    for i, t in {(i, t) for i, t, *_ in data if t is not None}:
        for k, part in enumerate(t.split("\n")):
            if s := frozenset(words(part.translate(LOW))):
                lines.append(((i is not None, i or 0, hashes[i, t], k), s, (i, t)))
    out = {}
    for at, s, row in lines:
        if any(other < at and 100 * len(s & r) >= percent * len(s | r) for other, r, _ in lines):
            out.setdefault(row, set()).add(at[3])
    return out


def counted(rows_):
    return Counter(map(tuple, rows_))


needs_files = pytest.mark.skipif(__import__("importlib").util.find_spec("public_tokenizers") is None, reason="no vocabulary files")
