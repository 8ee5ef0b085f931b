"""Operator 6: BPE encoding and decoding by forced-boundary splitting."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import encoder as E
from gridloom.llm import words as W
from gridloom.llm.common import names_apart, token_file

SLICE = 1 << 20


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", n: str = "n_tokens") -> DataFrame:
    """docs with the ids of each text (array of int) and their number.

    Nulls and empty texts have no ids. Other columns stay; where one has the
    name of a new column, the new one takes its place. Rows, repeated ones
    too, are encoded one by one, so ties do not matter; very long texts are
    encoded whole. Memory is a slice of 1 MB, or one longer text, plus memos of
    a bounded size.
    """
    path = path or token_file("word_bpe_49k.json")
    keep = names_apart(docs, [ids, n])

    def run(batches):
        import numpy as np

        for b in W.small_batches(batches, keep.index(text), SLICE, "encoder"):
            values, offs = E.encode_column(path, b.column(keep.index(text)).cast(pa.string()))
            made = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, made, pa.array(np.diff(offs).astype(np.int64))], [*keep, ids, n])

    schema = docs.select(*keep).schema.add(ids, T.ArrayType(T.IntegerType())).add(n, "long")
    return docs.select(*keep).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of their ids, as the library's decode(ids, skip_special_tokens=False) with this file.

    The file has no decoder, for which the library joins the tokens by spaces.
    Null ids give null; ids outside the vocabulary are left out, as the library does.
    """
    path = path or token_file("word_bpe_49k.json")
    keep = names_apart(rows, [out])

    def run(batches):
        enc = E.encoder(path)
        for b in batches:
            made = [None if x is None else " ".join(enc.name[i] for i in x if i in enc.name) for x in b.column(keep.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], [*keep, out])

    return rows.select(*keep).mapInArrow(run, rows.select(*keep).schema.add(out, "string"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (see the contract of operator 6).

    Null and empty texts have no ids and an empty decoded text. Repeated rows
    are encoded one by one; very long texts and runs without white space are
    encoded whole, the latter in fragments between their certain cuts. Other
    columns are not read; an empty table gives an empty result.
    """
    path = path or token_file("word_bpe_49k.json")

    def run(batches):
        for b in W.small_batches(batches, 1, SLICE, "encoder"):
            n, a, d = [], [], []
            for ids, names in E.encode_texts(path, b.column(1)):
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                d.append(hashlib.sha256(names.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
