import hashlib

import corpus_pipeline as P
from gridloom.llm import bpe_codec, curriculum, gam
from gridloom.llm import queries as Q
from tests.llm import helpers as H


def test_every_operator_has_a_query():
    assert sorted({n.split("_")[0] for n in Q.queries()}, key=lambda n: int(n[2:])) == [f"op{k}" for k in range(1, 11)]


@H.needs_files
def test_pipeline_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    data = [r for r in H.rows() if r[0] is not None]
    data = [*data, *[(2000 + k, " ".join(f"BAD{k}X{j}###" for j in range(60)), "en", "src1", 0) for k in range(30)]]
    labels = [(r[0], int(r[0] < 2000), 0) for r in data]
    H.frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    stage = dict(P.STAGES)
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    predicted = H.counted((r["doc_id"], r["predicted"]) for r in gam.scores(docs, marks).collect())
    good = P.quality_stage(spark, docs, sf)
    assert good.columns == docs.columns
    rows1 = [tuple(r) for r in good.collect()]
    assert H.counted((r[0], 1) for r in rows1) == H.counted(x for x in predicted.elements() if x[1] == 1)

    rows2 = [tuple(r) for r in P.line_stage(spark, good, sf).collect()]
    gone = H.gone_lines(rows1, H.row_hashes(spark, rows1))
    want = []
    for i, t, lang, source, n in rows1:
        left = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))
        if left == t or H.words(left):
            want.append((i, left, lang, source, n if left == t else len(left)))
    assert H.counted(rows2) == H.counted(want)

    two = spark.createDataFrame(rows2, H.SCHEMA)
    rows3 = [tuple(r) for r in stage["ngram_jaccard_join"](spark, two, sf).collect()]
    top = H.components({r[0]: H.shingles(r[1], 5) for r in rows2}, 80)
    assert H.counted(rows3) == H.counted(r for r in rows2 if top[r[0]] == r[0])

    three = spark.createDataFrame(rows3, H.SCHEMA)
    rows4 = [tuple(r) for r in stage["source_mix"](spark, three, sf).collect()]
    small = three.select("doc_id", "source", curriculum.word_count(three["text"]).alias("size"))
    copies = {}
    for r in curriculum.plan(small).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    assert {i: n for i, n in copies.items() if n} == {i: sum(r[0] == i for r in rows4) for i in {r[0] for r in rows4}}

    lib = Tokenizer.from_file(bpe_codec.token_file("word_bpe_49k.json"))
    last = [tuple(r) for r in P.run(spark, sf).collect()]
    made = []
    for i, t, *_ in rows4:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        made.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert H.counted(last) == H.counted(made)


@H.needs_files
def test_stages_keep_odd_rows_and_columns(spark, tmp_path):
    clashing = ("positions", "copies", "position", "n_gone", "n_lines", "__r", "__row", "__gone", "__doc", "size", "taken", "comp")
    odd = [(None, "a null id, some words of its own", "en", None, 0), (None, "another null id with other words", None, "s", 0), (9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "long " * 60_000, "en", "s", 0)]
    data = [*H.rows(n=12), *odd]
    H.frame(spark, data).limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for where in (tmp_path, tmp_path / "empty"):
        spark.createDataFrame([(r[0], 1, 0) for r in data if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    for name, stage in P.STAGES:
        docs = H.frame(spark, data, clashing)
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        if name != "bpe_codec":
            assert out.columns == docs.columns and none.columns == docs.columns and all(r[c] == "x" for r in rows for c in clashing)
            ids = {r["doc_id"] for r in rows}
            assert ids <= {r[0] for r in data} and 9002 in ids and (None in ids)
    assert P.run(spark, f"{tmp_path}/empty").count() == 0


def test_stages_begin_with_collected_heaps(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    P.bpe_stage(spark, H.frame(spark, H.rows(n=1)), "")
    assert full() > before
