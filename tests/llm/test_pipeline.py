"""The pipeline, stage by stage, against what its operators find."""

import random

import pytest

pytest.importorskip("inkvane.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from inkvane.llm import decontaminate, hyperminhash, suffixes
from inkvane.llm.common import Workspace, shingle_set


def test_stages(spark, sf):
    ws = Workspace(spark, "t")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
        if name == "near_dedup":
            sets = [set(shingle_set(r.text).tolist()) for r in docs.collect()]
            assert not any(a and 100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
        if name == "suffix_dedup":
            assert suffixes.repeated_passages(docs).count() == 0
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert hyperminhash.near_duplicates(docs).count() == n
    name, last = corpus_pipeline.STAGES[-1]
    out = last(spark, docs, sf)
    assert out.count() == n and out.filter("not round_trip").count() == 0


def test_labelled_toxic_documents_go(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(toxic.values()) > 5 and not {i for i, t in toxic.items() if t} & kept
    assert sum(i in kept for i, t in toxic.items() if not t) > 0.95 * sum(not t for t in toxic.values())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n long, id string, kept boolean"


def folder(spark, path, rows, labels, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", None) for i, t in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, copies, passages, leaks and toxic texts, in clashing columns."""
    rnd = random.Random(1)
    words = lambda n: [f"w{rnd.randrange(50_000)}" for _ in range(n)]
    item, passage, text = words(20), words(60), words(90)
    rows = [(None, None), (1, None), (2, ""), (3, "  \n"), (4, " ".join(words(30_000))), (5, " ".join(text)), (6, " ".join(text)), (7, " ".join([*text, "end"]))]
    rows += [(8, " ".join(words(30) + passage)), (9, " ".join(passage + words(30))), (10, " ".join(words(9) + item + words(9))), (None, " ".join(text)), (11, "a b"), (11, "a b"), (12, " ".join(words(50) + passage))]
    rows += [(k, " ".join(words(20) + (["vile", "rotten"] if k % 4 == 0 else []))) for k in range(100, 180)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(100, 140)] + [(None, None, None), (1, None, 1), (120, 0, 1), (120, 0, 1)]
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, rows, labels, [(1, " ".join(item)), (None, None), (2, ""), (1, " ".join(item))])).collect()
    left = [r.doc_id for r in out]
    assert all(r.round_trip for r in out)
    assert not set(left) & {6, 7, 10, *range(100, 180, 4)} and set(left) >= {1, 2, 3, 4, 5, 8, 9, 11, 12, *(k for k in range(100, 180) if k % 4)}
    assert left.count(None) == 2 and left.count(11) == 2
    pieces = {r.doc_id: r.n_pieces for r in out}
    assert pieces[9] < pieces[8] and pieces[12] < pieces[8] and pieces[1] == pieces[2] == 0


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], [], [])).count() == 0
