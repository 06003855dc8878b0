"""The pipeline's stages on small tables."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    top = tmp_path_factory.mktemp("stages")
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        df = f(spark, docs, SF)
        df.write.parquet(f"file://{top}/{i}")
        docs = spark.read.parquet(f"file://{top}/{i}")
        out.append(docs)
    return out


def test_stages(stages, spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(s.columns == docs.columns for s in stages[:-1])
    counts = [docs.count(), *(s.count() for s in stages)]
    assert counts[0] > counts[1] > counts[2] >= counts[3] >= counts[4] == counts[5]
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    texts = [r["text"] for r in stages[1].select("text").collect()]
    assert len(texts) == len(set(texts))


def test_decisions_take_effect(stages, spark):
    first = {}
    for r in stages[2].orderBy("doc_id").collect():
        words = (r["text"] or "").lower().split()
        for k in range(0, len(words) - 99):  # what was next to a removed passage may repeat by chance, not a hundred words
            assert first.setdefault(" ".join(words[k : k + 100]), r["doc_id"]) == r["doc_id"]
        assert r["n_chars"] == len(r["text"] or "")
    last = {r["doc_id"]: r for r in stages[4].collect()}
    for r in stages[3].collect():
        assert last[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_planted_copies_and_passages(spark, tmp_path):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"word{x}" for x in rng.integers(0, 10**5, n))
    base, passage = text(400), text(60)
    rows = [(1, base), (2, base), (3, base.replace(base.split()[200], "changed")), (4, text(300) + "\n" + passage), (5, text(100) + " " + passage + " " + text(100)), (8, "  " + passage), (6, None), (7, None), (6, None), (None, base)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 8] and kept.columns == docs.columns
    out = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, kept, SF).collect()}
    assert passage in out[4]["text"] and passage not in out[5]["text"] and out[5]["n_chars"] == len(out[5]["text"]) and out[1]["text"] == base and sorted(out) == [1, 4, 5, 6]
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).count() == 0
