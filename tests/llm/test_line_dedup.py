"""Line dedup against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlore.llm import line_dedup, queries

SPACES = " \t\n\x0b\x0c\r"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACES))


def brute(rows, min_chars, min_docs):
    """rows: (doc_id, text). Of each row the text that stays, lines before, and the positions that go."""
    rank = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [k for k, x in enumerate(lines) if len(h := holders.get(key_of(x), ())) >= min_docs and min(h, key=rank) != i]
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), tuple(gone)))
    return Counter(out)


def got(df):
    return Counter((r["doc_id"], r["text"], r["n_lines"], tuple(r["dropped_lines"])) for r in df.collect())


@pytest.mark.parametrize(("min_chars", "min_docs"), [(10, 2), (0, 2), (3, 4), (10, 1)])
def test_lines_against_brute_force(spark, min_chars, min_docs):
    rng = np.random.default_rng(min_chars * 7 + min_docs)
    pool = ["the very common line", "a LICENSE line\t", " a license LINE", "Ärger mit Zeilen", "ärger mit zeilen", "ten chars!", "nine char", "", "  ", "\x1cnot blank here\x1c", "tail\r", "　wide blank line　"]
    rows = [(i, "\n".join(pool[k] if rng.random() < 0.8 else f"own line {rng.integers(40)}" for k in rng.integers(0, len(pool), rng.integers(0, 30)))) for i in range(150)]
    rows += [(i, "the very common line\nonly here " + str(i)) for i in range(150, 400)]  # a line of most documents
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, "the very common line\nnull line here"), (None, "null line here\nx"), (-5, None), (401, ""), (402, "null line here")]
    rows.append((403, "\n".join(f"long {k % 50} of lines" for k in range(20_000))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(line_dedup.dedup_lines(df, min_chars, min_docs)) == brute(rows, min_chars, min_docs)


def test_lines_of_clashing_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, n_chars int, n_lines string, gone long, id long, none string, key int, row int, whole int"
    df = spark.createDataFrame([(1, "a shared line of text\nx", 23, "q", 1, 2, "n", 3, 4, 5), (2, "A Shared Line of Text\ny", 23, "q", 1, 2, "n", 3, 4, 5)], schema)
    out = line_dedup.dedup_lines(df)
    rows = {r["doc_id"]: r.asDict() for r in out.collect()}
    assert [c for c in out.columns if c not in ("n_lines", "dropped_lines")] == [c for c in df.columns if c != "n_lines"]
    assert rows[1]["text"] == "a shared line of text\nx" and rows[1]["n_chars"] == 23 and rows[1]["dropped_lines"] == []
    assert (rows[2]["text"], rows[2]["n_chars"], rows[2]["n_lines"], rows[2]["none"], rows[2]["whole"]) == ("y", 1, 2, "n", 5)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="min_docs"):
        line_dedup.dedup_lines(df, min_docs=0)


def test_line_query_is_native(spark):
    df = queries.op11_line_dedup(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()], 10, 2)
    kept = spark.createDataFrame([x[:3] for x in want], "doc_id long, text string, n_lines long").select("doc_id", "n_lines", F.sha2("text", 256).alias("kept_sha256"))
    assert Counter(df.select("doc_id", "n_lines", "kept_sha256").collect()) == Counter(kept.collect())
