"""Boundary sets against lists, and the transformation against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlore.llm import boundaries, fill_in_middle, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("text", ["", "a", " ", "a ", " \n", "a b\tc\n", "x" * 70_000, "a " * 40_000, " " * 65_536 + "a", "a" * 65_535 + " b", "a" * 65_536 + " b", "a" * 65_536 + "b c", " " * 200_000, "é 漢😀 \x1c" * 30_000, ("a" * 30 + " ") * 9000])
def test_boundaries_are_those_of_the_pattern(text):
    ends = [m.end() for m in TOKEN.finditer(text)]
    places = boundaries.BoundarySet(text)
    assert len(places) == len(ends) and places.offset(0) == 0
    step = max(1, len(ends) // 997)
    assert all(places.offset(k + 1) == ends[k] for k in [*range(0, len(ends), step), len(ends) - 1] if ends)


def test_each_container_selects():
    rng = np.random.default_rng(0)
    few, many, runs = (np.sort(rng.choice(65_536, 900, replace=False)), np.sort(rng.choice(65_536, 30_000, replace=False)), np.r_[100:9000, 20_000:60_000, 65_535])
    for low, kind in ((few, boundaries.ArrayContainer), (many, boundaries.BitmapContainer), (runs, boundaries.RunContainer)):
        made = boundaries.container(low)
        assert type(made) is kind and [made.select(k) for k in range(len(low))] == low.tolist()


def brute(i, text, rate=50, spm_rate=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = [int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm_rate else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = [(None, "no id at all"), (None, None), (1, None), (2, ""), (3, " \n"), (4, "has <P> in it"), (5, "<<S>"), (6, "ends with <"), (7, "<S <M < P> <"), (7, "another of the same id"), (7, "another of the same id"), (8, "long " * 60_000), (9, "naïve 漢字 😀\x1c　 x")]


@pytest.mark.parametrize("spm_rate", [0, 80, 100])
def test_against_brute_force(spark, spm_rate):
    rng = np.random.default_rng(3)
    rows = ODD + [(i, "".join(rng.choice(list("ab <PSM>\n漢"), rng.integers(0, 60)))) for i in range(100, 400)]
    df = spark.createDataFrame([(*r, "u", 1, 2) for r in rows], "doc_id long, text string, form string, id int, `a b` int").repartition(3)
    out = fill_in_middle.fill_in_middle(df, rate=90, spm_rate=spm_rate)
    assert out.columns == ["doc_id", "text", "id", "a b", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted([tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()], key=key)
    assert got == sorted([brute(*r, 90, spm_rate) for r in rows], key=key)
    assert out.where(fill_in_middle.restored(F.col("output"), F.col("form")) != F.coalesce("text", F.lit(""))).count() == 0
    assert out.where("form <> 'plain'").count() > 100


def test_empty_tables_and_markers(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle.fill_in_middle(none).count() == 0
    for markers in (("<P>", "<P>", "<M>"), ("<P>", "<P>S", "<M>"), ("P", "<S>", "<M>")):
        with pytest.raises(ValueError, match="markers"):
            fill_in_middle.fill_in_middle(none, markers=markers)
    own = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    out = fill_in_middle.fill_in_middle(spark.createDataFrame([(i, f"text number {i} <P>") for i in range(50)], "doc_id long, text string"), rate=100, markers=own)
    assert out.where(fill_in_middle.restored(F.col("output"), F.col("form"), own) != F.col("text")).count() == 0 and out.where("form = 'plain'").count() == 0


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {r[0]: (*r[1:5], sha(r[5]), sha(t or "")) for (_, t), r in ((d, brute(*d)) for d in docs)}
    assert {r[0]: tuple(r)[1:] for r in queries.op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect()} == want
