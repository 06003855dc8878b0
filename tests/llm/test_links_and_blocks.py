"""URL aliases over many links and long tags, and a benchmark of many blocks."""

import random
import time

from pyspark.sql import functions as F

from runlore.llm import decontamination, quality_model, url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def test_thousands_of_links_against_union_find(spark):
    """Chains, stars and rings of links in which rules decide whole verdicts."""
    rng = random.Random(2)
    n = 3000
    host = lambda i: ["a.example.com/en/", "www.example.com/en/", "x.net/es/", "y.net/fr/", "z.com/"][i % 5] if i % 41 < 2 else "plain.org/"
    urls = [f"http://{host(i)}p{i}" for i in range(n)]
    links = [(i, i + 1) for i in range(0, 900) if i % 30] + [(900 + 20 * (i // 20), 900 + i) for i in range(900)] + [(i, i - 7) for i in range(1900, 2200)]
    links += [(rng.randrange(2200, n), rng.randrange(2200, n)) for _ in range(500)]
    html = [""] * n
    for a, b in links:
        html[a] += f'<link rel="canonical" href="{urls[b]}">' if (a + b) % 2 else f"<META http-equiv=refresh content='0; url={urls[b]}'>"
    rule = lambda i: {"a.example.com/en/": "block", "www.example.com/en/": "allow", "x.net/es/": "block", "y.net/fr/": "block", "z.com/": "allow", "plain.org/": None}[host(i)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    by = {}
    for i in range(n):
        by.setdefault(find(i), set()).add(rule(i))
    want = {i: rule(i) or ("allow" if "allow" in by[find(i)] else "block" if "block" in by[find(i)] else "allow") for i in range(n)}
    pages = spark.createDataFrame([(i, urls[i], html[i]) for i in range(n)], "page_id long, url string, html string").repartition(5)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == want and sum(rule(i) is None and want[i] == "block" for i in range(n)) > 100


def test_long_tags_are_read_once(spark):
    names, spaces = "a" * 1_000_000, " " * 1_000_000
    tags = [f"<meta {names}>", f"<meta {names} >", f"<link {spaces}>", f"<meta {'x ' * 400_000}>", f"<meta {'x = ' * 200_000}>", f'<link {"a=1 " * 200_000} rel="canonical" href="http://x.net/fr/1">', "<link " * 100_000, f"<meta content='{'>' * 1_000_000}'>", '<meta a="' * 50_000]
    df = spark.createDataFrame([(i, f"http://h.org/{i}", t) for i, t in enumerate(tags)], "page_id long, url string, html string").repartition(1)
    url_filter.alias_links(df.where("page_id = 5")).collect()  # compiled
    began = time.time()
    links = url_filter.alias_links(df).collect()
    assert time.time() - began < 9 and [(r["src"], r["dst"]) for r in links] == [("http://h.org/5", "http://x.net/fr/1")]


def test_quoted_ends_of_tags(spark):
    html = ['<link title="a > b" rel=canonical href="/t">', "<link rel='canonical' title='<x>' href='/t'>", '<link rel="canonical" href="/t" title="open>', '<linked rel=canonical href="/no">', '<link rel="canonical"href="/t">', '<link xrel="canonical" href="/no">', '<link\nREL = "next canonical"\nHREF = "/t">']
    df = spark.createDataFrame([(i, "http://h.org/s", t) for i, t in enumerate(html)], "page_id long, url string, html string")
    got = {i: [r["dst"] for r in url_filter.alias_links(df.where(F.col("page_id") == i)).collect()] for i in range(len(html))}
    assert {i: x == ["http://h.org/t"] for i, x in got.items()} == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False, 6: True} and not got[3] and not got[5]


def test_many_blocks_write_hits_alone_and_find_the_same(spark, monkeypatch, tmp_path):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([6, 20, 40])))) for i in range(120)]
    docs = []
    for i in range(150):
        words = [word() for _ in range(60)]
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1].split()
            k = rng.randrange(len(item))
            part = [w if j % 9 != 8 or rng.random() < 0.5 else "swapped" for j, w in enumerate(item[k:])]
            at = rng.randrange(len(words))
            words[at:at] = part
        docs.append((i, " ".join(words), "x"))
    docs += [(500, docs[3][1], "copy"), (501, None, "null"), (502, "", "empty"), (None, docs[4][1], "no id")]
    d = spark.createDataFrame(docs, "doc_id long, text string, k1 string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted((str(r["doc_id"]), r["k1"], sorted((x["item_id"], x["start"], x["end"], x["matched"]) for x in r["overlaps"])) for r in df.collect())
    one = rows(decontamination.overlaps(d, b))
    assert sum(len(x[2]) > 0 for x in one) > 60
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)
    monkeypatch.setattr(decontamination, "CHAINED", 3)
    kept = []
    own = decontamination.written
    monkeypatch.setattr(decontamination, "written", lambda df, name, keep=False: (kept.append((name, df.columns)), own(df, name, keep))[1])
    out = decontamination.overlaps(d, b)
    assert out.columns == ["doc_id", "text", "k1", "overlaps"] and rows(out) == one
    assert len(kept) > 5 and all("text" not in c for _, c in kept)


def test_scores_without_rows_to_calibrate_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 4)
    scores = [r["score"] for r in quality_model.score_documents(docs, labels).collect()]
    assert len(set(scores)) > 20 and all(0 <= x <= 1 for x in scores)
    none = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert {r["score"] for r in quality_model.score_documents(docs, none).collect()} == {0.5}
