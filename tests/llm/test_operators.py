"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from runlore.llm import bpe, components, decontamination, pieces, quality_model, quality_rules, sharding, simhash, substring_dedup, token_files, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, fp long, __n long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, "  \n\t "), (5, "alpha beta gamma delta epsilon zeta"), (5, "alpha beta gamma delta epsilon zeta"), (None, "alpha beta gamma delta epsilon zeta"), (None, None),
    (7, "one"), (8, "ONE two"), (9, LONG), (10, "naïve café 漢字 😀 <|endoftext|> don't\r\n\x1c"), (5, "another text of the same id"), (11, "=" * 3000 + "a" * 3000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", 0, 9, 9, 9) for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# 1


def brute_passages(rows, least, within=False):
    """rows: (doc_id, text), ids distinct. What stays of each text, and the ranges of words that go with their keepers."""
    piece = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
    fold = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    words = {i: [fold(w) for w in WORD.findall(t or "")] for i, t in rows}
    units = {i: [" ".join(w[k : k + least]) for k in range(len(w) - least + 1)] for i, w in words.items()}
    first = {}
    for i in sorted(units):
        for k, u in enumerate(units[i]):
            first.setdefault(u, (i, k))
    out = {}
    for i, t in rows:
        ranges = []
        for k, u in enumerate(units[i]):
            if first[u][0] != i or (within and first[u] != (i, k)):
                if ranges and k <= ranges[-1][1]:
                    ranges[-1][1] = k + least
                else:
                    ranges.append([k, k + least, first[u][0]])
        pieces, gone = piece.findall(t or ""), {k for a, b, _ in ranges for k in range(a, b)}
        lead = len(t or "") - sum(map(len, pieces))
        out[i] = (t and t[:lead] + "".join(p for k, p in enumerate(pieces) if k not in gone), [tuple(r) for r in ranges])
    return out


def passages(df):
    return {r["doc_id"]: (r["text"], [(s["words"], s["keeper"]) for s in r["removed_spans"] or ()]) for r in df.collect()}


@pytest.mark.parametrize(("least", "within"), [(7, False), (50, False), (20, True)])
def test_passages_against_brute_force(docs, rows, least, within):
    want = brute_passages(list(rows.items()), least, within)
    assert passages(substring_dedup.dedup_passages(docs, least, within)) == {i: (t, [(b - a, k) for a, b, k in r]) for i, (t, r) in want.items()}


@pytest.mark.parametrize("least", [5, 12, 50])
def test_planted_passages_against_brute_force(spark, least):
    """Passages of about the least length, set anywhere in lines, with repeated words and passages of passages."""
    rng = np.random.default_rng(least)
    text = lambda n, v=10**6: " ".join(f"W{x}" for x in rng.integers(0, v, n))
    planted = [text(least + d) for d in (-1, 0, 1, 4, 20)] + [text(2 * least, 3), " ".join(["the"] * 3 * least)]
    planted.append(planted[0] + " " + planted[1])
    rows = []
    for i in range(120):
        parts = [text(int(rng.integers(0, 60))) for _ in range(3)]
        for _ in range(int(rng.integers(0, 3))):
            parts.insert(int(rng.integers(0, len(parts) + 1)), planted[rng.integers(len(planted))].swapcase() if rng.random() < 0.3 else planted[rng.integers(len(planted))])
        rows.append((i, str(rng.choice(["", " ", "\n"])) + str(rng.choice([" ", "\n", " \t "])).join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 120, 9)] + [(300, None), (301, "")]
    for within in (False, True) if least == 12 else (False,):
        want = brute_passages(rows, least, within)
        got = passages(substring_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), least, within))
        assert got == {i: (t, [(b - a, k) for a, b, k in r]) for i, (t, r) in want.items()}


def test_passages_keep_offsets(spark):
    passage = " ".join(f"Word{i}" for i in range(55))
    d = spark.createDataFrame([(1, f"é\n{passage}\nend"), (2, f"héad and {passage.upper()}  \ntail"), (3, passage), (4, f"a {passage}")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in substring_dedup.dedup_passages(d).collect()}
    assert out[1]["removed_spans"] is None and out[2]["text"] == "héad and tail" and out[3]["text"] == "" and out[4]["text"] == "a "
    s = out[2]["removed_spans"][0]
    assert (s["start"], s["size"], s["words"], s["keeper"]) == (9, len(passage) + 3, 55, 1)


def test_passages_odd(spark, odd, none):
    out = substring_dedup.dedup_passages(odd.withColumn("removed_words", F.lit("x")), 2)
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert sum(got.values()) == len(ODD) and got[5, ""] == 2 and got[None, ""] == 1 and got[None, None] == 1 and got[1, ODD[0][1]] == 1 and got[9, LONG] == 1 and got[4, ODD[3][1]] == 1
    assert substring_dedup.dedup_passages(none).count() == 0 and out.schema["removed_words"].dataType.simpleString() == "bigint"
    assert [c for c in out.columns if c not in ("removed_spans", "removed_words")] == odd.columns
    clash = spark.createDataFrame([(1, "x", 7, 8), (2, "x", 9, 10)], "doc_id long, text string, id2 long, key2 long")
    assert [tuple(r)[2:4] for r in substring_dedup.dedup_passages(clash, 1).orderBy("doc_id").collect()] == [(7, 8), (9, 10)]


# 2


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def test_urls(spark):
    link = lambda url: f'<head><LINK href="{url}" rel="canonical"></head>'
    pages = [
        (1, "http://a.example.com/en/x", None), (2, "http://WWW.example.com/en/x?q", ""), (3, "https://b.org/p", link("http://a.example.com/en/y")), (4, "https://c.org/q", '<meta http-equiv="refresh" content="0; url=https://b.org/p">'),
        (5, "https://d.org/r", link("http://x.com/ok")), (6, "nothing", None), (7, None, link("http://x.net/fr/")), (8, "https://e.org/dir/s", link("t")), (9, "https://e.org/dir/t#frag", link("//x.net/es/1")), (9, "https://e.org/dir/t#frag", link("//x.net/es/1")),
        (None, "http://y.net/es", None), (10, "https://f.org/1", link("https://g.org/1")), (11, "https://g.org/1", link("http://q.com/z") + link("http://w.net/fr/z")),
    ]
    p = spark.createDataFrame([(*x, "c") for x in pages], "page_id long, url string, html string, host string")
    r = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = defaultdict(list)
    for x in url_filter.judge_urls(p, r).collect():
        out[x["page_id"]].append((x["host"], x["path"], x["rule"], x["verdict"]))
    assert out[1] == [("a.example.com", "/en/x", "example.com/en/", "block")] and out[2] == [("www.example.com", "/en/x", "www.example.com/en/", "allow")]
    assert out[3][0][2:] == (None, "block") and out[4][0][2:] == (None, "block") and out[5][0][2:] == (None, "allow")
    assert out[6] == [("", "", None, "allow")] and out[7] == [("", "", None, "allow")] and out[8][0][3] == "block" and out[9] == [("e.org", "/dir/t", None, "block")] * 2
    assert out[None][0] == ("y.net", "/es", None, "allow") and out[10][0][3] == "allow" and out[11][0][3] == "allow"
    more = spark.createDataFrame([("nothing", "http://x.net/fr/a")], "src string, dst string")
    assert {x["page_id"]: x["verdict"] for x in url_filter.judge_urls(p, r, more).collect()}[6] == "block"
    assert url_filter.judge_urls(p.limit(0), r).count() == 0 and url_filter.judge_urls(p, r.limit(0)).where("verdict <> 'allow'").count() == 0


def test_one_spelling(spark):
    cases = {
        "http://B.org:80/p#x": "http://b.org/p", "HTTPS://b.org:443": "https://b.org/", "http://b.org:443/p": "http://b.org:443/p", "http://b.org?q=A/../b": "http://b.org/?q=A/../b", "http://b.org/a/./b/../c/..": "http://b.org/a/",
        "http://b.org/../../x": "http://b.org/x", "http://b.org/a/..b/.": "http://b.org/a/..b/", "no url#f": "no url", "http://": "http:///", None: None, "http://b.org/" + "a/../" * 300: "http://b.org/",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").withColumn("plain", url_filter.plain(F.col("url")))
    assert {r["url"]: r["plain"] for r in df.collect()} == cases


def test_links_of_pages(spark):
    link = lambda url: f'<link rel="canonical" href="{url}">'
    pages = [
        ("http://a.org/1", link("http://B.org:80/p"), "http://b.org/p"), ("http://a.org/2", '<link data-rel="canonical" data-href="http://x.org/" rel="next" href="http://y.org/">', None), ("http://a.org/3", f"<!-- {link('http://x.org/')} -->", None),
        ("http://a.org/4", f"<script>var s = '{link('http://x.org/')}'</script>" + link("/q"), "http://a.org/q"), ("http://a.org/5", '<link title=\'rel="canonical" href="http://x.org/"\' REL=canonical HREF=../z>', "http://a.org/z"),
        ("http://a.org/6", "<!-- " + link("http://x.org/"), None), ("http://a.org/" + "long/" * 20_000, "x" * 300_000 + link("http://b.org"), "http://b.org/"), ("http://a.org/8", '<linker rel="canonical" href="http://x.org/">', None),
    ]
    got = {r["src"]: r["dst"] for r in url_filter.alias_links(spark.createDataFrame(pages, "url string, html string, want string")).collect()}
    assert got == {u: w for u, _, w in pages if w}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000 + i) for i in range(300)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    assert set(got) == set(parent)
    pairs = {(find(n), r) for n, r in got.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# 3


def test_overlaps(spark):
    words = [f"tok{i}" for i in range(3000)]
    item = words[:40]
    swapped = [w if i % 7 else "other" for i, w in enumerate(item)]
    short = ["Who", "was", "it", "then", "there", "really"]
    texts = [" ".join(["x"] * 5 + item + ["y"] * 9), " ".join(words[100:160] + swapped + ["z"]), " ".join(item[:12]), " ".join(["a", "b", *short, "c"]).upper(), "who was it then", None, "", " ".join(words[200:]), "-- ".join(item[20:34]), " ".join(item[::2])]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1)], "doc_id long, text string, overlaps int")
    b = spark.createDataFrame([(1, " ".join(item)), (2, "Who was it, then? There, really!"), (3, "a b"), (4, None), (None, " ".join(words[200:240])), (5, "")], "item_id long, text string")
    out = {r["doc_id"]: [tuple(x) for x in r["overlaps"]] for r in decontamination.overlaps(d, b).collect()}
    assert out[0] == [(1, 5, 45, 40)] == out[None] and out[3] == [(2, 2, 8, 6)] and out[8] == [(1, 0, 14, 14)]
    assert out[1][0][0] == 1 and out[1][0][3] >= 30 and all(not out[i] for i in (2, 4, 5, 6, 7, 9))
    kept = decontamination.decontaminate(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {2, 4, 5, 6, 7, 9}
    assert decontamination.overlaps(d, b.limit(0)).where("size(overlaps) > 0").count() == 0 and decontamination.overlaps(d.limit(0), b).count() == 0


def test_overlaps_in_blocks(spark, docs, monkeypatch):
    b = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    find = lambda: {r["doc_id"]: sorted(map(tuple, r["overlaps"])) for r in decontamination.overlaps(docs.select("doc_id", "text"), b).collect()}
    whole = find()
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 500)
    monkeypatch.setattr(decontamination, "PIECE", 300)
    assert find() == whole
    # Brute force: 13 words in a row of an item.
    split = lambda t: re.findall(r"[0-9a-z\x80-￿]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    known = set().union(*(grams(split(r["text"])) for r in b.collect()))
    hit = {r["doc_id"] for r in docs.collect() if grams(split(r["text"])) & known}
    assert hit and hit <= {k for k, v in whole.items() if v}


# 4


def test_crc32c():
    def slow(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (token_files.POLYNOMIAL if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    data = [bytes(range(n % 256)) * (1 + n // 256) for n in [*range(70), 255, 256, 1000, 5000]]
    assert token_files.crc32c(data).tolist() == [slow(d) for d in data] and token_files.crc32c([b"123456789"])[0] == 0xE3069283
    framed = token_files.framed(data)
    assert token_files.payloads_of(framed, "x") == data
    with pytest.raises(ValueError):
        token_files.payloads_of([framed[20][:-5] + b"\x00" + framed[20][-4:]], "x")


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_token_files(request, spark, table, tmp_path):
    from tokenizers import Tokenizer

    d = request.getfixturevalue(table)
    path = P.path("byte_bpe_50k.json")
    out = f"file://{tmp_path}/t"
    token_files.write_token_files(d, out, path, partitions=5)
    got = token_files.read_token_files(spark, out).orderBy("start").collect()
    t = Tokenizer.from_file(path)
    want = [(r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in d.collect()]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    total = 0
    for r in got:
        assert r["start"] == total
        total += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_strings_of_added_tokens():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    whole, own = Tokenizer.from_file(path), token_files.LibraryModel(path, "<u4")
    for text in ("a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|>x", "<|endoftext", "a <|endoftext|>\n\nb  c"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_of_all_bytes():
    """Every byte that UTF-8 texts can have, alone and beside others, as the library itself encodes it."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    letters = [chr(i) for i in (*range(0x800), *range(0x800, 0xD800, 97), *range(0xE000, 0x110000, 4111))]
    texts = [*letters, "".join(letters), " ".join(letters), "a".join(letters), "  \n \t x\u00a0 y\r\n\r\n  ", "it's we'LL 12 345  ---!? "]
    for kind in ("<u2", "<u4"):
        own = token_files.LibraryModel(path, kind)
        assert all(np.frombuffer(own.encode(t), kind).tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts)


def test_token_files_empty(none, spark, tmp_path):
    assert token_files.write_token_files(none, f"file://{tmp_path}/t", P.path("byte_bpe_50k.json")).count() == 0
    assert token_files.read_token_files(spark, f"file://{tmp_path}/t").count() == 0


# 5


def test_bundles(spark, tmp_path):
    pages = [(1, "http://a/1", "same"), (2, "http://a/2\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", "x" * 5000), (6, "u: v", "é😀\r\n\r\nWARC/1.1"), (None, "n", "same"), (2, "http://a/2", "same"), (7, "u", "single")]
    p = spark.createDataFrame([(*x, "k") for x in pages], "page_id long, url string, html string, holder string").repartition(2)
    out = f"file://{tmp_path}/w"
    index = warc.write_bundles(p, out, frame_bytes=600).collect()
    rows = warc.read_bundles(spark, out).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    want = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        top = max(k or -1 for k, _, h in pages if (h or "") == (html or ""))
        response = i == top
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top] += 1
    assert got == want and {bytes(r["payload"]) for r in rows if r["payload"] is not None} == {b"same", b"", b"x" * 5000, "é😀\r\n\r\nWARC/1.1".encode(), b"single"}
    for r in index:
        headers, block = warc.read_record_at(r["file"], r["frame"], r["offset"])
        assert headers["WARC-Record-ID"] == f"<{r['record_id']}>" and headers["WARC-Type"] == r["record_type"]
    assert max(r["frame"] for r in index) > 0
    assert warc.write_bundles(p.limit(0), out + "2").count() == 0 and warc.read_bundles(spark, out + "2").count() == 0
    assert {r["record_type"] for r in warc.write_bundles(p, out + "3", least_bytes=5).where("page_id in (1, 2)").collect()} == {"response"}


def test_record_ids_name_one_record(spark, tmp_path):
    """Pages that share an id, or have none, with equal and other payloads: every id is one record's, and what a revisit
    names is a response that holds its payload."""
    pages = [(i, "u", h) for i in (None, 1, 1, 7, 7, 7) for h in ("a", "b", "a", f"own {i}")]
    out = f"file://{tmp_path}/w"
    index = warc.write_bundles(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), out, frame_bytes=2000).collect()
    places = {r["record_id"]: r for r in index}
    assert len(places) == len(index) == len(pages)
    revisits = [r for r in index if r["record_type"] == "revisit"]
    assert len(revisits) == 3 * 3  # of none, 1 and 1, the two "a" and the "b"; the own of 1 and 7 repeat one page
    for r in revisits:
        headers, _ = warc.read_record_at(r["file"], r["frame"], r["offset"])
        named = places[headers["WARC-Refers-To"].strip("<>")]
        other, block = warc.read_record_at(named["file"], named["frame"], named["offset"])
        assert named["record_type"] == "response" and named["page_id"] == r["refers_to"] == 7
        assert other["WARC-Payload-Digest"] == headers["WARC-Payload-Digest"] == f"sha1:{warc.digest_of(block.partition(b'\r\n\r\n')[2])}"
    assert {r["page_id"] for r in warc.read_bundles(spark, out).collect()} == {None, 1, 7}


# 6


def brute_fingerprint(text, k):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, k):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = defaultdict(list)
    for i, g in zip(ids, group, strict=True):
        least[g].append(i)
    return [min((x for x in least[g] if x is not None), default=None) for g in group]


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_simhash(request, table):
    d = request.getfixturevalue(table)
    data = [(r["doc_id"], r["text"]) for r in d.collect()]
    fps = [brute_fingerprint(t, 3) if t != LONG else simhash.fingerprint(simhash.shingle_hashes(t, 3)) & (1 << 64) - 1 for _, t in data]
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(d, 3, 2).collect())
    assert got == Counter(zip([i for i, _ in data], fps, brute_components([i for i, _ in data], fps, 2), strict=True))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_links_of_crowded_fingerprints(spark, monkeypatch, k):
    """Bits that depend on each other, and buckets far over the limit for pairs."""
    monkeypatch.setattr(simhash, "PAIRED", 4)
    rng = np.random.default_rng(k)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = sorted({int(b) ^ sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 5))) for b in base for _ in range(40)})
    d = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(r["src"] & (1 << 64) - 1, r["dst"] & (1 << 64) - 1) for r in simhash.links(d, k).collect()]
    assert all(0 < (a ^ b).bit_count() <= k for a, b in edges)
    at = {f: i for i, f in enumerate(fps)}
    group = list(range(len(fps)))
    for a, b in edges:
        x, y = group[at[a]], group[at[b]]
        group = [y if g == x else g for g in group]
    first = [group.index(g) for g in group]
    assert first == brute_components(list(range(len(fps))), fps, k)


def test_thresholds_cover_all_distances():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64))
    for k in range(4):
        plan = simhash.plan_partitions(500, (bits.T @ bits).astype(float), k)
        assert sorted(b for g, _ in plan for b in g) == list(range(64)) and sum(t + 1 for _, t in plan) == k + 1


def test_shared_parts(spark, none):
    rng = np.random.default_rng(5)
    text = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    rows, near = [], []
    for i in range(30):
        words = text(300)
        other = list(words)
        for at in rng.choice(300, 4, replace=False):  # at most 20 of 296 shingles on either side: a similarity of 0.87 or more
            other[at] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        near.append(2 * i)
    common = " ".join(text(60))
    rows += [(100 + i, common + " " + " ".join(text(200))) for i in range(10)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    assert all(got[i + 1] == i for i in near) and all(got[100 + i] == 100 + i for i in range(10))
    assert simhash.near_duplicates(none, similarity=0.8).count() == 0


# 7


@pytest.mark.parametrize("table,shards", [("odd", 16), ("docs", 16), ("docs", 3)])
def test_shards(request, table, shards):
    d = request.getfixturevalue(table)
    out = sharding.assign_shards(d, shards).collect()
    data = [(r["doc_id"], r["text"] or "") for r in d.collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in data)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < shards
    sizes = [len(slots.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    spread = defaultdict(set)
    for r in out:
        spread[r["group"]].add(r["shard"])
    cut = sum(len(s) - 1 for s in spread.values())
    assert cut < shards


def test_moves_keep_counts_and_cut_less(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, int(rng.integers(0, 60)), 0, i % 8) for i in range(480)], "row long, g1 long, g2 long, shard int")
    cut = lambda x: x.groupBy("g1").agg(F.count_distinct("shard").alias("n")).agg(F.sum("n")).first()[0]
    after = sharding.moved(rows)
    assert {r["shard"]: r["count"] for r in after.groupBy("shard").count().collect()} == dict.fromkeys(range(8), 60)
    assert cut(after) < cut(rows)


def test_shards_empty(none):
    assert sharding.assign_shards(none).count() == 0


# 8


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_base_statistics(request, table, spark):
    d = request.getfixturevalue(table).select("doc_id", "text", "lang")
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality_rules.judge(d, spark.createDataFrame([], "doc_id long, quality int")).collect())
    want = Counter()
    for r in d.collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(windows)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len({i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(5)})] += 1
    assert got == want


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 10, 0.1), (3, 50, 0.1), (9, 200, 0.1), (1, 5000, 0.1), (450, 5000, 0.1), (60, 100, 0.1)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        want = 1.0 if k >= n * p else sum(comb(n, i) * (p**i) * ((1 - p) ** (n - i)) for i in range(k + 1)) if n <= 200 else float(sum(comb(n, i) * 1**i * 9 ** (n - i) for i in range(k + 1)) * 10**40 // 10**n) / 1e40
        assert abs(got - want) <= 1e-9 * max(want, 1e-12) + 1e-30, (k, n)


def test_cutoffs_control_false_rejection(spark):
    words = lambda i, mark: " ".join(f"word{i}{j}{'***' if mark else ''}" for j in range(30))
    rows = [(i, words(i, i % 5 == 0 or i % 1500 == 7), "en" if i < 6000 else "fr", int(i % 5 > 0)) for i in range(6030)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    out = quality_rules.judge(d, d.select("doc_id", "quality")).join(d.select("doc_id", "lang", "quality"), "doc_id")
    c = {(r["lang"], r["quality"], r["kept"]): r["count"] for r in out.groupBy("lang", "quality", "kept").count().collect()}
    assert c["en", 0, False] == 1200 and c["en", 1, False] <= 0.01 * 4800 and ("fr", 1, False) not in c and ("fr", 0, False) not in c


def test_rules_odd(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (5, None), (5, 0), (5, 1)], "doc_id long, quality int")
    out = quality_rules.judge(odd, labels)
    assert out.count() == len(ODD) and {r["doc_id"] for r in out.where("kept").collect()} == {9}
    assert quality_rules.judge(none, labels).count() == 0


# 9


def test_bpe_against_library(rows):
    import tiktoken

    own = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = np.random.default_rng(2)
    tokens = list(own.ranks)
    made = [b"".join(tokens[i] for i in rng.integers(0, len(tokens), 20)).decode("utf8", "ignore") for _ in range(300)]
    made += ["".join(rng.choice(list("abcdé漢😀 =!\n"), 150)) for _ in range(100)]
    for t in [*rows.values(), *(t for _, t in ODD), *made, *(m.replace(" ", "") for m in made)]:
        ids = own.encode(t or "")
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t or "") and own.decode(ids) == (t or "").encode()
    assert pieces.SPLIT == P.PATTERN


def test_bpe_rows(odd, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode_documents(odd, path, P.PATTERN).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in out) == Counter((i, t or "") for i, t in ODD) and all(r["n_tokens"] * 4 == len(r["ids"]) for r in out)
    assert bpe.encode_documents(none, path, P.PATTERN, digests=True).count() == 0


# 10


def test_quality_scores(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_model.score_documents(d, labels).join(labels, "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9 and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    # Held-out labels teach nothing.
    flipped = labels.withColumn("quality", F.when(quality_model.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_model.score_documents(d, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(again[out.doc_id].to_numpy(), out.score.to_numpy())


def test_quality_odd(odd, none, spark):
    labels = spark.createDataFrame([(None, 1), (1, None), (99, 1)], "doc_id long, quality int")
    out = quality_model.score_documents(odd, labels).collect()
    assert len(out) == len(ODD) and {r["score"] for r in out} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(1, 0), (9, 1)], "doc_id long, quality int")
    assert quality_model.score_documents(odd, some).where("score between 0 and 1").count() == len(ODD) and quality_model.score_documents(none, some).count() == 0


def test_isotonic():
    knots, levels = quality_model.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4))
    assert knots.tolist() == [0, 1, 2, 3] and np.allclose(levels, [0.1, 0.4, 0.4, 0.9])
