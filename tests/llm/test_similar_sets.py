"""Near-duplicates at a Jaccard similarity against brute force."""

from collections import Counter

import numpy as np
import pytest

from runlore.llm import simhash, similar_sets


def brute(rows, similarity=0.8, words=5):
    """doc_id: the least doc_id of its component, over all pairs."""
    sets = {i: set(simhash.shingle_hashes(t, words).tolist()) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    # All pairs' common shingles as products of 0/1 rows; a shingle of one set is in no product.
    times = Counter(x for own in sets.values() for x in own)
    place = {x: k for k, x in enumerate(x for x, n in times.items() if n > 1)}
    table = np.zeros((len(ids), len(place)), np.float32)
    for k, i in enumerate(ids):
        table[k, [place[x] for x in sets[i] if x in place]] = 1
    size = np.array([len(sets[i]) for i in ids])
    for k, i in enumerate(ids):
        same = table @ table[k]
        for j in np.flatnonzero(same >= similarity * (size + size[k] - same)):
            a, b = sorted((find(i), find(ids[j])))
            parent[b] = a
    return {i: find(i) for i in ids}


def components(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}


def text(rng, n):
    return [f"v{x}" for x in rng.integers(0, 10**6, n)]


def variant(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"x{rng.integers(10**6)}"
    return out


@pytest.mark.parametrize("spokes", [200, 2000])
def test_hub_and_spokes(spark, spokes):
    rng = np.random.default_rng(spokes)
    base = text(rng, 200)
    rows = [(5000, " ".join(base))] + [(i, " ".join(variant(rng, base, 4))) for i in range(spokes)]
    rows += [(6000 + i, " ".join(variant(rng, base, 30))) for i in range(60)]
    want = brute(rows)
    assert len({want[i] for i in range(spokes)}) == 1 and components(spark, rows) == want


def test_all_ways_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(8):
        base = text(rng, 60)
        for depth in (1, 1, 2, 2, 3, 3, 4):
            rows.append((len(rows), " ".join(variant(rng, base, depth))))
            base = variant(rng, base, 1)
    line = " ".join(text(rng, 12))
    rows += [(len(rows) + i, " ".join(text(rng, 20)) + "\n" + line) for i in range(30)]
    want = brute(rows)
    assert components(spark, rows) == want
    monkeypatch.setattr(similar_sets, "PAIRED", 2)
    for name, x in (("BLOCK", 4), ("SKETCH", 64), ("SLACK", 0)):
        monkeypatch.setattr(similar_sets, name, x)
    assert components(spark, rows) == want


def test_sketches_never_turn_away_a_link(spark):
    rng = np.random.default_rng(23)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 40, 300, 5000)]
    sets += [np.setdiff1d(s, rng.choice(s, len(s) // 9)) for s in sets]
    drawn = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, shingles binary")
    bits = {r["node"]: np.frombuffer(bytes(r["sketch"]), np.uint64) for r in similar_sets.sketches(drawn).collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= len(np.setxor1d(a, b))


def test_near_copies_outside_the_main_component(spark, monkeypatch):
    """Groups that share most of a base, some too far from it, so that only the comparison in blocks links them."""
    rng = np.random.default_rng(29)
    monkeypatch.setattr(similar_sets, "PAIRED", 8)
    monkeypatch.setattr(similar_sets, "BLOCK", 16)
    base = text(rng, 150)
    rows = [(i, " ".join(variant(rng, base, 2))) for i in range(40)]
    for group in range(12):
        far = variant(rng, base, 9)
        rows += [(100 + 10 * group + i, " ".join(variant(rng, far, 1))) for i in range(3)]
    want = brute(rows)
    assert len(set(want.values())) > 5 and components(spark, rows) == want


def test_equal_fingerprints_of_different_sets(spark):
    rng = np.random.default_rng(11)
    tail = "\n".join([" ".join(text(rng, 11))] * 400)
    rows = [(i, " ".join(text(rng, 300)) + "\n" + tail) for i in range(3)]
    rows.append((3, " ".join(variant(rng, rows[1][1].split("\n")[0].split(), 2)) + "\n" + tail))
    assert len({simhash.fingerprint(simhash.shingle_hashes(t, 5)) for _, t in rows}) < 4
    want = brute(rows)
    assert want == {0: 0, 1: 1, 2: 2, 3: 1} and components(spark, rows) == want


def test_repeated_lines_and_short_texts(spark):
    rng = np.random.default_rng(17)
    rows = []
    for more in (5, 10, 20):
        lines = [" ".join(text(rng, 12)) for _ in range(17)]
        rows += [(len(rows), "\n".join(lines)), (len(rows) + 1, "\n".join(lines + lines[3:4] * more))]
    for n in (1, 4, 5, 8, 9, 14):
        words = text(rng, n)
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words, "end"])), (len(rows) + 2, " ".join(words[:-1]))]
    rows.append((len(rows), None))
    want = brute(rows)
    assert want[1] == 0 and want[3] == 2 and want[5] == 4 and components(spark, rows) == want
