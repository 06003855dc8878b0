"""The prefix trie against brute force over all prefixes."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runlore.llm import conversation_trie, parens


@pytest.mark.parametrize(("n", "bias"), [(1, 0.5), (2, 0.5), (32, 0.9), (33, 0.1), (500, 0.5), (5000, 0.7), (20_000, 0.5)])
def test_findclose_against_a_stack(n, bias):
    rng = np.random.default_rng(n)
    bits, depth, opened = [True], 1, 1
    while opened < n:
        up = depth == 1 or rng.random() < bias
        bits.append(up)
        depth, opened = depth + (1 if up else -1), opened + up
    bits = np.array(bits + [False] * depth)
    stack, close = [], {}
    for i, x in enumerate(bits):
        if x:
            stack.append(i)
        else:
            close[stack.pop()] = i
    opens = np.flatnonzero(bits)
    trie = parens.BalancedParens(bits)
    assert trie.findclose(opens).tolist() == [close[i] for i in opens]
    assert trie.subtree_ends().tolist() == [(close[i] - i + 1) // 2 + k for k, i in enumerate(opens)]
    assert trie.childless().tolist() == [close[i] == i + 1 for i in opens]


def brute(rows, rebuild=True):
    """rows: (conv_id, turn, role, text) without ties of turns."""
    turns = defaultdict(list)
    for c, n, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns[c].append((role or "", text or ""))
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + own[h:] if rebuild else own
    nodes = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    children, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            below[k[:d]][0] += not children.get(k)
            below[k[:d]][1] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    out = Counter()
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(k)))
        out[min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children.get(k, 0), *below[k], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def made(rng, n, roles=("user", "assistant", None)):
    rows = []
    for c in range(n):
        for turn in range(rng.integers(1, 12)):
            rows.append((c, None if turn == 0 and c % 3 == 0 else turn, roles[turn % 3], str(rng.choice(["", "hi", "höre zu", "a longer turn of text"])) if turn % 4 else None))
    return rows


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("nodes", "fan", "partitions"), [(200_000, 256, 1), (12, 2, 9), (1, 3, 30), (40, 256, 7)])
def test_against_brute_force(spark, monkeypatch, nodes, fan, partitions):
    """Small encodings and many shards, so that spines are merged over several levels."""
    monkeypatch.setattr(conversation_trie, "FAN", fan)
    monkeypatch.setattr(conversation_trie, "CHUNK", 5)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = made(np.random.default_rng(nodes), 300)
        rows += [(1000 + c, 0, "user", "a hot first turn") for c in range(150)] + [(1000 + c, 1, "assistant", f"answer {c % 40}") for c in range(0, 150, 2)]  # of a third of all
        rows += [(2000, k, "user", f"turn {k}") for k in range(300)] + [(2005, k, "user", f"turn {k}") for k in range(299)]  # long ones
        df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
        assert got(conversation_trie.prefix_trie(df, conversation_trie.rebuilt, nodes)) == brute(rows)
        assert got(conversation_trie.prefix_trie(df, None, nodes)) == brute(rows, False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "user", "y"), (-7, 3, None, None), (-7, None, "user", "first"), (4, 1, "u", "t"), (4, 1, "u", "t"), (12, 0, "r", "z" * 300_000), (13, 0, "r", "z" * 300_000), (9, 2, "ab", "c"), (8, 2, "a", "bc")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert got(conversation_trie.prefix_trie(df)) == brute(rows, False)
    assert conversation_trie.prefix_trie(df.limit(0)).count() == 0
    none = df.where("conv_id is null")
    assert conversation_trie.prefix_trie(none).count() == 0
    one = [(3, 0, "user", "x")]
    assert got(conversation_trie.prefix_trie(spark.createDataFrame(one, df.schema), conversation_trie.rebuilt)) == brute(one)
