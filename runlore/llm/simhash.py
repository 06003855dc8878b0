"""SimHash near-duplicates found by the generalised pigeonhole principle (operator 6).

Fingerprints are 64 bits of shingle majorities. For links at k or fewer differing bits, the bits are dealt into m
partitions with thresholds t_1..t_m, where the sum of (t_i + 1) is k + 1: two linked fingerprints then differ by at most
t_i bits in some partition i. Correlated bits go into one partition, which leaves the others selective. m and the
thresholds come from a dynamic programme over estimated candidate counts. A partition is probed under masks that leave
out every choice of t_i of its bits; what meets in a bucket is verified on the whole fingerprint.

Equal fingerprints are one class before anything is joined, so copies cost nothing. A bucket of many classes is not
paired out: its members are keyed by all points within half of k bits, as two of them are linked exactly if they share
one, and what shares a point is linked to the least of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import scratch, session_setup, text_key, written
from runlore.llm.components import connected_components
from runlore.llm.similar_sets import set_nodes, similar_components

BITS = 64
SEED = 42
#: A bucket of up to so many fingerprints is compared pair by pair; larger ones go by shared points. Both are exact.
PAIRED = 48
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 15


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included, in order."""
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[i : i + BLOCK]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, key (of the text), fp: one row for each row of docs. Null or blank text: fingerprint zero."""
    session_setup(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each two bits are both set: 64 rows from each task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        n = 0
        for b in batches:
            part = b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            for i in range(0, len(part), BLOCK):
                bits = np.unpackbits(part[i : i + BLOCK], axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
            n += len(part)
        if n:
            cols = [pa.array([n] * BITS, pa.int64()), pa.array(range(BITS), pa.int32()), *(pa.array(both[:, j].astype(np.int64)) for j in range(BITS))]
            yield pa.RecordBatch.from_arrays(cols, ["n", "i", *(f"c{j}" for j in range(BITS))])

    rows = fps.select("fp").mapInArrow(run, "n long, i int, " + ", ".join(f"c{j} long" for j in range(BITS)))
    found = rows.groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(f"c{j}").alias(f"c{j}") for j in range(BITS))).collect()  # 64 rows
    out = np.zeros((BITS, BITS))
    for r in found:
        out[r["i"]] = [r[f"c{j}"] for j in range(BITS)]
    return (found[0]["n"] if found else 0), out


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m partitions of nearly equal size; each is grown around a bit by the strongest mean correlation."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    strength = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(strength, 0)
    left, out = set(range(BITS)), []
    for i in range(m):
        size = len(left) // (m - i)
        free = sorted(left)
        group = [free[int(strength[np.ix_(free, free)].sum(1).argmax())]]
        while len(group) < size:
            free = sorted(left - set(group))
            group.append(free[int(strength[np.ix_(free, group)].mean(1).argmax())])
        left -= set(group)
        out.append(sorted(group))
    return out


def within(differ: np.ndarray, most: int) -> list[float]:
    """The chance that two fingerprints differ in at most 0, 1, .. most of the bits, each with its own chance to differ."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return np.cumsum(chance).tolist()


def plan_partitions(n: int, both: np.ndarray, k: int) -> list[tuple[list[int], int]]:
    """Partitions of bits with their thresholds, -1 for a partition that is not probed. For each number of partitions, a
    dynamic programme deals out the thresholds so that the estimated rows, those probed and those met, are fewest."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, k + 2):
        groups = correlated_groups(n, both, m)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            chance, nxt = within(differ[g], k), {}
            for spent, (cost, ts) in table.items():
                for t in range(-1, k - spent + 1):
                    if t > len(g):
                        continue
                    masks = len(list(combinations(g, t))) if t >= 0 else 0
                    more = n * masks + n * n / 2 * chance[t] if t >= 0 else 0.0
                    now = (cost + more, [*ts, t])
                    if spent + t + 1 not in nxt or now < nxt[spent + t + 1]:
                        nxt[spent + t + 1] = now
            table = nxt
        if k + 1 in table and (best is None or table[k + 1][0] < best[0]):
            best = (table[k + 1][0], list(zip(groups, table[k + 1][1], strict=True)))
    assert best is not None
    return best[1]


FULL = (1 << BITS) - 1


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def links(fps: DataFrame, k: int) -> DataFrame:
    """src, dst: edges between different fingerprints at k or fewer differing bits, enough of them to give the same
    components as all. fps: distinct fp. k is at most 3: beyond that the bits no longer select."""
    if not 0 <= k <= 3:
        raise ValueError("max_distance must be 0 to 3")
    spark = fps.sparkSession
    n, both = bit_statistics(fps)
    masks = [(i, _mask(set(g) - set(out))) for i, (g, t) in enumerate(plan_partitions(n, both, k)) if t >= 0 for out in combinations(g, t)]
    probes = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(m).cast("long").alias("mask")) for j, (_, m) in enumerate(masks)))
    keyed = fps.select("fp", F.explode(probes).alias("p")).select("fp", "p.j", F.col("fp").bitwiseAND(F.col("p.mask")).alias("bucket"))
    keyed = written(keyed, "probes")
    many = keyed.groupBy("j", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(many, ["j", "bucket"]), "met")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= k
    small = met.where(F.col("n") <= PAIRED).groupBy("j", "bucket").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = small.select(F.explode("fps").alias("src"), "fps").select("src", F.explode(F.filter("fps", lambda x: (x > F.col("src")) & near(x, F.col("src")))).alias("dst"))
    # The wide way, without pairs. Two fingerprints that differ in 2r bits or fewer have a point within r bits of both,
    # and all that have one are linked. An odd k leaves out one bit first.
    free = [(0, range(BITS))] if k % 2 == 0 else [(1 << b, [x for x in range(BITS) if x != b]) for b in range(BITS)]
    points = [(~hole & FULL, sum(1 << b for b in flips)) for hole, bits in free for r in range(k // 2 + 1) for flips in combinations(bits, r)]
    around = F.array(*(F.struct(F.lit(_signed(h)).cast("long").alias("hole"), F.lit(_signed(f)).cast("long").alias("flip")) for h, f in points))
    large = met.where(F.col("n") > PAIRED).select("fp").distinct()
    large = large.select("fp", F.explode(around).alias("a")).select("fp", "a.hole", F.col("fp").bitwiseAND(F.col("a.hole")).bitwiseXOR(F.col("a.flip")).alias("point"))
    least = large.groupBy("hole", "point").agg(F.min("fp").alias("src"), F.max("fp").alias("top")).where("src < top").drop("top")
    starred = large.join(least, ["hole", "point"]).where("fp <> src").select("src", F.col("fp").alias("dst"))
    return pairs.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, max_distance: int = 2, similarity: float | None = None) -> DataFrame:
    """doc_id, key, fp, root (a fingerprint that stands for the component) and component_id (the least doc_id that linked
    fingerprints reach), one row for each row of docs.

    A null or blank text has fingerprint zero and links like any other. Fewer words than a shingle: the whole sequence
    is one. Null doc_ids take part and get a component, but are never its least unless all are null. Repeated rows and
    ties share their component. An empty table gives an empty one. Other columns are ignored.
    similarity: link by the Jaccard similarity of the sets of shingles instead (see similar_sets): pairs within max_distance
    are candidates that are verified, and an exact join adds what they leave out. fp is then a digest of the set, so that
    only equal sets are one without a comparison.
    """
    with scratch(docs.sparkSession):
        if similarity is not None:
            rows, nodes = set_nodes(docs, words, similarity)
            classes = nodes.select(F.col("node").alias("fp"), "least")
            roots = similar_components(docs, nodes, words, similarity, max_distance).withColumnRenamed("node", "fp")
        else:
            rows = written(fingerprints(docs, words), "fingerprints")
            classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
            roots = connected_components(links(classes, max_distance)).withColumnRenamed("node", "fp")
        of = written(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
        least = written(of.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        classes = written(of.join(least, "root").select("fp", "root", "component_id"), "classes")
        return written(rows.join(classes, "fp"), "groups", keep=True)
