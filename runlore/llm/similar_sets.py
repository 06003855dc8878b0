"""Components of texts at a Jaccard similarity of their shingle sets: SimHash candidates, then an exact check that misses
no link (the pipeline's near-duplicates).

Equal sets are one node, named by a digest of the set. Candidates are those of the SimHash pigeonhole (fingerprints of the
sets) and those of a prefix-filtered join: shingles have one global order, and two sets of that similarity share a shingle
of their prefixes, the first n - s * n + 1 of n. Any order is right: shingles that are common in prefixes come last, the
others by hash, so that frequent lines leave the prefixes. Every candidate is verified on whole sets.

A shingle that few prefixes share gives all its pairs. Of one that many share only the components matter: every set is
first compared with a pivot, the set with the largest share of common shingles (the base of a group of variants). Sets
that are then outside the main component of their shingle are compared with all that share it, in blocks, by sketches: the
parity of a set's shingles in each of SKETCH slots. Two sketches differ in no more slots than their sets have different
shingles, so what a sketch turns away cannot be similar, and no pair is written that it turns away.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import scratch, session_setup, text_key, written
from runlore.llm.components import connected_components
from runlore.llm.words import run_hashes, word_hashes

#: A shingle that up to so many prefixes share is paired out; of more, sets go by pivots first. Both are exact.
PAIRED = 48
#: Sets in a block of sketches that are compared at once.
BLOCK = 4096
#: Slots of a sketch. More turn away more; the result does not depend on it.
SKETCH = 2048
#: Shingles that are kept beyond a set's prefix, so that the prefix is still known when common ones move to the end.
SLACK = 16
#: Slots of the filters: a few hundred KB, whatever the data.
SLOTS = 1 << 22


def slots_of(keys: DataFrame) -> np.ndarray:
    """A bit for each slot that a key of keys falls into: at most SLOTS / 32768 rows come to the driver."""
    slot = F.pmod(F.col("key"), F.lit(SLOTS))
    found = keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(SLOTS + (1 << 15), bool)
    for r in found:
        # Buckets count from 1 and hold values from 1 on; slot 0 is in bucket 0's last place.
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        first = (r["b"] - 1) * len(bits) + 1
        at = np.flatnonzero(bits) + first
        out[at[(at >= 0) & (at < len(out))]] = True
        if r["b"] <= 0:
            out[0] = True
    return out


def prefix_length(n: int, similarity: float) -> int:
    """How many of n shingles in order: a set that shares none of them shares too few."""
    return n - max(1, math.ceil(similarity * n - 1e-9)) + 1 if n else 0


def prefix(own: np.ndarray, similarity: float, late: np.ndarray | None = None) -> np.ndarray:
    """The prefix of an ascending set of hashes; those in a late slot come after all others."""
    n = prefix_length(len(own), similarity)
    if late is None:
        return own[:n]
    last = late[(own & np.uint64(SLOTS - 1)).astype(np.int64)]
    return np.concatenate([own[~last][:n], own[last]])[:n]


def settled(known: np.ndarray, n: int, similarity: float, late: np.ndarray) -> np.ndarray | None:
    """The prefix of a set of n hashes of which the first ones are known; None if these are too few to tell."""
    p = prefix_length(n, similarity)
    out = prefix(known, 0, late)[:p]  # of similarity 0 the prefix is the whole
    return out if len(known) == n or len(known) - late[(known & np.uint64(SLOTS - 1)).astype(np.int64)].sum() >= p else None


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The ascending hashes of a text's distinct shingles; of fewer words, of the whole sequence."""
    own = word_hashes(text)
    return np.unique(run_hashes(own, min(words, len(own)))) if len(own) else own


def set_rows(docs: DataFrame, words: int, similarity: float, late=None, asked=None, whole: bool = False) -> DataFrame:
    """doc_id, key, node (a digest of the set of shingles), n (its size), and fp (its fingerprint) with its prefix and some
    more or, if whole, the set's bytes: one row for each row of docs, or of those whose key is in an asked slot. late,
    asked: broadcast slots."""
    from runlore.llm.simhash import fingerprint

    session_setup(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if asked is not None:
                b = b.take(pa.array(np.flatnonzero(asked.value[b.column(1).to_numpy(zero_copy_only=False) % SLOTS])))
            sets = [shingle_set(t.as_py(), words) for t in b.column(2)]
            node = pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64())
            if whole:
                last = {"shingles": pa.array([s.tobytes() for s in sets], pa.binary())}
            else:
                fp = [fingerprint(s) for s in sets] if late is None else [0] * len(sets)
                own = [s[: prefix_length(len(s), similarity) + SLACK] if late is None else prefix(s, similarity, late.value) for s in sets]
                last = {"fp": pa.array(fp, pa.int64()), "prefix": pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "key": b.column(1), "node": node, "n": pa.array(map(len, sets), pa.int32()), **last})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, node long, n int, " + ("shingles binary" if whole else "fp long, prefix array<long>"))


def set_nodes(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, fp (a node) of every row of docs; and the nodes, distinct sets: node, n, least (doc_id) and key
    of the text of its first document, fp, prefix with common shingles last in the order."""
    spark = docs.sparkSession
    with scratch(spark):
        made = written(set_rows(docs, words, similarity), "sets")
        rows = written(made.select("doc_id", "key", F.col("node").alias("fp")), "rows", keep=True)
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
        nodes = made.groupBy("node").agg(F.min(place).alias("p"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"))
        nodes = written(nodes.select("node", "p.key", "n", F.col("p.doc_id").alias("least"), "fp", "prefix"), "nodes", keep=True)
    with scratch(spark):
        own = F.slice("prefix", 1, F.greatest(F.size("prefix") - SLACK, F.lit(1)))  # about the prefix; any choice of common ones is right
        common = written(nodes.where("n > 0").select(F.explode(own).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PAIRED).select("key"), "common")
        late = spark.sparkContext.broadcast(slots_of(common))

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                known = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in b.column("prefix")]
                own = [settled(x, n, similarity, late.value) for x, n in zip(known, b.column("n").to_pylist(), strict=True)]
                stale = pa.array([x is None for x in own], pa.bool_())
                prefixes = pa.array([() if x is None else x.view(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], prefixes, stale], [*b.schema.names, "stale"])

        kinds = "node long, key long, n int, least long, fp long, prefix array<long>"
        new = written(nodes.select("node", "key", "n", "least", "fp", "prefix").mapInArrow(settle, kinds + ", stale boolean"), "settled", keep=True)
        sound, stale = new.where("not stale").drop("stale"), new.where("stale").drop("stale", "prefix")
        asked = spark.sparkContext.broadcast(slots_of(stale.select("key")))
        anew = set_rows(docs, words, similarity, late, asked)
        anew = first_rows(anew, stale).groupBy("node").agg(F.first("prefix").alias("prefix"))
        return rows, sound.unionByName(written(stale.join(anew, "node"), "renewed", keep=True))


def first_rows(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of set rows those of the nodes' first documents, so that a large group of copies is not gathered again."""
    named = nodes.select(F.col("node").alias("own"), "least")
    return rows.join(named, (F.col("node") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")


def simhash_pairs(nodes: DataFrame, max_distance: int) -> DataFrame:
    """src, dst: nodes whose fingerprints are equal or linked, enough of them to connect all that are."""
    from runlore.llm.simhash import links

    classes = written(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("src")), "classes")
    equal = nodes.where("n > 0").select("fp", F.col("node").alias("dst")).join(classes, "fp").where("src <> dst").select("src", "dst")
    near = links(classes.select("fp"), max_distance).withColumnsRenamed({"src": "a", "dst": "b"})
    near = near.join(classes.select(F.col("fp").alias("a"), "src"), "a").join(classes.select(F.col("fp").alias("b"), F.col("src").alias("dst")), "b")
    return equal.unionByName(near.select("src", "dst"))


def _fits(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of a and b shingles can be as similar as that."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def similar_components(docs: DataFrame, nodes: DataFrame, words: int, similarity: float, max_distance: int) -> DataFrame:
    """node, root: the components of the nodes' sets at that similarity; nodes without a link are left out."""
    spark = docs.sparkSession
    keyed = nodes.select("node", "n", F.size("prefix").alias("p"), F.explode("prefix").alias("part"))
    many = written(keyed.groupBy("part").agg(F.count("*").alias("sharers")).where("sharers > 1"), "shared")
    met = written(keyed.join(many, "part"), "sharers")
    # common: how many shingles of the prefix are not paired out.
    large = met.where(F.col("sharers") > PAIRED)
    crowded = written(large.groupBy("node").agg(F.count("*").alias("common")), "crowded")
    one = F.struct("node", "n", "p")
    small = met.where(F.col("sharers") <= PAIRED).groupBy("part").agg(F.collect_list(one).alias("all"))
    others = F.filter("all", lambda x: (x["node"] > F.col("own.node")) & _fits(x["n"], F.col("own.n"), similarity))
    pairs = small.select(F.explode("all").alias("own"), "all").select("own", F.explode(others).alias("x"))
    pairs = pairs.groupBy(F.col("own.node").alias("src"), F.col("x.node").alias("dst")).agg(F.count("*").alias("same"), *(F.first(f"{s}.{c}").alias(f"{s}_{c}") for s in ("own", "x") for c in ("n", "p")))
    # Up to the end of the shorter-ranged prefix both sets are known, so all but a few of its shingles must be met. Of
    # those that are not paired out either set's count is a bound.
    least = F.ceil(similarity / (1 + similarity) * (F.col("own_n") + F.col("x_n")) - 1e-6)
    need = F.least(*(F.col(f"{s}_p") - F.col(f"{s}_n") + least for s in ("own", "x")))
    for end in ("src", "dst"):
        pairs = pairs.join(crowded.select(F.col("node").alias(end), F.col("common").alias(f"{end}_common")), end, "left")
    unseen = F.least(F.coalesce("src_common", F.lit(0)), F.coalesce("dst_common", F.lit(0)))
    pairs = pairs.where(F.col("same") + unseen >= need).select("src", "dst")
    pairs = written(pairs, "pairs").unionByName(written(simhash_pairs(nodes, max_distance), "probed"))
    candidates = written(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "candidates")

    ends = candidates.select(F.col("src").alias("node")).unionByName(candidates.select(F.col("dst").alias("node"))).unionByName(crowded.select("node")).distinct()
    ends = written(nodes.select("node", "key", "least").join(ends, "node", "left_semi"), "ends")
    asked = spark.sparkContext.broadcast(slots_of(ends))
    sets = first_rows(set_rows(docs, words, similarity, None, asked, whole=True), ends)
    sets = written(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    edges = written(verified(candidates, sets, similarity), "edges")
    if crowded.isEmpty():
        return connected_components(edges)

    large = written(large.join(crowded, "node").select("part", "node", "n", (F.col("common") / F.col("p")).alias("share")), "large")
    of = large.withColumn("root", F.col("node"))
    drawn = written(sketches(sets.join(crowded.select("node"), "node", "left_semi")), "sketches")
    roots, new = None, edges
    for turn in range(4):
        # Components of components: the new links between roots, and what they make of the roots so far.
        later = connected_components(new)
        if roots is None:
            roots = later
        else:
            moved = roots.join(later.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
            roots = written(moved.select("node", F.coalesce("last", "root").alias("root")).unionByName(later.join(roots, "node", "left_anti")), "roots")
        if turn == 3:
            return roots
        of = of.join(later.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
        of = written(of.select("part", "node", "n", "share", F.coalesce("last", "root").alias("root")), "rooted")
        # A part's main component is that of most of its sets; the rest is to be compared.
        sizes = of.groupBy("part", "root").agg(F.count("*").alias("c"), F.max(F.struct("share", "n", "node")).alias("pivot"))
        mains = sizes.groupBy("part").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.sum("c").alias("sharers"), F.max(F.struct("pivot", "root")).alias("best"), F.count("*").alias("roots")).where("roots > 1")
        mains = written(mains.select("part", "main", "sharers", F.col("best.pivot.node").alias("b"), F.col("best.pivot.n").alias("b_n"), F.col("best.root").alias("b_root")), "mains")
        if mains.isEmpty():
            return roots
        todo = of.join(mains, "part")
        if turn:  # first the most alike of each block, then all that the sketches leave
            pairs = block_pairs(todo.join(drawn, "node"), similarity, best=turn == 1)
        else:
            pairs = todo.where((F.col("root") != F.col("b_root")) & _fits(F.col("n"), F.col("b_n"), similarity))
            pairs = pairs.select(F.struct("node", "root").alias("x"), F.struct(F.col("b").alias("node"), F.col("b_root").alias("root")).alias("y"))
            pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).selectExpr("x.node src", "y.node dst", "x.root x", "y.root y")
        pairs = written(pairs.distinct(), "candidates")
        linked = verified(pairs, sets, similarity).join(pairs, ["src", "dst"])
        new = written(linked.select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct(), "edges")
    return roots


def sketches(sets: DataFrame) -> DataFrame:
    """node, sketch: for every slot whether an odd number of the set's shingles fall into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.bincount((np.frombuffer(x.as_py(), np.uint64) >> np.uint64(32)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1 for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.packbits(x.astype(np.uint8)).tobytes() for x in rows], pa.binary())], ["node", "sketch"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, sketch binary")


def block_pairs(todo: DataFrame, similarity: float, best: bool) -> DataFrame:
    """src, dst, x, y (their roots): the pairs of a part of which at least one is outside the part's main component, that
    have different roots, and that size and sketch leave possible; best: of each block only the most alike for every set.

    todo: part, node, n, root, main, sharers, sketch. A part's sets are dealt into blocks of about BLOCK; a task compares
    two blocks of a part, so its memory is bounded, and a part that many share is work for many tasks."""
    blocks = F.ceil(F.col("sharers") / F.lit(BLOCK)).cast("int")
    todo = todo.withColumns({"own": F.pmod(F.xxhash64("node"), blocks).cast("int"), "rest": F.col("root") != F.col("main"), "blocks": blocks})
    columns, other = ["part", "node", "n", "root", "rest", "sketch"], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = todo.where("rest").select(*columns, F.col("own").alias("i"), other.alias("j"), F.lit(True).alias("asks"))
    second = todo.select(*columns, other.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))
    most = (1 - similarity) / (1 + similarity)

    def compare(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy()
        node, n, root, rest = (rows.column(c).to_numpy() for c in ("node", "n", "root", "rest"))
        bits = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        one, two, found = np.flatnonzero(asks), np.flatnonzero(~asks), []
        for i in range(0, len(one), 8):
            a = one[i : i + 8]
            differ = np.bitwise_count(bits[a, None, :] ^ bits[None, two, :]).sum(2, dtype=np.int32)
            na, nb = n[a][:, None].astype(float), n[two][None].astype(float)
            room = most * (na + nb) + 1e-6 - differ
            fits = (room >= 0) & (np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9) & (root[a][:, None] != root[two][None])
            fits &= ~(rest[two][None] & (node[a][:, None] > node[two][None]))  # of two such sets the lesser asks
            if best:
                room = np.where(fits, room / (na + nb), -1.0)
                top = room.argmax(1) if len(two) else np.empty(0, np.int64)
                fits = np.zeros_like(fits)
                ok = np.flatnonzero(room[np.arange(len(top)), top] >= 0)
                fits[ok, top[ok]] = True
            x, y = np.nonzero(fits)
            found.append(np.stack([a[x], two[y]]))
        x, y = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        return pa.table({"src": node[x], "dst": node[y], "x": root[x], "y": root[y]})

    return first.unionByName(second).groupBy("part", "i", "j").applyInArrow(compare, "src long, dst long, x long, y long")


def verified(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The candidates src, dst (nodes) whose sets have at least that Jaccard similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                kept.append(common >= similarity * (len(one) + len(two) - common))
            yield batch.filter(pa.array(kept, pa.bool_())).select(["src", "dst"])

    both = candidates.join(sets.select(F.col("node").alias("src"), F.col("shingles").alias("a")), "src").join(sets.select(F.col("node").alias("dst"), F.col("shingles").alias("b")), "dst")
    return both.select("src", "dst", "a", "b").mapInArrow(verify, "src long, dst long")
