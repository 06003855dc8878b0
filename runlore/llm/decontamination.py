"""Benchmark decontamination by spaced seeds (operator 3).

A mask fixes some of the words of a window and ignores the others, so a seed still hits where a word was replaced. The
hashes of all masked windows of the benchmark are joined with those of every document; each hit gives an alignment of an
item with the document, which is verified word for word: some window, in which at least four words in five agree, must
have enough equal words. The masks miss no such window, wherever its words were replaced.

The benchmark comes through the driver in blocks of a fixed number of words, each a broadcast of bounded size, and every
document meets every block where it is read. Up to CHAINED blocks are met in one pass, so that a task never holds more; of
a larger benchmark each pass writes its hits alone, by a hash of the text, and documents are joined with them at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import scratch, session_setup, written

#: Fixed masks over a window of words, by the equal words that count (more than 13 as 13); 0 ignores the word. Every window
#: with so many, and four in five equal, is hit. For 13, a window without five equal words in a row and with seven or more
#: others holds a shorter one that counts; up to 12, without four in a row it has at most three others. What is then left
#: is hit by the other masks: the tests go through it.
MASKS = {
    1: ["1"], 2: ["11"], 3: ["11"], 4: ["1111", "11011", "11101", "10111"], 5: ["1111", "11011"], 6: ["1111", "111011"],
    7: ["1111", "110110011"], 8: ["1111", "110110011"], **{n: ["1111", "1110111"] for n in range(9, 13)}, 13: ["11111", "111001101"],
}
#: Words of the benchmark in one broadcast block (about 60 bytes a word).
BLOCK_WORDS = 400_000
#: Blocks that one pass over the documents meets.
CHAINED = 8
#: Bytes of text hashed at once, so that arrays stay small however long a text is.
PIECE = 1 << 20
#: Equal words are worth 1, others cost this.
MISS = 4

_ODD = 0x9E3779B97F4A7C15
_MASK64 = (1 << 64) - 1
# Bytes of words: digits and letters, A-Z lower-cased, and all of UTF-8's longer characters. Others separate words.
_KIND = np.array([c in b"0123456789abcdefghijklmnopqrstuvwxyz" or 65 <= c <= 90 or c >= 128 for c in range(256)])
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _piece_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _KIND[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)], dtype=np.uint64)])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of UTF-8 text, and the byte where it starts. Works through pieces cut between words."""
    array = np.frombuffer(data, np.uint8)
    if len(array) <= PIECE:
        return _piece_words(array)
    hashes, starts, at = [], [], 0
    while at < len(array):
        end = min(len(array), at + PIECE)
        while end < len(array) and _KIND[array[end]] and _KIND[array[end - 1]]:
            end += 1
        h, s = _piece_words(array[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window under a mask; entry i is of the window that starts at word i."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(len(mask)))
    for at, bit in enumerate(mask):
        if bit == "1":
            out += words[at : at + n] * np.uint64(pow(_ODD, at + 1, 1 << 64))
    return _mix(out)


class Block:
    """Some items of the benchmark: their words, and for each mask their seeds in ascending order."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        own = [MASKS[min(13, enough(len(w), least))] for w in self.words]
        self.tables: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
        for mask in sorted({m for masks in own for m in masks}):
            hashes = [seeds(w, mask) if mask in masks else np.empty(0, np.uint64) for w, masks in zip(self.words, own, strict=True)]
            flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
            item = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes]) if hashes else np.empty(0, np.int32)
            order = np.argsort(flat, kind="stable")
            self.tables.append((mask, flat[order], item[order], place[order]))
        # A bit for each seed's low 20 bits: most windows are turned away before the search.
        self.filter = np.zeros(1 << 20, bool)
        for _, table, _, _ in self.tables:
            self.filter[(table & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def alignments(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, where its first word would be in the text) of every hit."""
        out: set[tuple[int, int]] = set()
        for mask, table, item, place in self.tables:
            h = seeds(words, mask)
            if not len(h) or not len(table):
                continue
            near = np.flatnonzero(self.filter[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(table, h[near], "left"), np.searchsorted(table, h[near], "right")
            for p, a, b in zip(near[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                out.update(zip(item[a:b].tolist(), (p - place[a:b]).tolist(), strict=True))
        return out

    def overlaps(self, words: np.ndarray, firsts: np.ndarray, least: int) -> list[list[tuple[int, int, int, int]]]:
        """For each document, whose words begin at firsts, the verified stretches: (item, first word, end, equal words)."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in firsts]
        ends = np.append(firsts[1:], len(words))
        for item, at in sorted(self.alignments(words)):
            own = self.words[item]
            # A hit may lie across documents: the item is set against each that it would reach.
            low = max(0, int(np.searchsorted(firsts, max(at, 0), "right")) - 1)
            high = int(np.searchsorted(firsts, at + len(own) - 1, "right"))
            for d in range(low, high):
                if found := best_stretch(words, own, at, max(int(firsts[d]), at), min(int(ends[d]), at + len(own)), least):
                    start, end, same = found
                    out[d].append((self.ids[item], start - int(firsts[d]), end - int(firsts[d]), same))
        return out


def enough(n: int, least: int) -> int:
    """The equal words that count of an item of n words: least, or four fifths of a shorter item."""
    return max(1, min(least, -(-4 * n // 5)))


def best_stretch(words: np.ndarray, own: np.ndarray, at: int, lo: int, hi: int, least: int) -> tuple[int, int, int] | None:
    """Of the windows of words[lo:hi] that agree in four words of five or more with an item laid at `at`, the one with the
    most equal words (the shortest, first one of these), if it has enough."""
    if lo >= hi:
        return None
    equal = words[lo:hi] == own[lo - at : hi - at]
    if equal.sum() < enough(len(own), least):
        return None
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISS))])
    same = np.concatenate([[0], np.cumsum(equal)])
    # From each start the last end at which the sum is not below that at the start.
    high = np.maximum.accumulate(total[::-1])[::-1]
    ends = len(high) - 1 - np.searchsorted(high[::-1], total, "left")
    count = same[ends] - same
    # The same equal words end at the first end that has them: what follows them is not equal.
    firsts = np.searchsorted(same, same[ends], "left")
    best = np.flatnonzero(count == count.max())
    start = int(best[np.argmin(firsts[best] - best)])
    n = int(count[start])
    return (lo + start, lo + int(firsts[start]), n) if n >= enough(len(own), least) else None


def blocks(benchmark: DataFrame, overlap: int, least: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded size; items of fewer than `least` words are left out."""
    items: list[tuple[int, np.ndarray]] = []
    size = 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for item_id, text in rows.toLocalIterator():
        words, _ = word_hashes(text.encode())
        # An item longer than a block goes in parts that overlap by one stretch.
        for at in range(0, max(1, len(words) - least + 1), BLOCK_WORDS):
            part = words[at : at + BLOCK_WORDS + least]
            if len(part) >= least:
                items.append((item_id, part))
                size += len(part)
            if size >= BLOCK_WORDS:
                yield Block(items, overlap)
                items, size = [], 0
    if items:
        yield Block(items, overlap)


def portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of about four pieces' bytes, one long text alone."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        if part and size + len(t) > 4 * PIECE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts in one array, and where each text's begin."""
    hashes, starts = word_hashes(b"\n".join(texts))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return hashes, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)[:-1]]))


HITS = "array<struct<item_id:long,start:int,end:int,matched:int>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.int32())]))


def overlaps(docs: DataFrame, benchmark: DataFrame, min_overlap: int = 13, min_item: int = 5) -> DataFrame:
    """docs with a column overlaps: the stretches that a document shares with benchmark items, as item_id, first word,
    end (words counted from 0, of digits and letters) and equal words.

    A stretch counts from min_overlap equal words, or four fifths of a shorter item, with at least four in five equal.
    Items of fewer than min_item words are not searched, as they occur in clean texts by chance; min_item=1 searches all. Null and empty texts overlap nothing;
    null ids of documents pass through; items with null ids or texts are left out; repeated rows and ties each get the
    same result; an empty benchmark or table finds nothing. Other columns pass through; one named overlaps is replaced.
    """
    session_setup(docs.sparkSession)
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "overlaps"]
    groups = grouped(blocks(benchmark, min_overlap, min_item), CHAINED)
    group = next(groups, [])
    more = next(groups, None)
    if more is None:  # a benchmark of a few blocks: hits are added where texts are read
        return searched(docs.select(*names), group, min_overlap)
    # Hits depend on the text alone: of each group of blocks only they are written, by a 128-bit hash of the text.
    texts = docs.select(*_text_name(), F.col("text").cast("string").alias("text")).where("text is not null")
    with scratch(spark):
        found = []
        while group is not None:
            hits = searched(texts, group, min_overlap).where(F.size("overlaps") > 0)
            hits = hits.groupBy("k1", "k2").agg(F.any_value("overlaps").alias("overlaps")).withColumn("part", F.lit(len(found)))
            found.append(written(hits, "hits"))
            group, more = more, next(groups, None)
        both = reduce(DataFrame.unionByName, found)
        ordered = F.sort_array(F.collect_list(F.struct("part", "overlaps")))
        both = both.groupBy("k1", "k2").agg(F.flatten(F.transform(ordered, lambda x: x["overlaps"])).alias("overlaps"))
        both = written(both, "overlaps", keep=True)
    # The row travels in a struct, so that no column of its own can clash.
    rows = docs.select(F.struct(*names).alias("row"), *_text_name()).join(both, ["k1", "k2"], "left")
    return rows.select("row.*", F.coalesce("overlaps", F.array().cast(HITS)).alias("overlaps"))


def _text_name() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def grouped(items: Iterator, size: int) -> Iterator[list]:
    while part := list(islice(items, size)):
        yield part


def searched(rows: DataFrame, group: list[Block], min_overlap: int) -> DataFrame:
    """rows (text and other columns) with overlaps, the hits of a few blocks, each a broadcast of bounded size."""
    out = rows.withColumn("overlaps", F.array().cast(HITS))
    at, schema = rows.columns.index("text"), out.schema
    for block in group:
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own: Block = shared.value
            for b in batches:
                texts = [(t.as_py() or "").encode() for t in b.column(at)]
                found = [x for part in portions(texts) for x in own.overlaps(*words_of(part), min_overlap)]
                before = b.column(b.num_columns - 1).to_pylist()
                hits = [[*old, *({"item_id": i, "start": s, "end": e, "matched": m} for i, s, e, m in new)] for old, new in zip(before, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hits, _HITS)], [f.name for f in b.schema])

        out = out.mapInArrow(run, schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_overlap: int = 13, min_item: int = 5) -> DataFrame:
    """The documents that overlap no benchmark item, with their own columns; see overlaps() for what counts."""
    return overlaps(docs, benchmark, min_overlap, min_item).where(F.size("overlaps") == 0).select(*docs.columns)
