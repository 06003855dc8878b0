"""Substring dedup by unit hashing (operator 1).

Units are normalised (A-Z lower-cased, white space folded), digested, and grouped by digest over the whole corpus; the
occurrence in the document that ranks first is kept and the others go. A passage that is copied into another text seldom
begins and ends with a line there, so a line or a sentence as the unit misses it: here a unit is a run of min_words words
wherever it begins, across line ends too. A passage goes exactly if it is made of units that an earlier document has.

Digests of all units would be several times the text. So units are searched in two steps, and the first only spares work:

1. Of every min_words words the content selects one shingle (the least hash of those in it, as in winnowing). Equal units
   select equal shingles, so a unit that two texts share has a selected shingle that two texts have.
2. Only around such shingles are units digested, to 128 bits, and grouped.

Texts that are equal as a whole are one text in both steps; the later copies go as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import scratch, session_setup, text_key, written
from runlore.llm.words import folded, run_hashes, word_hashes

#: A word with the ASCII white space after it.
_PIECE = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
SPANS = "array<struct<start:int,size:int,words:int,keeper:long>>"


def selected(grams: np.ndarray, width: int) -> np.ndarray:
    """Ascending places of the shingles that are the first least one of some width neighbours."""
    if len(grams) < width:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, width)
    least = np.empty(len(windows), np.int64)
    for i in range(0, len(windows), 1 << 16):
        least[i : i + (1 << 16)] = windows[i : i + (1 << 16)].argmin(1)
    return np.unique(least + np.arange(len(windows)))


def _sizes(min_words: int) -> tuple[int, int]:
    """Words of a shingle, and shingles of a unit."""
    size = max(1, min_words * 2 // 5)
    return size, min_words - size + 1


def _keyed(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text")]


def selected_shingles(docs: DataFrame, min_words: int) -> DataFrame:
    """h, key, again: the distinct selected shingles of every row's text; again if the text has the shingle twice."""
    size, width = _sizes(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, keys, twice = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = word_hashes(text.as_py())
                if len(words) >= min_words:
                    grams = run_hashes(words, size)
                    own, times = np.unique(grams[selected(grams, width)], return_counts=True)
                    found.append(own)
                    keys.append(np.full(len(own), key, np.int64))
                    twice.append(times > 1)
            if found:
                columns = [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(twice))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "key", "again"])

    return docs.select(*_keyed(docs)[1:]).mapInArrow(run, "h long, key long, again boolean")


def units_around(texts: DataFrame, min_words: int) -> DataFrame:
    """d1, d2, n, at: the units of each text (n, text, shared: hashes of shingles) that hold one of its shared shingles;
    at is the number of a unit's first word."""
    size, width = _sizes(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for n, text, shared in zip(*(b.column(i) for i in range(3)), strict=True):
                words = folded(text.as_py())
                grams = run_hashes(word_hashes(text.as_py()), size)
                places = selected(grams, width)
                places = places[np.isin(grams[places], shared.values.to_numpy(zero_copy_only=False).view(np.uint64))]
                holds = np.zeros(len(words) + 2, np.int64)  # +1 where the units with a place begin, -1 behind the last
                np.add.at(holds, np.maximum(places - width + 1, 0), 1)
                np.add.at(holds, np.minimum(places, len(words) - min_words) + 1, -1)
                starts = np.flatnonzero(np.cumsum(holds) > 0)
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                first = np.concatenate([[0], ends])
                for i in range(0, len(starts), 1 << 15):
                    at = starts[i : i + (1 << 15)]
                    spans = zip(first[at].tolist(), (ends[at + min_words - 1] - 1).tolist(), strict=True)
                    both = np.frombuffer(b"".join([digest(joined[x:y]) for x, y in spans]), "<i8").reshape(-1, 2)
                    columns = [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.repeat(n, len(at)), pa.array(at.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "n", "at"])

    return texts.select("n", "text", "shared").mapInArrow(run, "d1 long, d2 long, n long, at int")


def _rank(*more: str) -> Column:
    """By doc_id with null last; ties go to the lesser hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", *more)


def repeated_ranges(docs: DataFrame, min_words: int, within: bool) -> DataFrame:
    """doc_id, key, whole (a later copy of a text, which goes as a whole), ranges: array of first word, last word + 1 and
    keeper, in order."""
    texts = docs.select(*_keyed(docs)[:2], F.xxhash64(F.lit(7), F.col("text")).alias("key2")).where("key is not null").distinct()
    texts = written(texts, "texts")
    ranks = texts.groupBy("key", "key2").agg(F.min(_rank()).alias("first"), F.max(_rank()).alias("last"))
    ranks = written(ranks.select("key", "key2", F.col("first.doc_id").alias("first_id"), (F.col("first") < F.col("last")).alias("copied")), "ranks")

    found = written(selected_shingles(docs, min_words), "shingles")
    many = F.min("key") < F.max("key")
    shared = found.groupBy("h").agg((many | F.max("again") if within else many).alias("many")).where("many").select("h")
    # Written, so that the join below has an exchange on either side and Spark can split a common shingle's partition.
    shared = written(shared, "shared")
    lists = found.join(shared, "h").groupBy("key").agg(F.collect_set("h").alias("shared"))
    # Texts are numbered in the order of their ranks, so that a unit's row names its text, and ranks it, in 8 bytes.
    by_rank = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("key")]
    lists = ranks.join(lists, "key").select(F.col("first_id").alias("doc_id"), "key", "shared").repartitionByRange(*by_rank).sortWithinPartitions(*by_rank)
    lists = written(lists.withColumn("n", F.monotonically_increasing_id()), "lists")
    same = F.col("t.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("t.key") == F.col("l.key"))
    # Merged at every size, so that a plan that holds for small lists is not another than that for large ones.
    own = docs.select(*_keyed(docs)).alias("t").join(lists.hint("merge").alias("l"), same)
    units = written(units_around(own.select("l.n", "t.text", "l.shared"), min_words), "units")

    place = F.struct("n", "at") if within else F.col("n")
    first = units.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("d1", "d2", "first")
    later = units.join(written(first, "firsts"), ["d1", "d2"]).withColumn("place", place).where("place <> first")
    # Units of one document that touch or overlap make a range; a document's units are no more than its words.
    keeper = "first.n" if within else "first"
    order = "partition by n order by at"
    later = later.selectExpr("n", "at", f"{keeper} as keeper", f"at > lag(at, 1, -1 - {min_words}) over ({order}) + {min_words} as new").distinct()
    later = later.selectExpr("n", "at", "keeper", f"sum(int(new)) over ({order}) as range")
    ranges = later.groupBy("n", "range").agg(F.min("at").alias("start"), (F.max("at") + min_words).alias("stop"), F.min(F.struct("at", "keeper"))["keeper"].alias("keeper"))
    ranges = written(ranges.drop("range"), "numbered")
    names = lists.select("n", "doc_id", "key")
    ranges = ranges.join(names.select(F.col("n").alias("keeper"), F.col("doc_id").alias("kept_by")), "keeper").join(names, "n")
    ranges = written(ranges.select("doc_id", "key", "start", "stop", F.col("kept_by").alias("keeper")), "ranges")
    each = ranges.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "keeper"))).alias("ranges"))

    # A copy's first words may have come from elsewhere already.
    begins = ranges.where("start = 0").select(F.col("doc_id").alias("first_id"), "key", F.struct("keeper").alias("head"))
    copied = ranks.where("copied").alias("r").join(begins.alias("b"), F.col("r.first_id").eqNullSafe(F.col("b.first_id")) & (F.col("r.key") == F.col("b.key")), "left")
    copied = written(copied.select("r.key", "r.key2", "r.first_id", F.when(F.col("head").isNull(), F.col("r.first_id")).otherwise(F.col("head.keeper")).alias("keeper")), "copied")
    whole = texts.join(copied, ["key", "key2"]).where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    whole = whole.select("doc_id", "key", F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), "keeper")).alias("ranges"))
    return each.select("doc_id", "key", F.lit(False).alias("whole"), "ranges").unionByName(whole.withColumn("whole", F.lit(True)))


def without(text: str, ranges: list[tuple[int, int, int | None]]) -> tuple[str, list[dict]]:
    """The text without the words of the ranges and the white space behind them; the spans that go, in code points."""
    pieces = _PIECE.findall(text)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))]) + (len(text) - sum(map(len, pieces)))
    kept, spans, last = [], [], 0
    for start, stop, keeper in ranges:
        a, b = int(at[start]), int(at[stop])
        kept.append(text[last:a])
        spans.append({"start": a, "size": b - a, "words": stop - start, "keeper": keeper})
        last = b
    return "".join(kept) + text[last:], spans


def dedup_passages(docs: DataFrame, min_words: int = 50, within: bool = False) -> DataFrame:
    """docs with text reduced to what no earlier document has, and the columns removed_spans (array of start, size, words,
    keeper; offsets in code points of the original text; null where nothing goes) and removed_words.

    A word goes if a run of min_words words around it, line ends counting as any white space, is also in an earlier
    document; within: or at an earlier place of the same document. The white space behind a removed passage goes with it.
    keeper is the first document that has the passage's first min_words words. n_chars (where there is one) is made new
    where a text changes. A null text stays null and an empty one empty; texts of fewer than min_words words stay. A null
    doc_id ranks last. Ties between rows of one doc_id go to the text with the lesser hash; rows equal in doc_id and text
    are one document and get equal results. A document of which all goes keeps its row with what blanks lead its text.
    Empty tables give empty ones. All other columns pass through; the two added ones replace any of their names.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    session_setup(docs.sparkSession)
    with scratch(docs.sparkSession):
        found = written(repeated_ranges(docs, min_words, within), "found", keep=True)
    found = found.select(F.col("doc_id").alias("id2"), F.col("key").alias("key2"), "whole", "ranges")
    kept = [c for c in docs.columns if c not in ("removed_spans", "removed_words")]
    # The row travels in a struct, so that no column of its own can clash with those of the join.
    left = docs.select(F.struct(*kept).alias("row"), *_keyed(docs)[:2])
    joined = left.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left").select("row", "whole", "ranges")

    @F.pandas_udf(f"text string, spans {SPANS}")
    def cut(text: pd.Series, whole: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for t, w, r in zip(text, whole, ranges, strict=True):
            if t is None or r is None:
                out.append((None, None))
                continue
            all_ = [(x["start"], x["stop"], None if pd.isna(x["keeper"]) else int(x["keeper"])) for x in r]
            if w:
                n = len(folded(t))
                all_ = [(0, n, all_[0][2])] if n >= min_words else []
            out.append(without(t, all_) if all_ else (t, None))
        return pd.DataFrame(out, columns=["text", "spans"], dtype=object)

    # Only the texts that change go to Python, and once: Spark repeats a deterministic function for a filter on its result,
    # each time with Python workers of its own.
    cut = cut.asNondeterministic()
    changes = F.col("ranges").isNotNull()
    joined = joined.withColumn("cut", cut(F.when(changes, F.col("row.text")), F.col("whole"), F.col("ranges")))
    edited = F.col("cut.spans").isNotNull()
    new = {"text": F.when(edited, F.col("cut.text")).otherwise(F.col("row.text"))}
    if "n_chars" in kept:
        new["n_chars"] = F.when(edited, F.length("cut.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    words = F.coalesce(F.aggregate("cut.spans", F.lit(0), lambda a, x: a + x["words"]), F.lit(0)).cast("long")
    return joined.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in kept), F.col("cut.spans").alias("removed_spans"), words.alias("removed_words"))
