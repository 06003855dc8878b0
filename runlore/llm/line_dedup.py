"""Line dedup (operator 11), in DataFrame functions alone.

Lines are normalised, hashed to 128 bits and counted by document; a line that enough documents hold goes from all of them
but the first, and what stays is put together again by position. Only hashes are grouped and joined: counting combines on
the map side, so a line that a third of all documents hold is one row a task, and texts are shuffled once, to meet the
positions that go from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import scratch, text_key, written

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _row_name() -> list[Column]:
    """What names a row: its id (0 where it has none), whether it has none, and 64 bits of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), text_key(_text()).alias("key")]


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, none, key, pos, d1, d2: every line of at least min_chars code points, stripped and with A-Z lower-cased."""
    folded = F.split(F.translate(_text(), UPPER, LOWER), "\n")
    lines = docs.select(*_row_name(), F.posexplode(folded).alias("pos", "raw"))
    lines = lines.select("id", "none", "key", "pos", F.btrim("raw", F.lit(SPACES)).alias("line")).where(F.length("line") >= min_chars)
    return lines.select("id", "none", "key", "pos", F.xxhash64("line").alias("d1"), F.xxhash64(F.lit(7), "line").alias("d2"))


def common_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """d1, d2, first: the lines that at least min_docs documents hold, and the least id that holds each (null where only
    rows without an id do). Rows without an id are one document."""
    own = F.when(~F.col("none"), F.col("id"))
    if min_docs <= 2:  # two documents differ exactly if the least and the greatest do, so nothing need be made distinct
        counts = lines.groupBy("d1", "d2").agg(F.min(own).alias("first"), F.max(own).alias("last"), F.max("none").alias("any_none"))
        docs = F.when(F.col("first").isNull(), 0).when(F.col("first") < F.col("last"), 2).otherwise(1) + F.col("any_none").cast("int")
        return counts.where(docs >= min_docs).select("d1", "d2", "first")
    counts = lines.select("d1", "d2", "id", "none").distinct().groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(own).alias("first"))
    return counts.where(F.col("n") >= min_docs).select("d1", "d2", "first")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    r"""docs with text reduced to the lines that stay, and the columns n_lines (before) and dropped_lines (array of the
    positions that go, from 0; empty where none).

    Texts are cut at \n. A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased; keys
    of at least min_chars code points that at least min_docs documents hold lose all their lines except in the document
    with the least doc_id, where all of them stay. Other lines stay as they are, joined by \n. n_chars (where there is
    one) is made new where lines go. A null text counts as one empty line and becomes empty. Rows of one doc_id are one
    document, so none of them loses a line to another; rows without a doc_id are one document that ranks last. Repeated
    rows get equal results; an empty table gives an empty one. All other columns pass through; the two added ones replace
    any of their names. Keys are compared by 128-bit hashes.
    """
    if min_chars < 0 or min_docs < 1:
        raise ValueError("min_chars must not be negative, and min_docs must be positive")
    with scratch(docs.sparkSession):
        lines = hashed_lines(docs, min_chars)
        # Written, so that the join below has an exchange on either side and Spark can split the partition of a common line.
        common = written(common_lines(lines, min_docs), "common")
        first = F.col("none") | (F.col("id") != F.col("first"))
        gone = lines.join(common, ["d1", "d2"]).where(F.when(F.col("first").isNull(), False).otherwise(first))
        by_row = gone.groupBy("id", "none", "key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        by_row = written(by_row, "gone", keep=True)
    kept = [c for c in docs.columns if c not in ("n_lines", "dropped_lines")]
    # The row travels in a struct, so that no column of its own can clash with those of the join.
    rows = docs.select(F.struct(*kept).alias("row"), *_row_name()).join(by_row, ["id", "none", "key"], "left")
    rows = rows.select("row", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("whole"), "gone")
    # One flag a line up to the last that goes: falses for the lines between two that go, then a true. A get() by index in
    # a lambda would cut the text anew for every line.
    gaps = F.zip_with(F.col("gone"), F.concat(F.array(F.lit(-1)), F.slice("gone", 1, F.greatest(F.size("gone") - 1, F.lit(0)))), lambda x, before: x - before - 1)
    flags = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True)))))
    pairs = F.zip_with(F.split("whole", "\n"), flags, lambda line, flag: F.struct(line.alias("line"), flag.alias("gone")))
    stays = F.array_join(F.transform(F.filter(pairs, lambda x: ~F.coalesce(x["gone"], F.lit(False))), lambda x: x["line"]), "\n")
    new = {"text": F.when(F.col("gone").isNull(), F.col("whole")).otherwise(stays)}
    if "n_chars" in kept:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(stays).cast(docs.schema["n_chars"].dataType))
    n_lines = (F.length("whole") - F.length(F.translate("whole", "\n", "")) + 1).cast("long")
    dropped = F.coalesce("gone", F.array().cast("array<int>"))
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in kept), n_lines.alias("n_lines"), dropped.alias("dropped_lines"))
