"""A corpus pipeline: quality filter, near-duplicates, repeated passages, benchmark overlaps, token ids.

Each stage takes what the one before it kept, as written to Parquet, and its decisions take effect: later stages never
see what an earlier one removed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.llm import bpe, decontamination, quality_model, simhash, substring_dedup
from runlore.llm.common import table, text_key, written


def chosen(docs: DataFrame, rows: DataFrame, once: bool = False) -> DataFrame:
    """The documents named by rows' doc_id and key (of the text); once: one row of those that repeat a row. A row travels
    in a struct, so that no column of its own can clash with those of the join."""
    name = lambda key: [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), key.alias("key")]
    found = docs.select(F.struct(*docs.columns).alias("row"), *name(text_key(F.col("text")))).join(rows.select(*name(F.col("key"))), ["id", "none", "key"], "left_semi")
    return (found.dropDuplicates(["id", "none", "key"]) if once else found).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = quality_model.score_documents(docs, table(spark, sf_dir, "labels"))
    return chosen(docs, scored.where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates on five-word shingles the document with the least doc_id stays (a null id is
    greater than any; ties go to the lesser hash of the text). Rows equal in doc_id and text are one document, of which
    one row stays."""
    groups = simhash.near_duplicates(docs, words=5, max_distance=2, similarity=0.8)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = groups.groupBy(F.col("root")).agg(F.min(place).alias("p"))
    return chosen(docs, first.select("p.doc_id", "p.key"), once=True)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go from the later ones; documents that lose all their
    words go. n_chars follows the text."""
    out = substring_dedup.dedup_passages(docs)
    return out.where(F.col("removed_spans").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars of every document that is left."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_overlaps),
    ("byte-level bpe", token_ids),
]

#: SQL cannot fit the classifier or compute fingerprints; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
