"""A quality score for documents: random Fourier features over document statistics (operator 10).

Statistics of every whole text are standardised and mapped to cosines of random projections, whose inner products
approximate a Gaussian kernel. Each partition sums its own normal equations and Spark adds these up; the driver solves
one small ridge system of a size that the parameters fix. Isotonic regression over score bins, of rows that the ridge
did not see, turns the scores into probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import session_setup, text_key, written

#: The statistics of a text, in order.
STATISTICS = ["log_words", "symbols", "marks", "capitals", "digits", "pipes", "shouts", "commas", "stops", "spaces", "word_length", "long_words", "tailed_words", "same_lines", "same_words", "line_words", "entropy", "wide"]
SYMBOLS, MARKS, SHOUTS = b"#*$%&|<>@^~{}[]\\", b".,;:!?'\"()-", b"!"
RIDGE = 1e-3
BINS = 1000


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; all zero for a null or blank one."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, k = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda chars: float(counts[np.frombuffer(chars, np.uint8)].sum()) / n
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = counts[counts > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, k)
    top = Counter(words).most_common(1)[0][1]
    tailed = sum(1 for w in words if w[-1] in SYMBOLS)
    return [
        np.log1p(k), share(SYMBOLS), share(MARKS), float(counts[65:91].sum()) / letters, float(counts[48:58].sum()) / n, share(b"|"), share(SHOUTS), share(b","), share(b"."),
        share(b" \n\t\r"), float(lengths.mean()), float((lengths > 15).mean()), tailed / k, 1 - len(set(lines)) / len(lines), top / k, np.log1p(k / len(lines)), float(-(p * np.log2(p)).sum()), float(counts[128:].sum()) / n,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and a double for each statistic, for every row of docs."""
    session_setup(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(2)], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["doc_id", "key", *STATISTICS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, " + ", ".join(f"{c} double" for c in STATISTICS))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal digits, mod 5: fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)).cast("int")


@dataclass
class KernelScore:
    """A fitted model; a few thousand numbers, whatever it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cosines = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases)
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in ascending order: knots and non-decreasing levels."""
    pools: list[list[float]] = []  # mean, weight, first, last
    for a, m, w in zip(at, mean, weight, strict=True):
        pools.append([m, w, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, _, last = pools.pop()
            m1, w1, first, _ = pools.pop()
            pools.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    knots = np.array([x for p in pools for x in ((p[2],) if p[2] == p[3] else (p[2], p[3]))])
    levels = np.array([p[0] for p in pools for _ in range(1 if p[2] == p[3] else 2)])
    return knots, levels


def _columns(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in STATISTICS]).reshape(-1, len(STATISTICS))


def fit(train: DataFrame, calibrate: DataFrame, waves: int = 256, width: float = 4.0, seed: int = 7) -> KernelScore:
    """train, calibrate: the statistics and label (0 or 1). All rows count. No rows to train on: every score is 0.5; none
    to calibrate on: the ridge's own score, cut to 0 and 1.

    waves: random features; width: of the Gaussian kernel, in standard deviations.
    """
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    moments = train.agg(F.count("*"), *(f(c) for c in STATISTICS for f in (F.avg, F.stddev_pop))).first()
    model = KernelScore(np.array([x or 0.0 for x in moments[1::2]]), np.maximum(np.array([x or 0.0 for x in moments[2::2]]), 1e-6), rng.normal(size=(d, waves)) / width, rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.array([0.0]), np.array([0.5]))
    if not moments[0]:
        return model
    size = waves + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, n = np.zeros((size, size)), np.zeros(size), 0
        for b in batches:
            x, y = model.features(_columns(b)), b.column(b.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
            left += x.T @ x
            right += x.T @ y
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(right), pa.array([n] * size, pa.int64()), *(pa.array(left[:, j]) for j in range(size))], ["i", "y", "n", *(f"x{j}" for j in range(size))])

    parts = train.select(*STATISTICS, "label").mapInArrow(sums, "i int, y double, n long, " + ", ".join(f"x{j} double" for j in range(size)))
    rows = parts.groupBy("i").agg(F.sum("y").alias("y"), F.sum("n").alias("n"), F.array(*(F.sum(f"x{j}") for j in range(size))).alias("x")).orderBy("i").collect()  # one row for each feature
    left, right, n = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), rows[0]["n"]
    model.weights = np.linalg.solve(left + RIDGE * n / size * np.eye(size), right)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_columns(b))), b.column(b.schema.get_field_index("label")).cast(pa.float64())], ["raw", "label"])

    bins = calibrate.select(*STATISTICS, "label").mapInArrow(scored, "raw double, label double").groupBy(F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "raw")) * (BINS // 2)).alias("bin"))
    found = bins.agg(F.avg("raw").alias("at"), F.avg("label").alias("mean"), F.count("*").alias("n")).orderBy("bin").collect()  # at most BINS + 1 rows
    if not found:  # nothing to calibrate on: the ridge's own score, cut to 0 and 1
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        model.knots, model.levels = isotonic(*(np.array([r[c] for r in found], float) for c in ("at", "mean", "n")))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality") -> DataFrame:
    """doc_id, key, held_out, score, predicted for every row of docs.

    labels: doc_id and a column `label` of 0 and 1; only rows outside fold 0 are learned from: folds 1 to 3 fit the
    ridge, fold 4 calibrates. Rows with null ids or labels teach nothing; several labels of one id count as their mean,
    rounded half up. Null and empty texts are scored as texts without words. Repeated rows and ties get equal scores; an
    empty table gives an empty one; no labels in folds 1 to 3: every score is 0.5; none in fold 4: the ridge's own score,
    cut to 0 and 1. Other columns are ignored.
    """
    stats = written(document_statistics(docs).withColumn("fold", fold(F.col("doc_id"))), "statistics")
    taught = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    known = written(stats.where("fold <> 0").join(taught, "doc_id"), "labelled")
    model = fit(known.where("fold < 4"), known.where("fold = 4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.clip(model.score(_columns(b)), 0.0, 1.0) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.compute.equal(b.column(b.schema.get_field_index("fold")), 0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "key", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, key long, held_out boolean, score double, predicted int")
