"""Fill-in-middle transformation (operator 12).

A text is cut at two token boundaries into prefix, middle and suffix, and written with markers so that the middle comes
last. Boundaries are a compressed set (arrays, bitmaps and runs with cumulative cardinalities), from which both offsets are
selected; no list of tokens is made. What is drawn depends on the seed and the doc_id alone, so that a lost task repeats
its result. No shuffle: each text is cut where it is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlore.llm.boundaries import BoundarySet
from runlore.llm.common import session_setup

MARKERS = ("<P>", "<S>", "<M>")
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit integers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, h: list[int], rate: int, spm_rate: int, markers: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of a text."""
    places = BoundarySet(text)
    n = len(places)
    if not text or any(m in text for m in markers) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (places.offset(x) for x in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, s, m = markers
    if h[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """docs with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    Of 100 documents about rate are rearranged, and of these spm_rate with the suffix first. Texts that are empty or hold
    a marker stay plain, so that restored() is exact. A null text counts as empty; a null doc_id draws as the empty string
    would. Rows of one doc_id draw alike, and each row is cut by its own text. An empty table gives an empty one. Other
    columns pass through; the added ones replace any of their names.
    """
    if len(set(markers)) < 3 or any(a in b for a in markers for b in markers if a != b) or any(not m.startswith("<") or "<" in m[1:] for m in markers):
        raise ValueError("markers must differ, none may hold another, and each has its only < in front")
    session_setup(docs.sparkSession)
    names = [x.split()[0] for x in ADDED.split(", ")]
    kept = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            out = [cut(text.as_py() or "", draws(seed, doc_id), rate, spm_rate, markers) for doc_id, text in rows]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            made = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(2), *made], ["row", *names])

    # The row travels in a struct, so that no column of its own can clash with those that are read and added.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*kept).alias("row"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL(ADDED)])
    return rows.mapInArrow(run, schema).select(*(F.col(f"row.`{c}`").alias(c) for c in kept), *names)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text, rebuilt from an output and its form alone."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers))
    part = lambda i: F.get(parts, i)
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
