"""JSON Lines in, as rows with the file's path and the line's number: order in a file is part of the meaning."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from runlore.functions import variants as V


@F.pandas_udf(StringType())
def repaired(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON that a Python reader accepts and Spark's parser does not (repeated keys, NaN, infinities), written anew; null
    for lines that are torn for both, and for null."""

    def fix(line: str | None) -> str | None:
        if line is None:
            return None
        try:
            # NaN and infinities have no JSON form: they become tagged strings that judge.py knows.
            return json.dumps(json.loads(line, parse_constant=lambda c: f"\0{c}"))
        except (ValueError, RecursionError):
            return None

    for s in lines:
        yield s.map(fix) if s.notna().any() else s


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with v, the line as VARIANT; null for blank and torn lines, which torn tells apart. Lines that only Python's
    reader accepts go through a small helper, for which all others are null; the source is read and parsed once."""
    spark = lines.sparkSession
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = F.col(line)
    blank = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")) == ""
    first = lines.withColumn("v", F.try_parse_json(text))
    # Only tokens that Spark's parser knows not can mend a line; a torn one without them stays torn.
    doubtful = F.col("v").isNull() & ~blank & text.rlike("NaN|Infinity")
    mended = F.try_parse_json(repaired.asNondeterministic()(F.when(doubtful, text)))
    return first.withColumn("v", F.coalesce("v", mended)).withColumn("torn", F.col("v").isNull() & ~blank)


def objects(rows: DataFrame, v: str = "v") -> Column:
    return V.is_object(rows[v])
