"""What the operators share: the shared folder, written tables, row keys and Arrow batch sizes."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.folders import new_dir

#: Rows in an Arrow batch: texts can be long, and a Python worker holds a few batches at once.
ARROW_ROWS = 256


def session_setup(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory does not depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


_own = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at its end, but for those with keep, which the scratch around it has, if any."""
    stack = _own.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs nothing that is written."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    for paths in _own.__dict__.get("stack", [])[::-1][int(keep) : int(keep) + 1]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """64 bits of a text; with the row's id they name a row. Equal ids with equal texts are one document."""
    return F.xxhash64(text)
