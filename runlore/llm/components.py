"""Connected components by randomised contraction, for graphs that no machine holds.

Each round every node points at the neighbour (or itself) with the least hash of that round, and the graph is rewritten
between the nodes that are pointed at. A round leaves at most about two thirds of the nodes on average, chains included,
so the rounds grow with the logarithm of the nodes. A node's neighbours are never gathered: the least hash is a partial
aggregate, and the hub of a star is no more work for one task than any other node. Every round ends in written tables.
Once no more than LAST edges are left, whatever the graph was, one task joins them up and saves the last rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import written

#: Edges that one task may join up.
LAST = 4096


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of at most LAST edges."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in up], kind)], ["node", "root"])


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: src, dst (long or string). Returns node, root: a node that stands for the whole component, one row for
    each node that has an edge. Null ends and loops are left out; repeated and reversed edges change nothing; no edges
    give an empty table."""
    flat = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    todo = written(flat.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    steps: list[DataFrame] = []
    while left := todo.count():
        if left <= LAST:
            kind = todo.schema["src"].dataType.simpleString()
            steps.append(written(todo.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"), "points"))
            break
        both = todo.unionByName(todo.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        least = both.groupBy("src").agg(F.min(rank("dst")).alias("m"))
        point = written(least.select(F.col("src").alias("node"), F.least(rank("src"), F.col("m"))["v"].alias("root")), "points")
        steps.append(point)
        ends = todo.join(point.select(F.col("node").alias("src"), F.col("root").alias("a")), "src").join(point.select(F.col("node").alias("dst"), F.col("root").alias("b")), "dst")
        todo = written(ends.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
    if not steps:
        return flat.select(F.col("src").alias("node"), F.col("dst").alias("root")).limit(0)
    out = steps[-1]
    for point in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = point.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return written(out, "components")
