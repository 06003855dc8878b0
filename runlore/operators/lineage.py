"""Which transcripts of a session are independent evidence: neither descends from the other, and they are not siblings.

Every node gets the place where its subtree begins in preorder and the subtree's size, so a request is decided by two
intervals and two parents, and no table of pairs is made. Both numbers come from pointer doubling: in round k a node knows
its ancestor 2^k levels up, so a forest of depth d takes about 2 log2 d rounds of joins by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlore.folders import written


def forest(parents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, parent of every node once. A parent without a row is a root; a node's own parent is the least that it is
    given, and a node that names itself has none."""
    rows = parents.where("id is not null").select(*keys, "id", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent"))
    above = rows.where("parent is not null").select(*keys, F.col("parent").alias("id"), F.lit(None).cast(rows.schema["parent"].dataType).alias("parent"))
    return rows.unionByName(above).groupBy(*keys, "id").agg(F.min("parent").alias("parent"))


def _jumped(rows: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """rows with what the node at jump has in jump and more, as next_*; null where there is no jump."""
    up = rows.select(*keys, F.col("id").alias("jump"), F.col("jump").alias("next_jump"), *(F.col(c).alias(f"next_{c}") for c in more))
    return rows.join(up, [*keys, "jump"], "left")


def _before(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with before: the sizes of a node's earlier siblings, by id; roots are siblings in their session. A parent can
    have very many children: these are summed in ranges, and the ranges' sums are added up."""
    ranged = written(rows.repartitionByRange(*keys, "parent", "id").withColumn("range", F.spark_partition_id()), "ranges")
    group = [*keys, "parent"]
    inside = Window.partitionBy("range", *group).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range", *group).agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("carried", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).drop("sum")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("range", *group)]
    left = ranged.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r")
    on = same[0]
    for x in same[1:]:
        on = on & x
    return left.join(sums.alias("s"), on).select("r.*", (F.col("r.own") + F.col("s.carried")).alias("before")).drop("own", "range")


def intervals(parents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, parent, entry, size of every node of parents (keys, id, parent): its subtree is what has an entry from
    entry up to, but not with, entry + size, in its session. Null for nodes on or below a cycle. Keys must not be null."""
    nodes = written(forest(parents, keys), "forest")
    n = nodes.count()
    rows, rounds = nodes.withColumn("jump", F.col("parent")).withColumn("size", F.lit(1).cast("long")), 0
    while rows.where("jump is not null").limit(1).count() and 1 << rounds <= n:
        below = rows.where("jump is not null").groupBy(*keys, F.col("jump").alias("id")).agg(F.sum("size").alias("more"))
        step = _jumped(rows, keys, []).join(below, [*keys, "id"], "left")
        rows = written(step.select(*keys, "id", "parent", F.col("next_jump").alias("jump"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
        rounds += 1
    cyclic = rows.where("jump is not null").select(*keys, "id", "parent")
    sound = _before(rows.where("jump is null").drop("jump"), keys)
    # A root begins behind the roots before it; a child one behind its parent and behind its earlier siblings.
    at = F.col("before") + F.when(F.col("parent").isNull(), 0).otherwise(1)
    rows = written(sound.select(*keys, "id", "parent", "size", F.col("parent").alias("jump"), at.alias("entry")), "offsets")
    for _ in range(rounds):
        step = _jumped(rows, keys, ["entry"])
        rows = written(step.select(*keys, "id", "parent", "size", F.col("next_jump").alias("jump"), (F.col("entry") + F.coalesce("next_entry", F.lit(0))).alias("entry")), "entries")
    return rows.select(*keys, "id", "parent", "entry", "size").unionByName(cyclic, allowMissingColumns=True)


def independence(requests: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """requests (keys, a, b and any other columns) with independent. A node is not independent of itself, of what it
    descends from or what descends from it, nor of its siblings. Nodes on or below a cycle have no place and count as
    dependent; ids without a row are independent of all others."""
    placed = intervals(parents, keys)
    end = lambda side: placed.select(*keys, F.col("id").alias(side), F.struct("parent", "entry", "size").alias(f"{side}_node"))
    # The request travels in a struct, so that no column of its own can clash.
    rows = requests.select(F.struct(*requests.columns).alias("row"), *keys, "a", "b")
    rows = rows.join(end("a"), [*keys, "a"], "left").join(end("b"), [*keys, "b"], "left")
    a, b = F.col("a_node"), F.col("b_node")
    inside = lambda x, y: (x["entry"] <= y["entry"]) & (y["entry"] < x["entry"] + x["size"])
    both = a.isNotNull() & b.isNotNull()
    unplaced = both & (a["entry"].isNull() | b["entry"].isNull())
    dependent = both & (unplaced | inside(a, b) | inside(b, a) | F.coalesce(a["parent"] == b["parent"], F.lit(False)))
    same = F.col("a").eqNullSafe(F.col("b"))
    return rows.select("row.*", (~(same | F.coalesce(dependent, F.lit(False)))).alias("independent"))


def dependent_counts(parents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: the number of pairs of a session that are not independent, from sizes alone: of every node its
    descendants, and of every parent the pairs of its children."""
    placed = intervals(parents, keys).where("entry is not null")
    below = placed.groupBy(*keys).agg(F.sum(F.col("size") - 1).alias("below"))
    children = placed.where("parent is not null").groupBy(*keys, "parent").agg(F.count("*").alias("c"))
    siblings = children.groupBy(*keys).agg(F.sum(F.expr("c * (c - 1) div 2")).alias("siblings"))
    out = below.join(siblings, keys, "left").select(*keys, (F.col("below") + F.coalesce("siblings", F.lit(0))).alias("n"))
    return out.where("n > 0")
