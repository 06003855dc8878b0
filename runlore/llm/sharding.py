"""Shards of equal size with few cut links, by balanced label propagation (operator 7).

Documents with equal texts are linked. A group of them is a star: each document is linked to its group, never to every
other. Documents begin in shards of exactly equal counts, and in each round the groups count their members by shard and
name the shard that most of them are in; documents elsewhere ask to move there. Moves between two shards are granted in
equal numbers both ways, documents without links filling in for those that ask, so no round changes a shard's count. What is left over is then laid in a line, shard by shard
with each group together, and the line is cut into equal parts, which bounds the documents that the last cut moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.llm.common import written


def place_in_order(df: DataFrame, order: list[Column], name: str, within: list[str] | None = None) -> DataFrame:
    """df with a gapless long column from 0 in the given order, counted over all rows or within columns that lead the
    order. Rows are sorted by ranges and counted by partition; only the partitions' counts meet in one place."""
    spark = df.sparkSession
    keys = [F.col(c) for c in within or []]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    # The number of a row in its partition is in the lower 33 bits.
    rows = written(ranked.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "ordered")
    of = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    counts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    ahead = counts.withColumn("__base", F.sum("__n").over(of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    ahead = ahead.select(*keys, "__part", (F.coalesce("__base", F.lit(0)) - F.col("__first")).alias("__base"))
    # As many rows as partitions, times the groups that a partition begins: fixed by the session, not by the data.
    joined = rows.join(F.broadcast(ahead), [*(within or []), "__part"])
    return joined.withColumn(name, F.col("__at") + F.col("__base")).drop("__at", "__part", "__base")


def assign_shards(docs: DataFrame, shards: int = 16, rounds: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, group (of equal texts), shard, slot: one row for each row of docs. Law: rows; the
    counts of any two shards differ by one at most, and slot is gapless from 0 in each shard.

    Size: the text's UTF-8 bytes plus 1. A null text counts as empty, and is equal to an empty one. Null doc_ids, ties
    and repeated rows are rows like others, told apart by their place. Fewer rows than shards leave shards empty; an
    empty table gives an empty one. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("g1"), F.xxhash64(F.lit(1), "text").alias("g2"))
    # Round 0: any order with equal counts will do; ids spread evenly through it.
    rows = place_in_order(rows, [F.xxhash64("doc_id", "g1", "g2"), F.col("doc_id"), F.col("g1"), F.col("g2")], "row")
    rows = written(rows.withColumn("shard", (F.col("row") % shards).cast("int")), "rows")
    for _ in range(rounds):
        rows = written(moved(rows), "moved")
    line = place_in_order(rows, [F.col("shard"), F.col("g1"), F.col("g2"), F.col("row")], "at")
    n = rows.count()
    # The first n % shards shards get one row more.
    small, more = divmod(n, shards)
    edge = more * (small + 1)
    first = F.col("at") < edge
    shard = F.when(first, F.floor(F.col("at") / (small + 1))).otherwise(more + F.floor((F.col("at") - edge) / max(small, 1)))
    line = line.withColumn("shard", shard.cast("int"))
    base = F.when(first, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - more) * small)
    return line.select("doc_id", "size", "text_crc32", F.col("g1").alias("group"), "shard", (F.col("at") - base).cast("long").alias("slot"))


def moved(rows: DataFrame) -> DataFrame:
    """One round: rows (row, g1, g2, shard and more) with shards after the granted moves. Counts stay as they are."""
    per = rows.groupBy("g1", "g2", "shard").agg(F.count("*").alias("n"))
    # The shard that most of a group is in, the least of equals; groups of one have no wish.
    wish = per.groupBy("g1", "g2").agg(F.max(F.struct("n", (-F.col("shard")).alias("s")))["s"].alias("s"), F.sum("n").alias("all"), F.max("n").alias("most"))
    # Written, so that the join with a large group's rows has an exchange on either side and can be split.
    wish = written(wish.where("all > 1 and most < all").select("g1", "g2", (-F.col("s")).alias("to")), "wishes")
    asks = written(rows.join(wish, ["g1", "g2"]).where("to <> shard").select("row", F.col("shard").alias("from"), "to"), "asks")
    alone = written(per.groupBy("g1", "g2").agg(F.sum("n").alias("all")).where("all = 1").select("g1", "g2"), "alone")
    free = written(place_in_order(rows.join(alone, ["g1", "g2"]).select("row", "shard"), [F.xxhash64("row"), F.col("row")], "at", ["shard"]), "free")
    # Quotas, at most a row for each pair of shards: as many from a to b as from b to a, and beyond that as many as b has
    # documents without links to give back.
    flow = asks.groupBy("from", "to").agg(F.count("*").alias("n"))
    back = flow.select(F.col("from").alias("to"), F.col("to").alias("from"), F.col("n").alias("back"))
    spare = free.groupBy(F.col("shard").alias("to")).agg(F.count("*").alias("spare"))
    flow = flow.join(back, ["from", "to"], "left").join(spare, "to", "left").fillna(0, ["back", "spare"])
    flow = flow.withColumn("over", F.greatest(F.col("n") - F.col("back"), F.lit(0)))
    before = F.coalesce(F.sum("over").over(Window.partitionBy("to").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flow = flow.withColumn("first", before).withColumn("given", F.greatest(F.lit(0), F.least("over", F.col("spare") - F.col("first"))))
    flow = written(flow.withColumn("quota", F.least("n", "back") + F.col("given")), "flow")
    place = place_in_order(asks.join(F.broadcast(flow.select("from", "to", "quota")), ["from", "to"]), [F.xxhash64("row"), F.col("row")], "at", ["from", "to"])
    granted = place.where("at < quota").select("row", "to")
    returned = flow.where("given > 0").select(F.col("to").alias("shard"), F.col("from").alias("to"), "first", "given")
    swapped = free.join(F.broadcast(returned), "shard").where("at >= first and at < first + given").select("row", "to")
    return rows.join(granted.unionByName(swapped), "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
