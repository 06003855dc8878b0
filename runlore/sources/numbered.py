"""Lines of text files with their numbers, where files are read in splits by many tasks.

A split gives its lines in order, with the file's path and the split's first byte. A first pass counts each split's lines;
prefix sums of the counts over a file's splits are the number of each split's first line. So no task holds a file, and
lines are never shuffled: a second pass adds its split's first number to a line's place in the split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from runlore.folders import written
from runlore.functions.text import ANY_LINE_END, PLAIN_LINE_END, lines_of

#: Ends of lines that the reader of splits does not know.
RARE_END = "[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: Splits whose table is sent to all executors; with more it is joined by exchange.
BROADCAST_SPLITS = 100_000


def _reader(spark: SparkSession, recursive: bool, glob: str | None, options: dict[str, str] | None = None) -> DataFrameReader:
    more = {"pathGlobFilter": glob} if glob else {}
    return spark.read.options(recursiveFileLookup=str(recursive).lower(), **more, **(options or {}))


def _placed(spark: SparkSession, paths: str | list[str], recursive: bool, glob: str | None, options: dict[str, str] | None) -> DataFrame:
    """path, start (the split's first byte), place (order of lines in a split; it grows from line to line), line."""
    reader = _reader(spark, recursive, glob, options)
    rows = reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    return rows.withColumn("place", F.monotonically_increasing_id())


def split_starts(lines: DataFrame, ends: str) -> DataFrame:
    """path, start, first_place, n, first_line, rare (whether the file has lines that end otherwise): a row a split."""
    more = F.regexp_count("line", F.lit(RARE_END)) if ends != PLAIN_LINE_END else F.lit(0)
    counts = lines.groupBy("path", "start").agg(F.min("place").alias("first_place"), F.count("*").alias("n"), F.sum(more).alias("more"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    return counts.withColumn("first_line", first).withColumn("rare", F.max("more").over(Window.partitionBy("path")) > 0).drop("more")


def numbered_lines(spark: SparkSession, paths: str | list[str], ends: str = ANY_LINE_END, recursive: bool = False, glob: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """path, line_no (from 0), line: every line of every file, blank ones included, however large the files are.

    Both passes must see the same files: a line that the first pass did not count is an error, not a wrong number. In
    files with rarer line ends (of ANY_LINE_END) a line of the reader can be several; what these add to later numbers is a
    running sum over the file, for such files alone. Where a file ends in one of them and no line feed, one blank line is
    given more. An empty file gives no line. options: of the reader.
    """
    lines = _placed(spark, paths, recursive, glob, options)
    starts = written(split_starts(lines, ends), "splits")
    seen = starts.agg(F.count("*"), F.coalesce(F.bool_or("rare"), F.lit(False))).first()
    small = F.broadcast(starts) if seen[0] <= BROADCAST_SPLITS else starts
    inside = F.col("place") - F.col("first_place")
    counted = F.coalesce(inside.between(0, F.col("n") - 1), F.lit(False))
    said = F.concat(F.lit("lines of "), F.col("path"), F.lit(" changed while they were numbered"))
    number = F.when(counted, F.col("first_line") + inside).otherwise(F.raise_error(said).cast("long"))
    out = lines.join(small, ["path", "start"], "left").select("path", number.alias("line_no"), "line", F.coalesce("rare", F.lit(False)).alias("rare"))
    if not seen[1]:
        return out.select("path", "line_no", "line")
    odd = out.where("rare").withColumn("parts", F.when(F.col("line") == "", F.array(F.lit(""))).otherwise(F.split("line", ends)))
    before = F.coalesce(F.sum(F.size("parts") - 1).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    odd = odd.withColumn("line_no", F.col("line_no") + before).select("path", "line_no", F.posexplode("parts").alias("more", "line"))
    return out.where("not rare").select("path", "line_no", "line").unionByName(odd.select("path", (F.col("line_no") + F.col("more")).alias("line_no"), "line"))


def whole_lines(spark: SparkSession, paths: str | list[str], ends: str = ANY_LINE_END, recursive: bool = False, glob: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """The same for small files: a file is one row until it is cut, so one pass is enough."""
    files = _reader(spark, recursive, glob, options).text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines_in(files, ends)


def lines_in(files: DataFrame, ends: str = ANY_LINE_END) -> DataFrame:
    """path, line_no (from 0), line of small files that are rows (path, value)."""
    return files.select("path", F.posexplode(lines_of(F.col("value"), ends)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def largest_file(spark: SparkSession, paths: str | list[str], recursive: bool = False, glob: str | None = None, options: dict[str, str] | None = None) -> int:
    """Bytes of the largest file, from the listing alone."""
    return _reader(spark, recursive, glob, options).format("binaryFile").load(paths).agg(F.max("length")).first()[0] or 0


#: A file of more bytes is read in splits; below, it is one task's row for a moment.
WHOLE_MOST = 32 << 20


def read_lines(spark: SparkSession, paths: str | list[str], ends: str = ANY_LINE_END, recursive: bool = False, glob: str | None = None, splits: bool | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """path, line_no (from 0), line. splits: whether files are read in splits; by default where one has over WHOLE_MOST
    bytes. Both ways give the same rows."""
    if splits is None:
        splits = largest_file(spark, paths, recursive, glob, options) > WHOLE_MOST
    return (numbered_lines if splits else whole_lines)(spark, paths, ends, recursive, glob, options)
