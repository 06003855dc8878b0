"""Artifact files and tasksets."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.functions import variants as V
from runlore.operators.artifacts import artifact_index
from runlore.operators.evaluate import tasks_of


#: Characters of a path that stand for themselves in a file's address.
_AS_IS = "/!$&'()*+,;=:@~"


def ordered_index(files: DataFrame) -> DataFrame:
    """The artifact index of files (path, scope, text, rank) with position: by rank, the index file behind the notes of its
    folder, then by path."""
    index = artifact_index(files)
    return index.withColumn("position", F.struct("rank", (F.col("kind") == "index").alias("last"), "path")).drop("rank")


def _below(root: str, pattern: str) -> str:
    """A pattern of paths: what lies below a folder and looks like pattern from there on."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    start = "" if plain.startswith("/") else ".*/"
    return f"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?{start}{re.escape(quote(plain, safe=_AS_IS))}/{pattern}$"


def read_artifacts(spark: SparkSession, memory: str | None, global_skills: str | None = None, project_skills: str | None = None) -> DataFrame:
    """The artifact index of the files in the given folders, with position: memory notes and the index behind them, then
    global, then project skills, each by path. Notes lie in the memory folder itself, and a skill's file one folder deep;
    deeper files are left out. A folder that is not given adds nothing."""
    parts = []
    for rank, (root, scope) in enumerate(((memory, "project"), (global_skills, "global"), (project_skills, "project"))):
        if root:
            files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
            rows = files.select(F.col("_metadata.file_path").alias("path"), F.lit(scope).alias("scope"), F.col("value").alias("text"), F.lit(rank).alias("rank"))
            parts.append(rows.where(F.col("path").rlike(_below(root, "[^/]*" if rank == 0 else "[^/]*/SKILL\\.md"))))
    if not parts:
        raise ValueError("no folder was given")
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    return ordered_index(files)


def tasks_in(files: DataFrame) -> DataFrame:
    """id, project, reference of the tasks in files (path, value): each a list of tasks, or an object with one under tasks.
    Anything else, an empty id, one that is used twice in all files, or a project that is no object is an error that says
    which."""
    whole = files.select("path", F.try_parse_json("value").alias("v"))
    listed = F.coalesce(V.as_array(F.col("v")), V.as_array(V.get(F.col("v"), "$.tasks")))
    none = F.raise_error(F.concat("path", F.lit(" holds no list of tasks")))
    rows = whole.select(F.when(listed.isNull(), none).otherwise(listed).cast("array<variant>").alias("t"))
    return tasks_of(rows.select(F.explode("t").alias("v")))


def read_taskset(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of a file, or of all files of a folder."""
    return tasks_in(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))
