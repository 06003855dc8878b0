"""Conversation files of two vendors as transcripts: session files with their sub-agents' files, and rollouts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.functions import variants as V
from runlore.functions.text import ANY_LINE_END, PLAIN_LINE_END
from runlore.operators.render import event_line, identified, joined_lines, rollout_line
from runlore.sources.jsonl import parsed
from runlore.sources.numbered import lines_in, read_lines

#: Lines of a rollout in which its session_meta is looked for.
META_LINES = 50
ROLLOUTS = "rollout-*.jsonl"
#: Where files of sessions and sub-agents are, and their parts: project, session; and of the latter subpath and id.
SESSION_PLACE = "projects/([^/]+)/([^/]+)\\.jsonl$"
AGENT_PLACE = "projects/([^/]+)/([^/]+)/(subagents/(?:.*/)?agent-([^/]*))\\.jsonl$"


def _files(spark: SparkSession, paths: str | list[str], glob: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _lines(spark: SparkSession, paths: str | list[str], glob: str, ends: str, splits: bool | None) -> DataFrame:
    """path, line_no, line, v of every line; blank and torn ones have no v. A live file's torn last line must not lose the
    conversation."""
    return parsed(read_lines(spark, paths, ends, recursive=True, glob=glob, splits=splits))


def _listed(spark: SparkSession, paths: str | list[str], glob: str) -> DataFrame:
    """path, modified of every file, from the listing alone: an empty one too."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.load(paths).select(F.col("_metadata.file_path").alias("path"), F.col("modificationTime").alias("modified"))


def rendered(files: DataFrame, lines: DataFrame, line) -> DataFrame:
    """files (path and others) with text; empty where a file has no line that shows."""
    text = joined_lines(lines.withColumn("shown", line(F.col("v"))), ["path"], "line_no", "shown")
    return files.join(text, "path", "left").withColumn("text", F.coalesce("text", F.lit("")))


def session_transcripts(spark: SparkSession, storage: str, splits: bool | None = None, place: str = SESSION_PLACE, glob: str = "*.jsonl") -> DataFrame:
    """path, project, session, text of every <storage>/<project>/<session>.jsonl; deeper files are not sessions. splits:
    as for read_lines. place, glob: where files are, if not there."""
    return _sessions(_listed(spark, storage, glob), _lines(spark, storage, glob, ANY_LINE_END, splits), place)


def packed_sessions(files: DataFrame, place: str = SESSION_PLACE) -> DataFrame:
    """session_transcripts of a store that is a table of files (path, value). Very many small files are kept so, as to list
    and open each of them takes longer than to read its lines."""
    files = files.where(F.regexp_extract("path", place, 2) != "")
    return _sessions(files, parsed(lines_in(files)), place)


def _sessions(files: DataFrame, lines: DataFrame, place: str) -> DataFrame:
    part = lambda i: F.regexp_extract("path", place, i)
    found = files.select("path", part(1).alias("project"), part(2).alias("session")).where("session <> ''")
    return rendered(found, lines.where(part(2) != ""), event_line)


def sidecars_of(files: DataFrame) -> DataFrame:
    """stem, agent_type, depth, description, parent_agent from files (path, value) of .meta.json; each key is null on its
    own where it is absent or of another type, and all are null in a torn file."""
    v = F.try_parse_json("value")
    text = lambda k: F.when(V.as_str(V.get(v, k)) != "", V.as_str(V.get(v, k)))
    return files.select(
        F.regexp_replace("path", "\\.meta\\.json$", "").alias("stem"),
        text("$.agentType").alias("agent_type"),
        V.as_int(V.get(v, "$.spawnDepth")).alias("depth"),
        text("$.description").alias("description"),
        text("$.parentAgentId").alias("parent_agent"),
    )


def sidecars(spark: SparkSession, storage: str) -> DataFrame:
    return sidecars_of(_files(spark, storage, "*.meta.json"))


def subagent_transcripts(spark: SparkSession, storage: str, sessions: DataFrame, splits: bool | None = None, place: str = AGENT_PLACE, glob: str = "agent-*.jsonl") -> DataFrame:
    """path, project, session, id, subpath, workflow, agent_type, depth, description, parent_agent, text of every
    agent-*.jsonl below a session that is present."""
    lines = _lines(spark, storage, glob, ANY_LINE_END, splits)
    return _subagents(_listed(spark, storage, glob), lines, sessions, sidecars(spark, storage), place)


def packed_subagents(files: DataFrame, sessions: DataFrame, place: str = AGENT_PLACE) -> DataFrame:
    """subagent_transcripts of a store that is a table of files (path, value), sidecars among them."""
    own = files.where(F.regexp_extract("path", place, 2) != "")
    return _subagents(own, parsed(lines_in(own)), sessions, sidecars_of(files.where(F.col("path").endswith(".meta.json"))), place)


def _subagents(files: DataFrame, lines: DataFrame, sessions: DataFrame, beside: DataFrame, place: str) -> DataFrame:
    part = lambda i: F.regexp_extract("path", place, i)
    found = files.select("path", part(1).alias("project"), part(2).alias("session"), part(3).alias("subpath"), part(4).alias("id")).where("session <> ''")
    found = found.join(sessions.select("project", "session").distinct(), ["project", "session"], "left_semi")
    workflow = F.regexp_extract("subpath", "(?:^|/)workflows/([^/]+)/", 1)
    rows = found.withColumn("workflow", F.when(workflow != "", workflow)).withColumn("stem", F.regexp_replace("path", "\\.jsonl$", ""))
    return rendered(rows.join(beside, "stem", "left").drop("stem"), lines, lambda v: event_line(v, include_sidechain=True))


def corpora(spark: SparkSession, storage: str, include_subagents: bool = False) -> DataFrame:
    """project, transcript_index, path, kind, id, session, parent, text of all transcripts below storage. With sub-agents
    every text has its header. Empty sub-agents have no entry; empty sessions do."""
    sessions = session_transcripts(spark, storage)
    own = sessions.select("path", "project", "session", F.col("session").alias("id"), F.lit("session").alias("kind"), "text")
    for name, kind in (("subpath", "string"), ("workflow", "string"), ("parent_agent", "string"), ("agent_type", "string"), ("depth", "long"), ("description", "string")):
        own = own.withColumn(name, F.lit(None).cast(kind))
    out = ["project", "transcript_index", "path", "kind", "id", "session", "parent", "text"]
    if not include_subagents:
        from runlore.operators.render import numbered

        return numbered(own, ["project"]).withColumn("parent", F.lit("")).select(*out)
    agents = subagent_transcripts(spark, storage, sessions).withColumn("kind", F.lit("subagent"))
    return identified(own.unionByName(agents, allowMissingColumns=True), ["project"]).select(*out)


def first_cwds(lines: DataFrame) -> DataFrame:
    """path, cwd: of the first session_meta in the first META_LINES lines; null if that one is malformed, as no later one
    is tried. Files without one have no row."""
    meta = lines.where((F.col("line_no") < META_LINES) & (V.as_str(V.get(F.col("v"), "$.type")) == "session_meta"))
    cwd = V.as_str(V.get(V.get(F.col("v"), "$.payload"), "$.cwd"))
    return meta.groupBy("path").agg(F.min_by(F.when(cwd != "", cwd), "line_no").alias("cwd"))


def rollout_index(spark: SparkSession, storage: str, index_dir: str, glob: str = ROLLOUTS, splits: bool | None = None) -> DataFrame:
    """path, cwd, modified of every rollout, from a table in index_dir that is made longer: only files that were modified
    since the last time are opened, and what they say is appended as one more part of the table.

    A part is numbered and replaces itself where it is written again after a failure. A file that changed has a row in
    several parts, of which its latest counts; one that is gone has no row. Two writers at once are not for one table.
    """
    listed = _listed(spark, storage, glob)
    known = _indexed(spark, index_dir)
    number, last = known.agg(F.coalesce(F.max("part"), F.lit(-1)) + 1, F.max("modified").cast("string")).first()
    new = listed.join(known.select("path", "modified"), ["path", "modified"], "left_anti")
    # The reader leaves out, by the listing alone, what is not newer than a moment before the newest file that is known.
    since = {} if last is None else {"modifiedAfter": (datetime.fromisoformat(last) - timedelta(seconds=1)).isoformat()}
    lines = parsed(read_lines(spark, storage, PLAIN_LINE_END, recursive=True, glob=glob, splits=splits, options=since))
    found = new.join(first_cwds(lines), "path", "left").select("path", "cwd", "modified")
    found.write.mode("overwrite").parquet(f"{index_dir}/part={number}")
    latest = _indexed(spark, index_dir).groupBy("path").agg(F.max_by(F.struct("cwd", "modified"), F.struct("modified", "part")).alias("r"))
    return latest.select("path", "r.*").join(listed.select("path"), "path", "left_semi")


def _indexed(spark: SparkSession, index_dir: str) -> DataFrame:
    schema = "path string, cwd string, modified timestamp, part int"
    try:
        return spark.read.schema(schema).parquet(index_dir)
    except AnalysisException as e:  # no index yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def rollouts(spark: SparkSession, storage: str, projects: DataFrame | None = None, index: DataFrame | None = None, splits: bool | None = None, glob: str = ROLLOUTS) -> DataFrame:
    """path, cwd, text of every rollout; cwd as first_cwds, or from an index (rollout_index), which spares reading all
    files for it. projects (cwd): only rollouts recorded in one of them are rendered."""
    files = _listed(spark, storage, glob).select("path")
    found = index.select("path", "cwd") if index is not None else first_cwds(_lines(spark, storage, glob, PLAIN_LINE_END, splits))
    known = files.join(found, "path", "left")
    if projects is not None:
        known = known.join(projects.select("cwd").distinct(), "cwd", "left_semi")
    lines = _lines(spark, storage, glob, PLAIN_LINE_END, splits)
    if projects is not None:
        lines = lines.join(known.select("path"), "path", "left_semi")
    return rendered(known, lines, rollout_line).select("path", "cwd", "text")
