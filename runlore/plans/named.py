"""Queries over files with names of their own, seen in documents: artifacts, instructions, sidecars, tasksets; and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.functions.redaction import redact
from runlore.operators import artifacts, evaluate, render
from runlore.plans.derived import table
from runlore.plans.registry import query
from runlore.sources.conversations import sidecars_of
from runlore.sources.files import ordered_index, tasks_in


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i (doc_id), project (one for every forty), body (text, not null)."""
    rows = table(spark, sf_dir, "documents")
    project = F.concat(F.lit("p"), F.floor(F.col("doc_id") / 40).cast("string"))
    return rows.select(F.col("doc_id").alias("i"), project.alias("project"), F.coalesce("text", F.lit("")).alias("body"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


_DOCUMENTS = "d AS (SELECT doc_id AS i, 'p' || (doc_id // 40) AS project, coalesce(text, '') AS body FROM documents)"


@query(f"""WITH {_DOCUMENTS}, f AS (
  SELECT *, CASE WHEN i % 40 = 7 THEN 'index' WHEN i % 4 < 2 THEN 'memory' ELSE 'skill' END AS kind, CASE WHEN i % 40 <> 7 AND i % 4 = 2 THEN 'global' ELSE 'project' END AS scope,
    '/' || project || CASE WHEN i % 40 = 7 THEN '/memory/MEMORY.md' WHEN i % 4 < 2 THEN '/memory/n' || i || '.md' WHEN i % 4 = 2 THEN '/g/s' || i || '/SKILL.md' ELSE '/s/s' || i || '/SKILL.md' END AS path FROM d WHERE i % 10 <> 9 OR i % 40 = 7
), named AS (
  SELECT *, CASE kind WHEN 'index' THEN 'MEMORY.md' ELSE CASE i % 3 WHEN 0 THEN 'N ' || i WHEN 1 THEN i::VARCHAR ELSE CASE kind WHEN 'memory' THEN 'n' ELSE 's' END || i END END AS name,
    CASE WHEN kind = 'index' THEN 'The memory index this harness maintains over the memory files.' WHEN i % 3 = 0 THEN 'about ' || i ELSE '(no description)' END AS said FROM f
) SELECT project, string_agg('- [' || kind || '] ' || name || ': ' || said || ' (' || path || ')', chr(10) ORDER BY kind = 'skill', scope, kind = 'index', path) AS lines, count(*) AS n, sum(length(body)) AS chars FROM named GROUP BY project""")
def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes, index files and skills of projects, with names, numbers for names and none, beside other files;
    each project's artifact index as lines."""
    rows, i = _documents(spark, sf_dir), F.col("i")
    index, note, shared = i % 40 == 7, i % 4 < 2, i % 4 == 2
    place = F.when(index, "/memory/MEMORY.md").when(i % 10 == 9, _text("/docs/n", i, ".md")).when(note, _text("/memory/n", i, ".md"))
    path = F.concat(F.lit("/"), "project", place.when(shared, _text("/g/s", i, "/SKILL.md")).otherwise(_text("/s/s", i, "/SKILL.md")))
    block = F.when(i % 3 == 0, _text("---\nname: N ", i, "\ndescription: about ", i, "\n---\n")).when(i % 3 == 1, _text("---\nname: ", i, "\n---\n"))
    rank = F.when(index | note, 0).when(shared, 1).otherwise(2)
    scope = F.when(~index & ~note & shared, "global").otherwise("project")
    files = rows.select("project", path.alias("path"), scope.alias("scope"), F.concat(F.coalesce(block, F.lit("")), "body").alias("text"), rank.alias("rank"), F.length("body").alias("chars"))
    found = ordered_index(files)
    counts = found.groupBy("project").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    return render.index_lines(found, ["project"]).withColumnRenamed("text", "lines").join(counts, "project")


_SECRET = "'AKIA' || repeat('C', 16)"


@query(rf"""WITH {_DOCUMENTS}, f AS (SELECT *, i % 40 // 3 AS kind, i % 3 AS depth FROM d), best AS (
  SELECT project, depth, arg_min(CASE WHEN kind = 1 AND i % 4 = 1 THEN ' ' || chr(10) ELSE body || ' ' || {_SECRET} || chr(10) END, -kind) AS text FROM f WHERE kind < 2 GROUP BY project, depth
) SELECT project, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY depth), '\bAKIA[0-9A-Z]{{16}}\b', '[REDACTED:aws_access_key_id]', 'g') AS text FROM best WHERE trim(text, E' \n\t\r') <> '' GROUP BY project""")
def nested_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as instruction files of nested directories, overrides (some of them blank) and other files beside; each
    project's instructions, redacted."""
    rows, i = _documents(spark, sf_dir), F.col("i")
    kind = F.floor(i % 40 / 3)
    name = F.when(kind == 0, "AGENTS.md").when(kind == 1, "AGENTS.override.md").otherwise("README.md")
    text = F.when((kind == 1) & (i % 4 == 1), " \n").otherwise(F.concat("body", F.lit(" AKIA" + "C" * 16 + "\n")))
    files = rows.select("project", _text("d", i % 3).alias("directory"), (i % 3).alias("depth"), name.alias("name"), text.alias("text"))
    found = artifacts.project_instructions(files)
    return found.select("project", redact(F.col("text")).alias("text"))


@query(rf"""WITH {_DOCUMENTS}, f AS (SELECT project, i % 40 AS k, i // 40 AS p, body FROM d), best AS (
  SELECT project, arg_min(k, k) AS k, arg_min(CASE WHEN k = 0 AND p % 5 = 2 THEN '' ELSE body END, k) AS text FROM f WHERE k = 1 AND p % 7 <> 3 OR k = 0 AND p % 3 <> 1 GROUP BY project
) SELECT project, CASE k WHEN 0 THEN 'CLAUDE.md' ELSE '.claude/CLAUDE.md' END AS path, CASE WHEN text = '' THEN '' ELSE text || ' [REDACTED:aws_access_key_id]' END AS text FROM best""")
def root_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the other vendor's instruction files, of which a project has one, the other, both or none; redacted
    unless empty."""
    rows, k, p = _documents(spark, sf_dir), F.col("i") % 40, F.floor(F.col("i") / 40)
    path = F.when((k == 0) & (p % 3 != 1), "CLAUDE.md").when((k == 1) & (p % 7 != 3), ".claude/CLAUDE.md").otherwise(F.concat(F.lit("sub/"), k.cast("string"), F.lit("/CLAUDE.md")))
    text = F.when(((k == 0) & (p % 5 == 2)) | (F.col("body") == ""), "").otherwise(F.concat("body", F.lit(" AKIA" + "C" * 16)))
    found = artifacts.root_instructions(rows.select("project", path.alias("relative_path"), text.alias("text")))
    return found.withColumn("text", F.when(F.length("text") > 0, redact(F.col("text"))).otherwise(F.col("text")))


@query(f"""WITH {_DOCUMENTS} SELECT '/s/agent-' || i AS stem, CASE WHEN i % 6 = 5 OR i % 4 > 1 THEN NULL ELSE 'kind ' || i END AS agent_type, CASE WHEN i % 6 < 5 AND i % 5 < 2 THEN i % 7 END AS depth,
  CASE WHEN i % 6 < 5 AND body <> '' THEN body END AS description, CASE WHEN i % 6 < 5 AND i % 3 = 0 THEN 'a' || i END AS parent_agent FROM d""")
def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sidecars of sub-agents: keys of other types, empty and absent ones, torn files, whole texts."""
    rows, i = _documents(spark, sf_dir), F.col("i")
    kind = F.when(i % 4 < 2, _text('"agentType": "kind ', i, '", ')).when(i % 4 == 2, '"agentType": "", ').otherwise('"agentType": 3, ')
    depth = F.when(i % 5 < 2, _text('"spawnDepth": ', i % 7, ", ")).when(i % 5 == 2, '"spawnDepth": true, ').when(i % 5 == 3, '"spawnDepth": "2", ').otherwise('"spawnDepth": 1.5, ')
    parent = F.when(i % 3 == 0, _text('"parentAgentId": "a', i, '", ')).when(i % 3 == 1, '"parentAgentId": null, ').otherwise("")
    rest = F.to_json(F.struct(F.col("body").alias("description")))
    value = F.concat(F.lit("{"), kind, depth, parent, F.substring(rest, 2, 1 << 30))
    torn = F.when(i % 6 == 5, F.concat(F.lit("["), value)).otherwise(value)
    return sidecars_of(rows.select(_text("/s/agent-", i, ".meta.json").alias("path"), torn.alias("value")))


@query(f"""WITH {_DOCUMENTS} SELECT 't' || i AS id, CASE WHEN i % 3 > 0 THEN '{{"p":' || (i % 3) || '}}' END AS project, CASE WHEN i % 4 = 3 THEN '' ELSE body END AS reference FROM d""")
def taskset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tasks in files of forty: lists, and objects with a list; references are whole texts, none, or no text."""
    rows, i = _documents(spark, sf_dir), F.col("i")
    reference = F.when(i % 4 < 3, F.to_variant_object(F.array("body"))).otherwise(F.to_variant_object(F.array(F.lit(7))))
    task = F.struct(_text("t", i).alias("id"), F.when(i % 3 > 0, F.struct((i % 3).alias("p"))).alias("project"), F.variant_get(reference, "$[0]", "variant").alias("reference"))
    files = rows.groupBy("project").agg(F.to_json(F.collect_list(task)).alias("tasks"))
    value = F.when(F.substring("project", -1, 1).cast("int") % 2 == 0, F.col("tasks")).otherwise(F.concat(F.lit('{"tasks": '), "tasks", F.lit("}")))
    return tasks_in(files.select(F.col("project").alias("path"), value.alias("value"))).select("id", F.to_json("project").alias("project"), "reference")


@query("""WITH r AS (SELECT 'document-number-' || lpad((doc_id * 7919)::VARCHAR, 12, '0') AS run_id, quality = 1 AS ok, n_chars % 41 / 4.0 AS tf, n_chars % 11 * 1.0 AS ta, doc_id % 21 / 2.0 AS tg, toxic * 9.75 AS pa, source, doc_id FROM documents JOIN labels USING (doc_id)),
  shown AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '  transcripts=' || (doc_id % 9) ELSE '  transcripts=' || (doc_id % 9) || ' (sessions=' || (doc_id % 4) || ' subagents=2)' END AS suffix FROM r)
SELECT 1 AS part, run_id, rpad(left(run_id, 24), 24, ' ') || CASE WHEN ok THEN format('  {:4.1f}  {:4.1f}  {:4.1f}  {:4.1f}  ', tf::DOUBLE, ta::DOUBLE, tg::DOUBLE, pa::DOUBLE) || source ELSE '    --    --    --    --  unscored: no reply' END || suffix AS line FROM shown
UNION ALL SELECT 0, NULL, rpad('run_id', 24, ' ') || '  TF    TA    TG    PA   notes'
UNION ALL SELECT 2, NULL, CASE WHEN count(*) FILTER (ok) > 0 THEN repeat('-', 24 + length('  TF    TA    TG    PA   notes')) ELSE '(no runs scored)' END FROM r
UNION ALL SELECT 3, NULL, rpad('mean', 24, ' ') || format('  {:4.1f}  {:4.1f}  {:4.1f}  {:4.1f}', avg(tf::DOUBLE), avg(ta::DOUBLE), avg(tg::DOUBLE), avg(pa::DOUBLE)) FROM r WHERE ok HAVING count(*) > 0
UNION ALL SELECT 4, NULL, 'n=' || count(*) || ' (' || (count(*) FILTER (NOT ok)) || ' unscored)  judge=stub  prompt=v1  caps=plan:40000/transcript:60000/total:240000' FROM r""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch report of scored and unscored rows, line by line."""
    d, i = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), F.col("doc_id")
    name = F.concat(F.lit("document-number-"), F.lpad((i * 7919).cast("string"), 12, "0"))
    ok = F.col("quality") == 1
    given = {"TF": F.col("n_chars") % 41 / 4, "TA": (F.col("n_chars") % 11).cast("double"), "TG": i % 21 / 2, "PA": F.col("toxic") * F.lit(9.75)}
    scores = [F.when(ok, c).alias(n) for n, c in given.items()]
    some = [F.when(i % 3 > 0, i % 9).alias("n_transcripts"), F.when(i % 3 == 2, i % 4).alias("transcript_sessions"), F.when(i % 3 == 2, 2).alias("transcript_subagents")]
    rows = d.select(name.alias("run_id"), *scores, F.col("source").alias("notes"), F.when(~ok, "no reply").alias("unscored_reason"), *some)
    return evaluate.report_lines(rows, "stub", "v1", ["run_id"])
