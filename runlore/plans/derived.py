"""The driver's events table seen as run traces, and its conversations as transcripts: once for Spark, once as SQL.

run_id u<user>; step by time; signup at an even step is a run_start and at an odd one a result with k % 5 candidates;
click is a turn, view a read, purchase a draft (every third one of a supplementary file), error a sub call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlore.operators.runs import ACTIONS, CAUSES, DRAFT_TOOLS, EXTRA_TOOL, READ_TOOLS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(items: list[str], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, items)), (i + 1).cast("int"))


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, run_id, step, ts_s, event_type, k."""
    e = table(spark, sf_dir, "events")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"),
        (F.row_number().over(by) - 1).cast("long").alias("step"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_s"),
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in the schema of sources.traces."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    k, step, kind = F.col("k"), F.col("step"), F.col("event_type")
    text = lambda *parts: F.concat(*(x.cast("string") for x in parts))
    cause = pick(CAUSES, k % 4)
    artifact = text(F.lit("a"), k % 17)
    call = {"cause": cause, "ok": cause == "ok", "artifact_id": artifact, "draft": F.when(k % 10 == 0, F.lit("")).otherwise(text(F.lit("text of "), artifact)), "errors": F.array(text(F.lit("e"), k)), "circuit_broken": cause == "circuit_broken", "endpoint_error": F.when(cause == "endpoint", F.lit(""))}
    obj = lambda **c: F.to_variant_object(F.struct(*(v.alias(n) for n, v in c.items())))
    candidate = lambda j: F.struct(
        pick(ACTIONS, (k + j) % 4).alias("action"),
        F.when((k + j) % 4 >= 2, text(F.lit("a"), (k * 3 + j) % 17)).alias("artifact_id"),
        F.struct(F.when((k + j) % 3 > 0, text(F.lit("m"), j)).alias("target_path"), pick(["project", "global", "else"], (k + j) % 3).alias("scope")).alias("key_fields"),
    )
    candidates = F.when(k % 5 > 0, F.transform(F.sequence(F.lit(0).cast("long"), k % 5 - 1), candidate)).otherwise(F.array())
    payload = (
        F.when((kind == "signup") & (step % 2 == 0), obj(meta=F.struct(k.alias("transcripts"), (k % 40 - 2).alias("max_iterations"), text(F.lit("/home/p"), k).alias("project_dir"))))
        .when(kind == "signup", obj(output=F.struct(candidates.alias("candidates"))))
        .when(kind == "click", obj(turn=k, reasoning=text(F.lit("r"), k), code=text(F.lit("c"), k), output=text(F.lit("o"), step)))
        .when(kind == "view", obj(tool=pick(READ_TOOLS, k % 3), args=F.struct((k % 7).alias("transcript_index"), k.alias("offset")), ok=k % 5 > 0))
        .when((kind == "purchase") & (k % 3 == 2), obj(tool=F.lit(EXTRA_TOOL), relative_path=text(F.lit("references/"), k % 4, F.lit(".md")), **call))
        .when(kind == "purchase", obj(tool=pick(DRAFT_TOOLS, k % 2), **call))
        .otherwise(obj(name=text(F.lit("m"), k % 3), input=text(F.lit("i"), k), raw=text(F.lit("w"), k)))
    )
    names = F.when((kind == "signup") & (step % 2 == 0), "run_start").when(kind == "signup", "result").when(kind == "click", "main_step").when(kind == "error", "sub_call").otherwise("tool_call")
    return flat_events(spark, sf_dir).select(F.lit("events").alias("path"), step.alias("line_no"), "run_id", step.cast("string").alias("step_id"), step.alias("step_key"), F.col("ts_s").alias("ts"), F.col("ts_s").alias("ts_any"), names.alias("type"), payload.alias("payload"))


def _case(items: list[str], i: str) -> str:
    return f"(['{"', '".join(items)}'])[({i})::INT + 1]"


#: The same for DuckDB: events as flat columns; candidates as rows.
TRACE_SQL = f"""
WITH flat AS (
  SELECT event_id, 'u' || user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, epoch_us(ts) / 1e6 AS ts, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events
), ev AS (
  SELECT *, CASE WHEN event_type = 'signup' AND step % 2 = 0 THEN 'run_start' WHEN event_type = 'signup' THEN 'result' WHEN event_type = 'click' THEN 'main_step' WHEN event_type = 'error' THEN 'sub_call' ELSE 'tool_call' END AS type,
    CASE WHEN event_type = 'view' THEN {_case(READ_TOOLS, "k % 3")} WHEN event_type = 'purchase' AND k % 3 = 2 THEN '{EXTRA_TOOL}' WHEN event_type = 'purchase' THEN {_case(DRAFT_TOOLS, "k % 2")} END AS tool,
    CASE WHEN event_type = 'purchase' THEN 'a' || (k % 17) END AS artifact_id, CASE WHEN event_type = 'purchase' THEN {_case(CAUSES, "k % 4")} END AS cause,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 10 = 0 THEN '' ELSE 'text of a' || (k % 17) END END AS draft
  FROM flat
), runs AS (SELECT DISTINCT run_id FROM ev), last_result AS (
  SELECT run_id, max_by(k, step) AS k FROM ev WHERE type = 'result' GROUP BY run_id
), cand AS (
  SELECT run_id, j AS index, {_case(ACTIONS, "(k + j) % 4")} AS action, CASE WHEN (k + j) % 4 >= 2 THEN 'a' || ((k * 3 + j) % 17) END AS artifact_id, CASE WHEN (k + j) % 3 > 0 THEN 'm' || j END AS target_path, {_case(["project", "global", "else"], "(k + j) % 3")} AS scope
  FROM (SELECT run_id, k, unnest(range(0, k % 5)) AS j FROM last_result)
), draft_call AS (
  SELECT run_id, tool, artifact_id, max_by(k, step) AS k, max_by(cause, step) AS cause, max_by(draft, step) AS draft FROM ev WHERE tool IN ('{"', '".join(DRAFT_TOOLS)}') GROUP BY ALL
), extra_call AS (
  SELECT run_id, artifact_id, 'references/' || (k % 4) || '.md' AS relative_path, max_by(k, step) AS k, max_by(cause, step) AS cause, max_by(draft, step) AS draft, min(step) AS seen FROM ev WHERE tool = '{EXTRA_TOOL}' GROUP BY run_id, artifact_id, k % 4
), joined AS (
  SELECT c.*, CASE action WHEN 'promote_to_memory' THEN 'draft_memory_file' WHEN 'promote_to_skill' THEN 'draft_skill_file' END AS tool, d.k AS dk, d.cause AS cause, d.draft AS draft, o.tool AS other
  FROM cand c LEFT JOIN draft_call d ON d.run_id = c.run_id AND d.artifact_id = c.artifact_id AND d.tool = CASE action WHEN 'promote_to_memory' THEN 'draft_memory_file' WHEN 'promote_to_skill' THEN 'draft_skill_file' END
  LEFT JOIN draft_call o ON o.run_id = c.run_id AND o.artifact_id = c.artifact_id AND o.tool = CASE action WHEN 'promote_to_memory' THEN 'draft_skill_file' WHEN 'promote_to_skill' THEN 'draft_memory_file' END
), extra_problem AS (
  SELECT j.run_id, j.index, count(*) AS n, sum((x.draft = '')::INT + (x.cause <> 'ok')::INT) AS bad, string_agg(x.relative_path, ',' ORDER BY x.seen) AS files
  FROM joined j JOIN extra_call x ON j.run_id = x.run_id AND j.artifact_id = x.artifact_id WHERE j.action = 'promote_to_skill' AND j.dk IS NOT NULL GROUP BY ALL
), assembled AS (
  SELECT j.*, coalesce(e.files, '') AS files, CASE WHEN dk IS NOT NULL THEN cause = 'ok' END AS draft_ok,
    CASE WHEN action = 'keep' THEN 0 WHEN action = 'prune' THEN (target_path IS NULL)::INT WHEN dk IS NULL THEN 1 ELSE (draft = '')::INT + (cause <> 'ok')::INT + coalesce(e.bad, 0) END AS n_problems
  FROM joined j LEFT JOIN extra_problem e ON j.run_id = e.run_id AND j.index = e.index
)
"""
