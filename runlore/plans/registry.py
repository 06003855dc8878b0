"""The registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.operators import export, labels, runs
from runlore.operators import timeline as times
from runlore.plans.derived import TRACE_SQL, trace_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def from_trace(sql: str) -> str:
    return TRACE_SQL + sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


_METRICS = from_trace("""
SELECT run_id, count(*) FILTER (type = 'main_step') AS steps, count(*) FILTER (tool = 'list_memory_files') AS list_memory_files_calls, count(*) FILTER (tool = 'read_memory_file') AS read_memory_file_calls,
  count(*) FILTER (tool = 'read_transcript_chunk') AS read_transcript_chunk_calls, count(*) FILTER (tool = 'draft_memory_file') AS draft_memory_file_calls, count(*) FILTER (tool = 'draft_skill_file') AS draft_skill_file_calls,
  count(*) FILTER (tool IN ('draft_memory_file', 'draft_skill_file') AND cause = 'invalid') AS draft_validator_rejects, count(*) FILTER (tool IN ('draft_memory_file', 'draft_skill_file') AND cause = 'endpoint') AS draft_endpoint_errors,
  count(*) FILTER (tool IN ('draft_memory_file', 'draft_skill_file') AND cause = 'circuit_broken') AS draft_circuit_breaks, count(*) FILTER (tool IN ('draft_memory_file', 'draft_skill_file') AND cause <> 'ok') AS draft_not_ok,
  count(*) FILTER (type = 'sub_call') AS sub_calls, CASE WHEN count(ts) >= 2 THEN round(max(ts) - min(ts), 3) END AS elapsed_s,
  count(*) FILTER (type = 'main_step') >= CASE WHEN coalesce(min_by(k % 40 - 2, step) FILTER (type = 'run_start'), 0) > 0 THEN min_by(k % 40 - 2, step) FILTER (type = 'run_start') ELSE 30 END AS hit_iteration_cap
FROM ev GROUP BY run_id""")


@query(_METRICS)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.run_metrics(trace_events(spark, sf_dir))


@query(from_trace("""
SELECT run_id, index::INT AS index, action, artifact_id, target_path, draft, draft_ok, files, n_problems::INT AS n_problems FROM assembled"""))
def assembled_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = runs.assembled(trace_events(spark, sf_dir))
    files = F.array_join(F.transform("extra_files", lambda x: x["relative_path"]), ",")
    return a.select("run_id", "index", "action", "artifact_id", F.try_variant_get("key_fields", "$.target_path", "string").alias("target_path"), "draft", "draft_ok", files.alias("files"), F.size("problems").alias("n_problems"))


@query(from_trace("""
SELECT run_id, index::INT AS index, CASE
  WHEN action = 'prune' THEN 'action ''prune'' carries no usable `key_fields["target_path"]`, so nothing identifies the file it proposes to remove — apply refuses such a candidate'
  WHEN dk IS NULL AND other IS NOT NULL THEN 'artifact_id ''' || artifact_id || ''' was drafted by ' || other || ' but the candidate''s action ''' || action || ''' expects ' || tool
  WHEN dk IS NULL THEN 'no ' || tool || ' tool_call for artifact_id ''' || artifact_id || ''' (the plan names an artifact this run never drafted)'
  WHEN draft = '' THEN 'artifact ''' || artifact_id || ''' recorded an empty draft'
  WHEN cause = 'circuit_broken' THEN 'artifact ''' || artifact_id || ''' was never drafted: the drafting call tripped the circuit breaker (too many consecutive invalid drafts), so the model was never called — e' || dk
  WHEN cause = 'endpoint' THEN 'artifact ''' || artifact_id || ''' was never drafted: the drafting model endpoint failed after its retries, so no draft was produced and no format check ever ran — e' || dk
  WHEN cause = 'invalid' THEN 'artifact ''' || artifact_id || ''' failed its format check: e' || dk
  END AS first_problem
FROM assembled WHERE action = 'prune' AND target_path IS NULL OR action LIKE 'promote%' AND (dk IS NULL OR draft = '' OR cause <> 'ok')"""))
def candidate_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = runs.assembled(trace_events(spark, sf_dir))
    own = F.col("draft_ok").isNull() | ~F.col("draft_ok") | (F.col("draft") == "")
    return a.where((F.size("problems") > 0) & own).select("run_id", "index", F.col("problems")[0].alias("first_problem"))


@query(from_trace("""
SELECT d.run_id, d.tool, d.artifact_id FROM draft_call d WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.run_id = d.run_id AND c.artifact_id = d.artifact_id)"""))
def unused_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.unused_drafts(trace_events(spark, sf_dir))


@query(from_trace("""
SELECT run_id, tool, artifact_id, draft, cause = 'ok' AS ok, cause, 'e' || k AS errors FROM draft_call"""))
def last_draft_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.draft_calls(trace_events(spark, sf_dir)).drop("seen")


@query(from_trace("""
SELECT run_id, artifact_id, relative_path, draft, cause, seen FROM extra_call"""))
def last_extra_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.extra_calls(trace_events(spark, sf_dir)).select("run_id", "artifact_id", "relative_path", "draft", "cause", F.col("seen.line_no").alias("seen"))


@query(from_trace("""
SELECT run_id, cause, count(*) AS n FROM ev WHERE tool IN ('draft_memory_file', 'draft_skill_file', 'draft_skill_extra_file') GROUP BY ALL"""))
def draft_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = trace_events(spark, sf_dir).where(runs.is_call(*runs.DRAFT_TOOLS, runs.EXTRA_TOOL))
    return calls.groupBy("run_id", runs.draft_cause(F.col("payload")).alias("cause")).agg(F.count("*").alias("n"))


@query(from_trace("""
SELECT run_id, min_by(k, step) AS transcripts, min_by('p' || k, step) AS project FROM ev WHERE type = 'run_start' GROUP BY run_id"""))
def first_run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runlore.functions import variants as V
    from runlore.functions.text import basename

    meta = runs.run_meta(trace_events(spark, sf_dir))
    return meta.select("run_id", V.as_int(V.get(F.col("meta"), "$.transcripts")).alias("transcripts"), basename(V.as_str(V.get(F.col("meta"), "$.project_dir"))).alias("project"))


_COUNTS = """, counts AS (
  SELECT r.run_id, l.run_id IS NOT NULL AS finalized, count(a.index) AS n_candidates, count(*) FILTER (action = 'keep') AS n_keep, count(*) FILTER (action = 'prune') AS n_prune, count(*) FILTER (action = 'promote_to_memory') AS n_promote_memory,
    count(*) FILTER (action = 'promote_to_skill') AS n_promote_skill, count(*) FILTER (n_problems > 0) AS n_unbacked, count(*) FILTER (action LIKE 'promote%' AND NOT coalesce(draft_ok, false)) AS n_draft_not_ok,
    count(*) FILTER (action <> 'keep') AS n_non_keep, count(*) FILTER (action LIKE 'promote%' AND draft_ok) AS n_backed, count(*) FILTER (action = 'prune' AND target_path IS NOT NULL) AS n_named, count(*) FILTER (action = 'promote_to_skill' AND scope = 'else') AS n_bad_scope
  FROM runs r LEFT JOIN last_result l ON r.run_id = l.run_id LEFT JOIN assembled a ON a.run_id = r.run_id GROUP BY ALL
)"""
_SAID = "CASE WHEN finalized THEN '' ELSE 'no plan was produced by this run' END AS plan_problems"


@query(from_trace(_COUNTS + f" SELECT run_id, finalized, n_candidates, n_keep, n_prune, n_promote_memory, n_promote_skill, n_unbacked, n_draft_not_ok, {_SAID} FROM counts"))
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.run_labels(trace_events(spark, sf_dir))
    return out.withColumn("plan_problems", F.array_join("plan_problems", "; "))


_FACTS = _COUNTS + f""", direct AS (
  SELECT run_id, count(DISTINCT k % 7) FILTER (tool = 'read_transcript_chunk') AS n_transcripts_read, min(step) FILTER (event_type = 'view') AS min_read_step, min(step) FILTER (tool IN ('draft_memory_file', 'draft_skill_file')) AS min_draft_step,
    coalesce(bool_or(cause = 'circuit_broken') FILTER (tool IN ('draft_memory_file', 'draft_skill_file')), false) AS any_circuit_broken, min_by(k, step) FILTER (type = 'run_start') AS n_transcripts FROM ev GROUP BY run_id
), facts AS (
  SELECT run_id, n_candidates, n_non_keep, n_transcripts, n_transcripts_read, {_SAID}, min_read_step, min_draft_step, any_circuit_broken, n_unbacked AS n_candidate_problems, n_backed AS n_backed_promotions, n_named AS prune_targets_named, n_bad_scope AS n_bad_skill_scope
  FROM counts JOIN direct USING (run_id)
)"""


@query(from_trace(_FACTS + " SELECT * FROM facts"))
def trace_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.trace_facts(trace_events(spark, sf_dir)).withColumn("plan_problems", F.array_join("plan_problems", "; "))


def _observed(names: list[tuple[str, str]]) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{n}\":' || {e}" for n, e in names) + " || '}'"


_null = "coalesce({0}::VARCHAR, 'null')".format


@query(from_trace(_FACTS + f"""
, crit AS (SELECT unnest([{{'position': 0, 'name': 'plan_carries_real_judgement', 'category': 'TF'}}, {{'position': 1, 'name': 'evidence_gathered_before_drafting', 'category': 'TA'}}, {{'position': 2, 'name': 'candidates_backed_by_real_drafts', 'category': 'TG'}}, {{'position': 3, 'name': 'plan_structurally_well_formed', 'category': 'PA'}}]) AS c)
SELECT run_id, c.position AS position, c.name AS name, c.category AS category, CASE c.category
  WHEN 'TF' THEN {_observed([("n_candidates", "n_candidates"), ("n_non_keep", "n_non_keep"), ("plan_problems", "CASE WHEN plan_problems = '' THEN '[]' ELSE '[\"' || plan_problems || '\"]' END")])}
  WHEN 'TA' THEN {_observed([("min_read_step", _null("min_read_step")), ("min_draft_step", _null("min_draft_step")), ("any_circuit_broken", "any_circuit_broken")])}
  WHEN 'TG' THEN {_observed([("n_backed_promotions", "n_backed_promotions"), ("prune_targets_named", "prune_targets_named")])}
  ELSE {_observed([("n_candidate_problems", "n_candidate_problems"), ("n_bad_skill_scope", "n_bad_skill_scope")])} END AS observed
FROM facts, crit"""))
def criteria_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.criteria_facts(trace_events(spark, sf_dir)).select("run_id", "position", "name", "category", "observed")


_CLOCK = """, clock AS (
  SELECT run_id, min_by(ts, step) FILTER (type = 'run_start') AS started_at, max_by(ts, step) FILTER (type = 'result') AS ended_at, count(*) FILTER (type = 'main_step') >= 2 AND coalesce(max(ts) FILTER (type = 'main_step') - min(ts) FILTER (type = 'main_step') > 1.0, false) AS per_turn_timing
  FROM ev GROUP BY run_id
), turns AS (
  SELECT run_id, row_number() OVER w - 1 AS index, k AS turn, 'o' || step AS output, step, CASE WHEN per_turn_timing THEN round(ts - started_at, 3) END AS rel_s,
    CASE WHEN per_turn_timing THEN round(CASE WHEN lead(step) OVER w IS NULL THEN ended_at ELSE lead(ts) OVER w END - ts, 3) END AS duration_s
  FROM ev JOIN clock USING (run_id) WHERE type = 'main_step' WINDOW w AS (PARTITION BY run_id ORDER BY k, step)
), calls AS (
  SELECT run_id, row_number() OVER w - 1 AS seq, CASE WHEN type = 'sub_call' THEN 'sub_lm' ELSE 'tool' END AS entry_kind, tool, type, per_turn_timing, k, artifact_id, draft, cause, round(ts - started_at, 3) AS rel_s,
    round(ts - CASE WHEN lag(step) OVER w IS NULL THEN started_at ELSE lag(ts) OVER w END, 3) AS duration_s
  FROM ev JOIN clock USING (run_id) WHERE type IN ('tool_call', 'sub_call') WINDOW w AS (PARTITION BY run_id ORDER BY step)
)"""


@query(from_trace(_CLOCK + " SELECT run_id, started_at, ended_at, round(ended_at - started_at, 3) AS total_s, per_turn_timing FROM clock"))
def run_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times.run_clock(trace_events(spark, sf_dir)).drop("meta")


@query(from_trace(_CLOCK + " SELECT run_id, index, turn, 'r' || turn AS reasoning, 'c' || turn AS code, output, rel_s, duration_s FROM turns"))
def run_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times.turns(trace_events(spark, sf_dir))


@query(from_trace(_CLOCK + """, placed AS (
  SELECT c.run_id, c.seq, max({'r': t.rel_s, 'i': t.index}).i AS latest FROM calls c JOIN turns t ON c.run_id = t.run_id AND t.rel_s <= c.rel_s WHERE c.per_turn_timing GROUP BY ALL
), earliest AS (SELECT run_id, min({'r': rel_s, 'i': index}).i AS earliest_turn FROM turns WHERE rel_s IS NOT NULL GROUP BY run_id)
SELECT c.run_id, c.seq, entry_kind, tool, CASE WHEN type = 'sub_call' THEN 'sub-LM' ELSE replace(replace(replace(replace(replace(replace(tool, 'list_memory_files', 'list memory'), 'read_memory_file', 'read memory'), 'read_transcript_chunk', 'read transcript'), 'draft_skill_extra_file', 'draft skill extra file'), 'draft_memory_file', 'draft memory'), 'draft_skill_file', 'draft skill') END AS label,
  CASE WHEN type = 'sub_call' THEN NULL WHEN cause IS NOT NULL THEN cause = 'ok' ELSE k % 5 > 0 END AS ok, rel_s, duration_s, CASE WHEN per_turn_timing AND rel_s IS NOT NULL THEN coalesce(latest, earliest_turn) END AS turn_index
FROM calls c LEFT JOIN placed p ON p.run_id = c.run_id AND p.seq = c.seq LEFT JOIN earliest e ON e.run_id = c.run_id"""))
def run_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times.timeline(trace_events(spark, sf_dir)).drop("fields")


@query(from_trace("""
SELECT run_id, step, CASE WHEN type = 'sub_call' THEN '{"model":"m' || (k % 3) || '","input":"i' || k || '","output":"w' || k || '","error":null}' WHEN tool = 'list_memory_files' THEN '{"count":null,"kinds":[]}' WHEN tool = 'read_memory_file' THEN '{"name":null,"kind":null,"chars":null,"truncated":false}'
  WHEN tool = 'read_transcript_chunk' THEN '{"transcript_index":' || (k % 7) || ',"offset":' || k || ',"limit":null,"length":null,"total_length":null}'
  ELSE '{"artifact_id":"' || artifact_id || '",' || CASE WHEN tool = 'draft_skill_extra_file' THEN '"relative_path":"references/' || (k % 4) || '.md",' ELSE '' END || '"kind":null,"draft_chars":' || length(draft) || ',"errors":["e' || k || '"],"endpoint_error":null,"circuit_broken":' || (cause = 'circuit_broken') ||
    CASE tool WHEN 'draft_memory_file' THEN ',"topic":null,"memory_type":null}' WHEN 'draft_skill_file' THEN ',"procedure":null,"scope":null}' ELSE '}' END END AS fields
FROM ev WHERE type IN ('tool_call', 'sub_call')"""))
def timeline_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = trace_events(spark, sf_dir).where("type in ('tool_call', 'sub_call')")
    return calls.select("run_id", F.col("line_no").alias("step"), times._entry().alias("fields"))


@query(from_trace("""
, shown AS (
  SELECT run_id, step, CASE WHEN type = 'run_start' THEN 'distill.run.created' WHEN type = 'main_step' THEN 'distill.plan.step' WHEN type = 'sub_call' THEN 'distill.sub_lm.call' WHEN type = 'result' THEN 'distill.plan.done' WHEN tool LIKE 'draft%' THEN 'distill.draft.created' ELSE 'distill.evidence.read' END AS event FROM ev
  UNION ALL SELECT run_id, 1000000000, 'distill.run.completed' FROM runs
)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS seq, event FROM shown"""))
def replay_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times.replay_feed(trace_events(spark, sf_dir)).drop("data")


@query(from_trace("""
SELECT run_id, step, event_type, CASE WHEN type = 'main_step' THEN '{"turn":' || k || ',"reasoning":"r' || k || '","has_code":true}' WHEN type = 'sub_call' THEN '{"input":"i' || k || '","processed_or_raw":"w' || k || '"}' ELSE '{}' END AS data
FROM (SELECT run_id, step, event_type, type, k FROM ev WHERE type IN ('main_step', 'sub_call', 'result'))"""))
def feed_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("type") == "main_step", "click").when(F.col("type") == "sub_call", "error").otherwise("signup")
    out = times.feed(trace_events(spark, sf_dir).where("type in ('main_step', 'sub_call', 'result')"))
    return out.select("run_id", F.col("line_no").alias("step"), kinds.alias("event_type"), "data")


@query(from_trace("""
SELECT run_id, min_by('p' || k, step) AS project, min_by(k, step) AS transcripts, min_by(k % 40 - 2, step) AS max_iterations, NULL::BIGINT AS transcript_sessions FROM ev WHERE type = 'run_start' GROUP BY run_id"""))
def initial_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times.initial_state(trace_events(spark, sf_dir)).where("transcripts is not null").select("run_id", "project", "transcripts", "max_iterations", "transcript_sessions")


@query(from_trace("""
SELECT run_id, step, k FROM (SELECT run_id, step, k, lag(k % 5) OVER (PARTITION BY run_id ORDER BY step) AS before, row_number() OVER (PARTITION BY run_id ORDER BY step) AS n FROM ev WHERE type = 'main_step') WHERE n = 1 OR before <> k % 5"""))
def turns_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runlore.plans.derived import flat_events

    rows = flat_events(spark, sf_dir).where("event_type = 'click'").withColumn("same", F.col("k") % 5)
    return times.without_repeats(rows, ["run_id"], ["step"], "same").select("run_id", "step", "k")


@query(from_trace("""
SELECT run_id, step, CASE type WHEN 'main_step' THEN 'planner' WHEN 'tool_call' THEN 'tool' ELSE 'sub_call' END AS kind, tool, CASE WHEN type = 'main_step' THEN 'c' || k WHEN event_type = 'view' THEN '{"offset":' || k || ',"transcript_index":' || (k % 7) || '}' END AS args,
  CASE WHEN type <> 'tool_call' THEN NULL WHEN cause IS NOT NULL THEN cause = 'ok' ELSE k % 5 > 0 END AS ok, CASE WHEN type = 'main_step' THEN 'o' || step WHEN type = 'sub_call' THEN 'w' || k END AS output, NULL::DOUBLE AS reward
FROM ev WHERE type IN ('main_step', 'tool_call', 'sub_call')"""))
def action_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.actions(trace_events(spark, sf_dir)).select("run_id", F.col("line_no").alias("step"), "kind", "tool", "args", "ok", "output", "reward")


@query(from_trace("""
SELECT run_id, step, tool, CASE WHEN tool LIKE 'draft%' THEN 'drafting' ELSE 'orchestrator_tools' END AS split FROM ev WHERE tool IS NOT NULL AND tool <> 'draft_skill_extra_file' UNION ALL SELECT run_id, step, NULL, 'planner' FROM ev WHERE type = 'main_step'"""))
def action_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = export.splits(export.actions(trace_events(spark, sf_dir)))
    rows = [parts[s].select("run_id", F.col("line_no").alias("step"), "tool", F.lit(s).alias("split")) for s in ("drafting", "orchestrator_tools", "planner")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(from_trace("""
SELECT run_id, turn, step, coalesce(string_agg(turn || ':o' || step, ',') OVER (PARTITION BY run_id ORDER BY turn, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history
FROM (SELECT run_id, k AS turn, step FROM ev WHERE type = 'main_step')"""))
def sft_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = export.sft_turns(trace_events(spark, sf_dir))
    history = F.array_join(F.transform("history", lambda h: F.concat(h["turn"].cast("string"), F.lit(":"), h["output"])), ",")
    return t.select("run_id", "turn", F.substring("output", 2, 20).cast("long").alias("step"), history.alias("history"))


@query(from_trace("""
SELECT (SELECT count(*) FROM runs) AS runs, count(*) FILTER (type IN ('main_step', 'tool_call', 'sub_call')) AS actions, count(*) FILTER (tool IN ('draft_memory_file', 'draft_skill_file')) AS drafting, count(*) FILTER (event_type = 'view') AS orchestrator_tools, count(*) FILTER (type = 'main_step') AS planner, count(*) FILTER (type = 'main_step') AS turns FROM ev"""))
def bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.summary(trace_events(spark, sf_dir))
