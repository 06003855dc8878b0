"""Whole workflows: conversations to a redacted corpus, traces to what a run's page shows, and traces to a scorecard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.functions import variants as V
from runlore.functions.redaction import redact
from runlore.functions.text import basename
from runlore.operators import evaluate, labels, layout, runs, timeline
from runlore.operators.runs import RUN
from runlore.plans.corpus import conversation_texts, numbered_conversations
from runlore.plans.derived import TRACE_SQL, trace_events
from runlore.plans.registry import from_trace, query
from runlore.sources.conversations import corpora
from runlore.sources.rules import Rule
from runlore.sources.traces import runs_found

#: A transcript can have megabytes, so few go to a worker at once.
TEXTS_AT_ONCE = 64


def redacted_corpus(spark: SparkSession, storage: str, vendor: list[Rule] = (), operator: list[Rule] = (), include_subagents: bool = True) -> DataFrame:
    """All transcripts below storage, rendered, numbered, headed, and then redacted as whole texts, headers included."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_AT_ONCE))
    rows = corpora(spark, storage, include_subagents)
    return rows.withColumn("text", redact(F.col("text"), vendor, operator))


def redacted_instructions(texts: DataFrame, vendor: list[Rule] = (), operator: list[Rule] = ()) -> DataFrame:
    """texts (text) redacted; empty ones are left as they are."""
    return texts.withColumn("text", F.when(F.length("text") > 0, redact(F.col("text"), vendor, operator)).otherwise(F.col("text")))


def run_payload(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """run_keys, plan (its text), facts and criteria (JSON), project (the path's last part), transcript_index (JSON)."""
    slots = layout.laid_out(events, run_keys)
    facts = labels.facts_of(slots, run_keys)
    named = [c for c in facts.columns if c not in run_keys]
    facts = facts.select(*run_keys, F.to_json(F.struct(*named), {"ignoreNullFields": "false"}).alias("facts"))
    rubric = labels.rubrics_of(slots, run_keys).select(*run_keys, F.to_json("criteria").alias("criteria"))
    plans = evaluate.plan_texts(layout.assembled_of(slots, run_keys), labels.labels_of(slots, run_keys), run_keys)
    meta = layout.run_rows(slots, run_keys).select(*run_keys, F.parse_json(F.coalesce("shown_meta", F.lit("{}"))).alias("meta"))
    project = basename(V.as_str(V.get(F.col("meta"), "$.project_dir"))).alias("project")
    meta = meta.select(*run_keys, project, F.to_json(V.get(F.col("meta"), "$.transcript_index")).alias("transcript_index"))
    return plans.withColumnRenamed("plan_text", "plan").join(facts, run_keys).join(rubric, run_keys).join(meta, run_keys, "left")


def score_runs(events: DataFrame, transcripts: DataFrame, corpus: str | None, tasks: DataFrame | None = None, judge: Callable[[str], str] | None = None, run_keys: list[str] = RUN) -> DataFrame:
    """A score row for each run of events, judged against the transcripts (corpus, transcript_index, text) of one corpus
    for all of them or, with None, of its project. Empty transcripts are refused. judge answers prompts in the tasks; by default a stub."""
    if transcripts.where(runs.blank(F.col("text"))).limit(1).count():
        raise ValueError("a transcript is empty")
    slots = layout.laid_out(events, run_keys)
    plans = evaluate.plan_texts(layout.assembled_of(slots, run_keys), labels.labels_of(slots, run_keys), run_keys)
    meta = layout.run_rows(slots, run_keys).select(*run_keys, F.parse_json(F.coalesce("shown_meta", F.lit("{}"))).alias("meta"))
    project = basename(V.as_str(V.get(F.col("meta"), "$.project_dir")))
    plans = plans.withColumn("corpus", F.lit(corpus)) if corpus is not None else plans.join(meta.select(*run_keys, project.alias("corpus")), run_keys, "left")
    asked = evaluate.prompts(plans, evaluate.excerpts(transcripts, ["corpus"]), ["corpus"], tasks, run_keys)
    facts = meta.select(*run_keys, V.as_int(V.get(F.col("meta"), "$.transcripts")).alias("n_transcripts"), *(c.alias(n) for n, c in timeline.composition(F.col("meta")).items()))
    return evaluate.score_rows(evaluate.parse_replies(evaluate.judged(asked, judge, keep_prompt=False)), facts, run_keys)


@query(TRACE_SQL + "SELECT 'events' AS path, run_id FROM runs")
def found_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_found(trace_events(spark, sf_dir))


@query(from_trace("""
SELECT r.run_id, m.project, l.run_id IS NOT NULL AS finalized, 4 AS criteria FROM runs r LEFT JOIN (SELECT run_id, min_by('p' || k, step) AS project FROM ev WHERE type = 'run_start' GROUP BY run_id) m ON m.run_id = r.run_id LEFT JOIN last_result l ON l.run_id = r.run_id"""))
def run_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_payload(trace_events(spark, sf_dir))
    return out.select("run_id", "project", (F.get_json_object("facts", "$.plan_problems[0]").isNull()).alias("finalized"), F.size(F.from_json("criteria", "array<struct<name:string>>")).alias("criteria"))


@query(r"""WITH line AS (SELECT conv_id, turn, role || ': ' || CASE WHEN text = '' THEN '' ELSE text || chr(10) END || '[used tool: unknown]' AS line FROM conversations WHERE role IN ('user', 'assistant')), convs AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, regexp_replace(coalesce(string_agg(l.line, chr(10) ORDER BY l.turn), '') || ' AKIA' || repeat('B', 16), '\bAKIA[0-9A-Z]{16}\b', '[REDACTED:aws_access_key_id]', 'g') AS text FROM convs c LEFT JOIN line l ON c.conv_id = l.conv_id GROUP BY c.conv_id""")
def redacted_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_AT_ONCE))
    return conversation_texts(spark, sf_dir).select("conv_id", redact(F.concat("text", F.lit(" AKIA" + "B" * 16))).alias("text"))


@query(TRACE_SQL + "SELECT run_id, 5.0::DOUBLE AS \"TF\", 5.0::DOUBLE AS \"PA\", NULL::VARCHAR AS unscored_reason, (SELECT min_by(k, step) FROM ev e WHERE e.run_id = r.run_id AND e.type = 'run_start') AS n_transcripts FROM runs r")
def stub_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = numbered_conversations(spark, sf_dir).where("text <> ''").select(F.col("project").alias("corpus"), "transcript_index", "text")
    out = score_runs(trace_events(spark, sf_dir), texts, None)
    return out.select("run_id", "TF", "PA", "unscored_reason", "n_transcripts")
