"""Queries over the driver's conversations, documents, labels and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.functions import text as T
from runlore.functions.redaction import matches, redact, redact_built_in
from runlore.operators import artifacts, evaluate, labels, lineage, outcomes, render, runs
from runlore.plans.derived import TRACE_SQL, table, trace_events
from runlore.plans.registry import from_trace, query
from runlore.sources.rules import operator_rules
from runlore.streaming import feeds

RULES = [
    {"label": "hex_token", "regex": r"token = \"(?P<value>[0-9a-f]{40})\"", "description": "a token's value", "sample": 'token = "' + "0a" * 20 + '"', "replace_group": "value"},
    {"label": "email", "regex": r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+", "description": "an address", "sample": "me@example.com"},
]
_SPACES = r"'[\x20\x09-\x0D]'"


def _as_event(role, text):
    return F.to_variant_object(F.struct(role.alias("type"), F.struct(role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"))).alias("content")).alias("message")))


TRANSCRIPTS_SQL = """WITH line AS (SELECT conv_id, turn, role || ': ' || CASE WHEN text = '' THEN '' ELSE text || chr(10) END || '[used tool: unknown]' AS line FROM conversations WHERE role IN ('user', 'assistant')),
convs AS (SELECT DISTINCT conv_id FROM conversations), tr AS (SELECT c.conv_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.turn), '') AS text FROM convs c LEFT JOIN line l ON c.conv_id = l.conv_id GROUP BY c.conv_id),
num AS (SELECT conv_id, 'p' || (conv_id % 25) AS project, row_number() OVER (PARTITION BY conv_id % 25 ORDER BY lpad(conv_id::VARCHAR, 12, '0')) - 1 AS transcript_index, text FROM tr)"""


def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("shown", render.event_line(_as_event(F.col("role"), F.coalesce("text", F.lit("")))))
    return render.joined_lines(rows, ["conv_id"], "turn", "shown")


def numbered_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = F.lpad(F.col("conv_id").cast("string"), 12, "0")
    rows = conversation_texts(spark, sf_dir).select("conv_id", F.concat(F.lit("p"), (F.col("conv_id") % 25).cast("string")).alias("project"), session.alias("session"), session.alias("path"), session.alias("id"), F.lit("session").alias("kind"), F.lit(None).cast("string").alias("workflow"), F.lit(None).cast("long").alias("depth"), "text")
    return render.numbered(rows, ["project"]).select("conv_id", "project", F.col("transcript_index").cast("long").alias("transcript_index"), "session", "text")


@query(TRANSCRIPTS_SQL + " SELECT conv_id, text FROM tr")
def rendered_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_texts(spark, sf_dir)


@query(TRANSCRIPTS_SQL + """ SELECT conv_id, project, transcript_index, '[' || transcript_index || '] session ' || left(lpad(conv_id::VARCHAR, 12, '0'), 8) || chr(10) || 'session=' || lpad(conv_id::VARCHAR, 12, '0') AS header FROM num""")
def transcript_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered_conversations(spark, sf_dir)
    return rows.select("conv_id", "project", "transcript_index", render.session_header(F.col("transcript_index"), F.col("session")).alias("header"))


@query(TRANSCRIPTS_SQL + """, req AS (SELECT conv_id, 'p' || (conv_id % 25) AS project, turn, (turn * 3) % 7 AS transcript_index, turn * 400 - 400 AS "offset", turn * 150 AS "limit" FROM conversations), sizes AS (SELECT project, count(*) AS n FROM num GROUP BY project)
SELECT r.conv_id, r.turn, r.transcript_index, CASE WHEN ok THEN substr(t.text, ("offset" + 1)::BIGINT, least("limit", 20000)::BIGINT) END AS text, CASE WHEN ok THEN length(substr(t.text, ("offset" + 1)::BIGINT, least("limit", 20000)::BIGINT)) END AS length,
  CASE WHEN r.transcript_index >= n THEN 'refused: transcript_index ' || r.transcript_index || ' out of range (this run has ' || n || ' transcript(s), valid 0..' || (n - 1) || ')' WHEN "offset" < 0 OR "limit" <= 0 THEN 'refused: need offset >= 0 and limit > 0, got offset=' || "offset" || ' limit=' || "limit"
    WHEN "offset" >= length(t.text) THEN 'refused: offset ' || "offset" || ' is past the end of transcript ' || r.transcript_index || ' (total_length ' || length(t.text) || ')' END AS note
FROM req r JOIN sizes s ON r.project = s.project LEFT JOIN num t ON t.project = r.project AND t.transcript_index = r.transcript_index, LATERAL (SELECT r.transcript_index < n AND "offset" >= 0 AND "limit" > 0 AND "offset" < length(t.text) AS ok)""")
def transcript_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    req = c.select("conv_id", F.concat(F.lit("p"), (F.col("conv_id") % 25).cast("string")).alias("project"), "turn", ((F.col("turn") * 3) % 7).alias("transcript_index"), (F.col("turn") * 400 - 400).alias("offset"), (F.col("turn") * 150).alias("limit"))
    return render.read_windows(req, numbered_conversations(spark, sf_dir), ["project"]).select("conv_id", "turn", "transcript_index", "text", "length", "note")


@query("""WITH RECURSIVE sizes AS (SELECT conv_id % 5 AS corpus, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id, turn) - 1 AS i, length(repeat(coalesce(text, ''), 60)) AS n FROM conversations),
fold AS (SELECT corpus, -1::BIGINT AS i, 240000::BIGINT AS remaining, 0::BIGINT AS most FROM (SELECT DISTINCT corpus FROM sizes)
  UNION ALL SELECT f.corpus, s.i, CASE WHEN s.n > least(60000, f.remaining) AND least(60000, f.remaining) < 2000 THEN f.remaining ELSE f.remaining - least(s.n, least(60000, f.remaining)) END, CASE WHEN s.n > least(60000, f.remaining) AND least(60000, f.remaining) < 2000 THEN -1 ELSE least(60000, f.remaining) END
  FROM fold f JOIN sizes s ON s.corpus = f.corpus AND s.i = f.i + 1)
SELECT corpus, i, most FROM fold WHERE i >= 0""")
def excerpt_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("corpus"), "conv_id", "turn", F.length(F.repeat(F.coalesce("text", F.lit("")), 60)).alias("n"))
    out = evaluate.budgets(rows, ["corpus"], ["conv_id", "turn"])
    return out.select("corpus", F.col("position").alias("i"), "most")


@query(r"""SELECT doc_id, replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' AKIA' || repeat('A', 16) WHEN 1 THEN ' ghp_' || repeat('b', 20) || ' password = "hunter' || doc_id || '"' WHEN 2 THEN ' Authorization: Bearer abcdefgh' || doc_id ELSE '' END,
  '\bAKIA[0-9A-Z]{16}\b', '[REDACTED:aws_access_key_id]', 'g'), '\bghp_[A-Za-z0-9]{16,}\b', '[REDACTED:github_token]', 'g'), '(password = ")hunter[0-9]+"', '\1[REDACTED:secret_assignment]"', 'g'), 'Bearer abcdefgh' || doc_id, '[REDACTED:bearer_token]'), chr(0), '') AS text FROM documents""")
def redacted_built_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    secret = F.when(d % 4 == 0, " AKIA" + "A" * 16).when(d % 4 == 1, F.concat(F.lit(" ghp_" + "b" * 20 + ' password = "hunter'), d.cast("string"), F.lit('"'))).when(d % 4 == 2, F.concat(F.lit(" Authorization: Bearer abcdefgh"), d.cast("string"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", redact_built_in(F.concat(F.coalesce("text", F.lit("")), secret)).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, 'token = "[0-9a-f]{40}"', 'token = "[REDACTED:hex_token]"', 'g'), '[a-z0-9._]+@[a-z0-9.]+\.[a-z]+', '[REDACTED:email]', 'g') AS text FROM documents""")
def redacted_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    return table(spark, sf_dir, "documents").select("doc_id", redact(F.col("text"), operator=operator_rules(RULES)).alias("text"))


@query(r"""WITH c AS (SELECT CASE WHEN toxic = 1 THEN 'email' ELSE 'hex_token' END AS rule_id, CASE WHEN quality = 1 THEN 'tp' ELSE 'fp' END AS bucket, CASE WHEN toxic = 1 THEN regexp_matches(text, '[a-z0-9._]+@[a-z0-9.]+\.[a-z]+') ELSE regexp_matches(text, 'token = "[0-9a-f]{40}"') END AS hit FROM documents JOIN labels USING (doc_id))
SELECT rule_id, bucket, count(*) AS n, count(*) FILTER (hit) AS hits FROM c GROUP BY ALL""")
def rule_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cases = docs.select(F.when(F.col("toxic") == 1, "email").otherwise("hex_token").alias("rule_id"), F.when(F.col("quality") == 1, "tp").otherwise("fp").alias("bucket"), "text")
    hit = matches(F.col("text"), {r["label"]: r["regex"] for r in RULES}, F.col("rule_id"))
    return cases.withColumn("hit", hit).groupBy("rule_id", "bucket").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text, E' \\n\\t\\r\\x0b\\x0c')), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g') AS slug, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '…' END AS label,
  CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 500) || chr(10) || '... (' || (length(text) - 1000) || ' characters omitted) ...' || chr(10) || right(text, 500) END AS elided, rtrim(left(trim(regexp_replace(text, '[^A-Za-z0-9._-]+', '-', 'g'), '-.'), 40), '-.') AS run_slug
FROM documents""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.slug(F.col("text")).alias("slug"), T.label(F.col("text")).alias("label"), T.elide(F.col("text"), 1000).alias("elided"), T.run_slug(F.col("text"), 40).alias("run_slug"))


@query("""WITH r AS (SELECT doc_id, n_chars % 14 - 2 AS a, doc_id % 6 AS kind, quality FROM documents JOIN labels USING (doc_id)), s AS (SELECT *, kind < 4 AS ok, greatest(0, least(10, a))::DOUBLE AS x FROM r)
SELECT kind, count(*) AS n, count(*) FILTER (NOT ok) AS n_unscored, round(avg(x) FILTER (ok), 6) AS mean_TF, round(avg(quality * 7.0) FILTER (ok), 6) AS mean_TA FROM s GROUP BY kind""")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    a = (F.col("n_chars") % 14 - 2).cast("string")
    sheet = lambda tf: F.concat(F.lit('{"scores": {"TF": '), tf, F.lit(', "TA": '), (F.col("quality") * 7).cast("string"), F.lit(', "TG": 3, "PA": 4.5}, "notes": "fine"}'))
    kind = F.col("doc_id") % 6
    raw = F.when(kind == 0, sheet(a)).when(kind == 1, F.concat(F.lit("```json\n"), sheet(a), F.lit("\n```"))).when(kind == 2, F.concat(F.lit("My view: "), sheet(a), F.lit(" as asked"))).when(kind == 3, F.concat(F.lit(" "), sheet(a))).when(kind == 4, sheet(F.lit("true"))).otherwise(F.lit("no scores"))
    rows = evaluate.score_rows(evaluate.parse_replies(d.select(F.col("doc_id").cast("string").alias("run_id"), kind.alias("kind"), raw.alias("raw"))), run_keys=["run_id", "kind"])
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("unscored_reason").alias("n_unscored"), F.round(F.avg("TF"), 6).alias("mean_TF"), F.round(F.avg("TA"), 6).alias("mean_TA"))


@query("""SELECT count(*) AS n, count(*) FILTER (quality = 0) AS n_unscored, round(avg(n_chars % 11) FILTER (quality = 1), 6) AS mean_TF, round(avg(toxic * 10.0) FILTER (quality = 1), 6) AS mean_TA, 'stub' AS judge_model FROM documents JOIN labels USING (doc_id)""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.select((F.col("n_chars") % 11).alias("TF"), (F.col("toxic") * 10.0).alias("TA"), F.lit(1.0).alias("TG"), F.lit(1.0).alias("PA"), F.when(F.col("quality") == 0, "no reply").alias("unscored_reason"))
    card = evaluate.scorecard(rows, "stub", "v1")
    return card.select("n", "n_unscored", F.round("mean_TF", 6).alias("mean_TF"), F.round("mean_TA", 6).alias("mean_TA"), "judge_model")


@query(from_trace("""
SELECT r.run_id, coalesce((SELECT count(*) FROM assembled a WHERE a.run_id = r.run_id), 0) AS blocks, CASE WHEN l.run_id IS NULL THEN 1 ELSE 0 END AS said FROM runs r LEFT JOIN last_result l ON l.run_id = r.run_id"""))
def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trace_events(spark, sf_dir)
    t = evaluate.plan_texts(runs.assembled(e), labels.run_labels(e))
    return t.select("run_id", F.regexp_count("plan_text", F.lit("(?m)^\\[[0-9]+\\] action=")).cast("long").alias("blocks"), F.col("plan_text").contains("(run-level problems:").cast("int").alias("said"))


@query(from_trace("""
, idx AS (SELECT DISTINCT run_id, 'm' || (k % 4) AS path FROM ev WHERE event_type = 'click')
SELECT a.run_id, index::INT AS index, CASE WHEN a.index % 5 = 3 THEN 'skipped' WHEN n_problems > 0 THEN 'refused' WHEN action = 'keep' THEN 'noop' WHEN action = 'prune' AND i.path IS NOT NULL THEN 'applied' ELSE 'refused' END AS status
FROM assembled a LEFT JOIN idx i ON i.run_id = a.run_id AND i.path = a.target_path"""))
def apply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trace_events(spark, sf_dir)
    c = runs.assembled(e).withColumn("harness", F.lit("claude_code"))
    approvals = c.where(F.col("index") % 5 != 3).select("run_id", "index", F.lit(False).alias("overwrite"))
    index = e.where("type = 'main_step'").select("run_id", F.concat(F.lit("m"), (F.try_variant_get("payload", "$.turn", "long") % 4).cast("string")).alias("path"), F.lit("memory").alias("kind"), F.lit("project").alias("scope"), F.lit("x").alias("name")).distinct()
    roots = e.select("run_id").distinct().select("run_id", F.lit("/m").alias("memory_dir"), F.lit("/g").alias("global_skills_dir"), F.lit("/s").alias("project_skills_dir"))
    return outcomes.apply_outcomes(c, approvals, index, roots, "20240101T000000Z").select("run_id", "index", "status")


@query("""WITH d AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '---' || chr(10) || 'name: n' || (doc_id % 50) || chr(10) || 'description: d' || chr(10) || 'metadata:' || chr(10) || '  type: ' || (['user', 'feedback', 'odd'])[doc_id % 3 + 1] || chr(10) || '---' || chr(10) || 'body' WHEN 2 THEN '---' || chr(10) || 'name: n' || doc_id || chr(10) || '---' || chr(10) ELSE '  ' END AS draft FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN (doc_id % 50 < 10)::INT + (doc_id % 3 = 2 OR doc_id % 3 = 1)::INT WHEN 2 THEN 3 + (doc_id < 10)::INT ELSE 1 END AS n_errors FROM d""")
def memory_draft_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    draft = F.when(i % 4 == 0, F.col("text")).when(i % 4 == 1, F.concat(F.lit("---\nname: n"), s(i % 50), F.lit("\ndescription: d\nmetadata:\n  type: "), F.element_at(F.array(*map(F.lit, ["user", "feedback", "odd"])), (i % 3 + 1).cast("int")), F.lit("\n---\nbody"))).when(i % 4 == 2, F.concat(F.lit("---\nname: n"), s(i), F.lit("\n---\n"))).otherwise("  ")
    taken = d.where(i % 50 < 10).select(F.lit("all").alias("corpus"), F.lit("memory").alias("kind"), F.lit("project").alias("scope"), F.concat(F.lit("N"), s(i % 50)).alias("name")).distinct()
    rows = d.select("doc_id", F.lit("all").alias("corpus"), draft.alias("text"), F.lit("user").alias("requested_type"))
    return artifacts.check_memory_drafts(rows, taken, ["corpus"]).select("doc_id", F.size("errors").alias("n_errors"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, source, CASE WHEN doc_id >= 20 AND doc_id % 3 > 0 THEN doc_id - 20 * (1 + doc_id % 2) END AS parent FROM documents), q AS (SELECT doc_id AS id, source, CASE WHEN parent >= 0 THEN parent END AS parent FROM p),
up AS (SELECT id, source, parent AS ancestor FROM q WHERE parent IS NOT NULL UNION SELECT u.id, u.source, q.parent FROM up u JOIN q ON q.id = u.ancestor AND q.source = u.source WHERE q.parent IS NOT NULL)
SELECT source, count(*) AS n FROM (SELECT source, ancestor AS a, id AS b FROM up UNION SELECT x.source, x.id, y.id FROM q x JOIN q y ON x.source = y.source AND x.parent = y.parent AND x.id < y.id) GROUP BY source""")
def dependent_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.dependent_counts(_nested(spark, sf_dir), ["source"])


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, id, parent: documents as transcripts that descend from earlier ones."""
    i = F.col("doc_id")
    parent = F.when((i >= 20) & (i % 3 > 0), i - 20 * (1 + i % 2))
    return table(spark, sf_dir, "documents").select("source", i.alias("id"), F.when(parent >= 0, parent).alias("parent"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, source, CASE WHEN doc_id >= 20 AND doc_id % 3 > 0 THEN doc_id - 20 * (1 + doc_id % 2) END AS parent FROM documents), q AS (SELECT doc_id AS id, source, CASE WHEN parent >= 0 THEN parent END AS parent FROM p),
up AS (SELECT id, source, parent AS ancestor FROM q WHERE parent IS NOT NULL UNION SELECT u.id, u.source, q.parent FROM up u JOIN q ON q.id = u.ancestor AND q.source = u.source WHERE q.parent IS NOT NULL),
r AS (SELECT id AS a, source, unnest([id - 20, id - 40, id - 80, id + 20, id]) AS b FROM q)
SELECT r.source, r.a, r.b, NOT (r.a = r.b OR EXISTS (SELECT 1 FROM up u WHERE u.source = r.source AND u.id = r.a AND u.ancestor = r.b) OR EXISTS (SELECT 1 FROM up u WHERE u.source = r.source AND u.id = r.b AND u.ancestor = r.a)
  OR EXISTS (SELECT 1 FROM q x JOIN q y ON x.source = y.source AND x.parent = y.parent WHERE x.source = r.source AND x.id = r.a AND y.id = r.b)) AS independent FROM r""")
def independent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every transcript whether it is independent of some near it."""
    rows = _nested(spark, sf_dir)
    near = F.explode(F.array(*(F.col("id") + d for d in (-20, -40, -80, 20, 0))))
    return lineage.independence(rows.select("source", F.col("id").alias("a"), near.alias("b")), rows, ["source"])


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, in the trace schema as far as streams need it."""
    from runlore.operators.runs import CAUSES
    from runlore.plans.derived import pick

    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    k = F.get_json_object("props", "$.k").cast("long")
    kind, cause = F.col("event_type"), pick(CAUSES, k % 4)
    tool = F.when(kind == "view", pick(runs.READ_TOOLS, k % 3)).when((kind == "purchase") & (k % 3 == 2), runs.EXTRA_TOOL).when(kind == "purchase", pick(runs.DRAFT_TOOLS, k % 2))
    names = F.when(kind == "click", "main_step").when(kind == "error", "sub_call").when(kind == "signup", "run_start").otherwise("tool_call")
    out = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").cast("string").alias("step_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), names.alias("type"), F.to_variant_object(F.struct(tool.alias("tool"), cause.alias("cause"), k.alias("turn"), F.concat(F.lit("r"), k.cast("string")).alias("reasoning"))).alias("payload"))
    return feeds.timed(out)


@query("""SELECT epoch_us(date_trunc('hour', ts)) / 1000000 AS hour, CASE event_type WHEN 'click' THEN 'main_step' WHEN 'error' THEN 'sub_call' WHEN 'signup' THEN 'run_start' ELSE 'tool_call' END AS type, count(*) AS n FROM events GROUP BY ALL""")
def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feeds.upserted(feeds.hourly_activity(_stream(spark, sf_dir)), "hourly", ["hour", "type"])
    return out.select((F.unix_micros("hour") / 1000000).alias("hour"), "type", "n")


@query(TRACE_SQL + """SELECT run_id, count(*) FILTER (type = 'main_step') AS steps, count(*) FILTER (tool = 'draft_skill_file') AS draft_skill_file_calls, count(*) FILTER (tool IN ('draft_memory_file', 'draft_skill_file') AND cause <> 'ok') AS draft_not_ok, count(*) FILTER (type = 'sub_call') AS sub_calls, CASE WHEN count(ts) >= 2 THEN round(max(ts) - min(ts), 3) END AS elapsed_s FROM ev GROUP BY run_id""")
def live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = feeds.upserted(feeds.live_metrics(_stream(spark, sf_dir)), "metrics", ["run_id", "part"])
    return feeds.merged_metrics(parts).select("run_id", "steps", "draft_skill_file_calls", "draft_not_ok", "sub_calls", "elapsed_s")


@query("""SELECT 'u' || user_id AS run_id, event_id::VARCHAR AS step_id, CASE event_type WHEN 'click' THEN 'distill.plan.step' WHEN 'error' THEN 'distill.sub_lm.call' WHEN 'signup' THEN 'distill.run.created' WHEN 'view' THEN 'distill.evidence.read' ELSE 'distill.draft.created' END AS event FROM events""")
def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.drained(feeds.live_feed(_stream(spark, sf_dir).withColumn("step_key", F.lit(0))), "feed").drop("data")


@query("""SELECT run_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT run_id, s, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY ts) AS s FROM (SELECT 'u' || user_id AS run_id, ts, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR)::INT AS brk FROM events)) GROUP BY ALL) GROUP BY run_id""")
def run_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feeds.merged_lifecycle(feeds.upserted(feeds.run_lifecycle(_stream(spark, sf_dir), "6 hours"), "sessions", ["run_id", "started"]))
    return out.groupBy("run_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query("""WITH brk AS (
  SELECT 'u' || user_id AS run_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INT AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), placed AS (SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM brk), stretch AS (
  SELECT run_id, s, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS events FROM placed GROUP BY ALL
), mark AS (
  -- a watermark is in whole milliseconds
  SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 AS mark FROM events)
SELECT run_id, started_us, ended_us, events, CASE WHEN ended_us + 6 * 3600000000 <= mark THEN 'closed' ELSE 'open' END AS state, CASE WHEN ended_us + 6 * 3600000000 <= mark THEN 'distill.run.completed' END AS event, CASE WHEN ended_us + 6 * 3600000000 <= mark THEN '{}' END AS data FROM stretch, mark""")
def run_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each run; those that fell silent carry the event that would be missing."""
    out = feeds.upserted(feeds.run_lifecycle(_stream(spark, sf_dir), "6 hours", "1 hour"), "lifecycles", ["run_id", "started"])
    out = feeds.merged_lifecycle(out)
    return out.select("run_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "events", "state", "event", "data")


@query("""WITH turn AS (SELECT 'u' || user_id AS run_id, epoch_us(ts) * 1000 + event_id % 1000 AS step, json_extract_string(props, '$.k')::BIGINT % 5 AS reasoning FROM events WHERE event_type = 'click'),
seen AS (SELECT *, lag(reasoning) OVER w AS before, row_number() OVER w AS n FROM turn WINDOW w AS (PARTITION BY run_id ORDER BY step))
SELECT run_id, step, 'r' || reasoning AS reasoning FROM seen WHERE n = 1 OR before <> reasoning""")
def live_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of turns without those that say what the turn before said."""
    turns = _stream(spark, sf_dir).where("type = 'main_step'")
    step = F.unix_micros("event_time") * 1000 + F.col("step_id").cast("long") % 1000
    said = F.concat(F.lit("r"), (F.try_variant_get("payload", "$.turn", "long") % 5).cast("string"))
    out = feeds.drained(feeds.without_repeats(turns.select("run_id", step.alias("step_key"), said.alias("reasoning"), "event_time")), "turns")
    return out.select("run_id", F.col("step_key").alias("step"), "reasoning")
