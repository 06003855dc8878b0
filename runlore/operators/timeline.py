"""A run's turns and calls in replay order, with times; its public feed; and its first state.

Replay order is by step, steps that are no numbers last, then by file order. Names and sizes are shown, never bodies of
drafts nor paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.functions import variants as V
from runlore.functions.text import LABEL, basename, label, looks_like_path, preview
from runlore.operators.runs import DRAFT_TOOLS, EXTRA_TOOL, READ_TOOLS, RUN, order, p

LIVE_SPAN = 1.0
LAST = 1 << 30
TOOL_LABELS = {"list_memory_files": "list memory", "read_memory_file": "read memory", "read_transcript_chunk": "read transcript", "draft_memory_file": "draft memory", "draft_skill_file": "draft skill", "draft_skill_extra_file": "draft skill extra file"}


def replay() -> Column:
    return F.struct(F.col("step_key"), order().alias("place"))


def run_clock(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """run_keys, started_at, ended_at, total_s, per_turn_timing, meta: of every run. Start: the first run_start in replay
    order; end: the last run_end, result or final. Turn times are live if two or more turns span over a second."""
    start, end, turn = F.col("type") == "run_start", F.col("type").isin("run_end", "result", "final"), F.col("type") == "main_step"
    meta = F.when(V.is_object(p("meta")), F.to_json(p("meta"))).otherwise(F.lit("{}"))
    out = events.where("run_id <> ''").groupBy(*run_keys).agg(
        F.min_by(F.when(start, F.struct("ts", meta.alias("meta"))), F.when(start, replay())).alias("first"),
        F.max_by(F.when(end, F.struct("ts")), F.when(end, replay())).alias("last"),
        ((F.count(F.when(turn, F.col("ts"))) >= 2) & F.coalesce(F.max(F.when(turn, F.col("ts"))) - F.min(F.when(turn, F.col("ts"))) > LIVE_SPAN, F.lit(False))).alias("per_turn_timing"),
    )
    ended, started = F.col("last.ts"), F.col("first.ts")
    return out.select(*run_keys, started.alias("started_at"), ended.alias("ended_at"), F.round(ended - started, 3).alias("total_s"), "per_turn_timing", F.parse_json(F.coalesce("first.meta", F.lit("{}"))).alias("meta"))


def turns(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """run_keys, index, turn, reasoning, code, output, rel_s, duration_s: the turns in order of their number (those
    without a whole one last). Times only where they are live: since the start, and to the next turn or the run's end."""
    number = V.as_int(p("turn"))
    rows = events.where("type = 'main_step' and run_id <> ''").select(*run_keys, number.alias("turn"), *(preview(V.text_of(p(c))).alias(c) for c in ("reasoning", "code", "output")), "ts", "step_key", order().alias("place"))
    by = Window.partitionBy(*run_keys).orderBy(F.coalesce("turn", F.lit(LAST)), "step_key", "place")
    rows = rows.withColumn("index", (F.row_number().over(by) - 1).cast("long")).withColumn("next_ts", F.lead("ts").over(by)).withColumn("is_last", F.lead(F.lit(False), 1, True).over(by))
    rows = rows.join(run_clock(events, run_keys).drop("meta", "total_s"), run_keys)
    nxt = F.when(F.col("is_last"), F.col("ended_at")).otherwise(F.col("next_ts"))
    live = F.col("per_turn_timing")
    return rows.select(*run_keys, "index", "turn", "reasoning", "code", "output", F.when(live, F.round(F.col("ts") - F.col("started_at"), 3)).alias("rel_s"), F.when(live, F.round(nxt - F.col("ts"), 3)).alias("duration_s"))


def _short(path: str) -> Column:
    return label(V.as_str(p(path)))


def _texts(path: str) -> Column:
    return F.transform(V.strings_of(p(path)), lambda s: F.when(F.length(s) <= LABEL, s).otherwise(F.concat(F.substring(s, 1, LABEL), F.lit("…"))))


def _entry() -> Column:
    """The shown fields of a call as JSON: an allow-list for each known tool, sizes in place of bodies."""
    tool = V.as_str(p("tool"))
    chars = F.length(V.as_str(p("draft")))
    draft = [_short("artifact_id").alias("artifact_id"), _short("kind").alias("kind"), chars.alias("draft_chars"), _texts("errors").alias("errors"), _short("endpoint_error").alias("endpoint_error"), V.truthy(p("circuit_broken")).alias("circuit_broken")]
    number = lambda path, name: V.as_int(p(path)).alias(name)
    fields = {
        "list_memory_files": [number("count", "count"), _texts("kinds").alias("kinds")],
        "read_memory_file": [_short("name").alias("name"), _short("kind").alias("kind"), number("chars", "chars"), V.truthy(p("truncated")).alias("truncated")],
        "read_transcript_chunk": [number("args.transcript_index", "transcript_index"), number("args.offset", "offset"), number("args.limit", "limit"), number("length", "length"), number("total_length", "total_length")],
        "draft_memory_file": [*draft, _short("args.topic").alias("topic"), _short("args.memory_type").alias("memory_type")],
        "draft_skill_file": [*draft, _short("args.procedure").alias("procedure"), _short("args.scope").alias("scope")],
        EXTRA_TOOL: [draft[0], _short("relative_path").alias("relative_path"), *draft[1:]],
    }
    options = {"ignoreNullFields": "false"}
    sub = F.to_json(F.struct(
        label(V.as_str(F.when(V.truthy(p("name")), p("name")).otherwise(p("model")))).alias("model"), preview(V.text_of(p("input"))).alias("input"),
        preview(V.text_of(F.when(V.truthy(p("processed")), p("processed")).otherwise(p("raw")))).alias("output"), preview(V.text_of(p("error"))).alias("error")), options)
    out = F.when(F.col("type") == "sub_call", sub)
    for name, columns in fields.items():
        out = out.when(tool == name, F.to_json(F.struct(*columns), options))
    return out.otherwise(F.lit('{"unrecognized":true}'))


def timeline(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """run_keys, seq, entry_kind, tool, label, ok, rel_s, duration_s, turn_index, fields: the calls that have a time.

    duration_s is the gap to the call before, or to the start. turn_index: the last turn begun by then (of turns that began
    together the one with the highest index), before any the first; only where turn times are live.
    """
    tool = V.as_str(p("tool"))
    named = F.create_map(*(F.lit(x) for kv in TOOL_LABELS.items() for x in kv))
    shown = F.when(F.col("type") == "sub_call", F.lit("sub-LM")).otherwise(F.coalesce(named[tool], label(tool), F.lit("tool")))
    ok = F.when(V.kind(p("ok")) == "BOOLEAN", F.try_variant_get(p("ok"), "$", "boolean"))
    calls = events.where("type in ('tool_call', 'sub_call') and ts is not null and run_id <> ''").select(
        *run_keys, F.when(F.col("type") == "sub_call", F.lit("sub_lm")).otherwise(F.lit("tool")).alias("entry_kind"), F.when(F.col("type") == "tool_call", tool).alias("tool"), shown.alias("label"), ok.alias("ok"), "ts", "step_key", order().alias("place"), _entry().alias("fields")
    )
    by = Window.partitionBy(*run_keys).orderBy("step_key", "place")
    clock = run_clock(events, run_keys)
    calls = calls.withColumn("seq", (F.row_number().over(by) - 1).cast("long")).withColumn("before", F.lag("ts").over(by)).withColumn("first", F.col("seq") == 0)
    calls = calls.join(clock, run_keys)
    since = F.when(F.col("first"), F.col("started_at")).otherwise(F.col("before"))
    calls = calls.withColumn("duration_s", F.round(F.col("ts") - since, 3)).withColumn("rel_s", F.round(F.col("ts") - F.col("started_at"), 3))
    # As-of join: turns and calls in one line by time, turns first; each call takes the last turn before it.
    marks = turns(events, run_keys).where("rel_s is not null").select(*run_keys, "rel_s", "index", F.lit(0).alias("side"), F.lit(None).cast("long").alias("seq"))
    line = marks.unionByName(calls.where("per_turn_timing and rel_s is not null").select(*run_keys, "rel_s", F.lit(None).cast("long").alias("index"), F.lit(1).alias("side"), "seq"))
    along = Window.partitionBy(*run_keys).orderBy("rel_s", "side", "index")
    line = line.withColumn("asof", F.last("index", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.withColumn("earliest", F.min(F.when(F.col("side") == 0, F.struct("rel_s", "index"))).over(Window.partitionBy(*run_keys))["index"])
    found = line.where("side = 1").select(*run_keys, "seq", F.coalesce("asof", "earliest").alias("turn_index"))
    out = calls.join(found, [*run_keys, "seq"], "left")
    return out.select(*run_keys, "seq", "entry_kind", "tool", "label", "ok", "rel_s", "duration_s", "turn_index", "fields")


def composition(meta: Column) -> dict[str, Column]:
    """How many of a run's transcripts are sessions and sub-agents; null where the meta does not say."""
    listed = V.as_array(V.get(meta, "$.transcript_index"))
    of = lambda k: F.when(listed.isNotNull(), F.size(F.filter(listed, lambda x: F.coalesce(V.as_str(V.get(x, "$.kind")) == k, F.lit(False)))).cast("long"))
    return {"transcript_sessions": of("session"), "transcript_subagents": of("subagent")}


def initial_state(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """run_keys and what the run began with: the project's last path part, counts, models and limits."""
    m = lambda name: V.get(F.col("meta"), f"$.{name}")
    listed = V.as_array(m("rubric"))
    return run_clock(events, run_keys).select(
        *run_keys, basename(V.as_str(m("project_dir"))).alias("project"), V.as_int(m("transcripts")).alias("transcripts"), *(c.alias(n) for n, c in composition(F.col("meta")).items()), V.as_int(m("memory_artifacts")).alias("memory_artifacts"),
        label(V.as_str(m("planner"))).alias("planner"), label(V.as_str(m("drafter"))).alias("drafter"), label(V.as_str(m("interpreter"))).alias("interpreter"), F.when(listed.isNotNull(), F.size(listed).cast("long")).alias("rubric_criteria"),
        V.as_int(m("max_iterations")).alias("max_iterations"), V.as_int(m("max_llm_calls")).alias("max_llm_calls"),
    )


def scalar_fields(payload: Column) -> Column:
    """The short scalars of a payload as JSON: no containers, long or path-shaped strings, and none of the keys shown
    elsewhere."""
    kept = F.map_filter(V.as_map(payload), lambda k, v: ~k.isin("tool", "ok", "args", "resolved_path", "note") & ((V.kind(v) == "BOOLEAN") | V.is_number(v) | F.coalesce((F.length(V.as_str(v)) <= LABEL) & ~looks_like_path(V.as_str(v)), F.lit(False))))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(kept, lambda _, v: F.to_json(v))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))))


def feed(events: DataFrame) -> DataFrame:
    """events with event and data (JSON), for those that the public feed shows: others, unknown tools and final go."""
    tool = V.as_str(p("tool"))
    rubric = V.as_array(p("meta.rubric"))
    categories = F.array_sort(F.array_distinct(F.filter(F.transform(rubric, lambda c: V.as_str(V.get(c, "$.category"))), lambda c: c != "")))
    meta = F.when(V.is_object(p("meta")), p("meta"))
    options = {"ignoreNullFields": "false"}
    js = lambda *c: F.to_json(F.struct(*c), options)
    created = js(V.get(meta, "$.transcripts").alias("transcripts"), *(c.alias(n) for n, c in composition(meta).items()), V.get(meta, "$.memory_artifacts").alias("memory_artifacts"), F.struct(F.coalesce(categories, F.array().cast("array<string>")).alias("categories"), F.coalesce(F.size(rubric), F.lit(0)).alias("criteria")).alias("rubric"))
    step = js(p("turn").alias("turn"), p("reasoning").alias("reasoning"), V.truthy(p("code")).alias("has_code"))
    sub = js(p("input").alias("input"), F.when(V.truthy(p("processed")), p("processed")).otherwise(p("raw")).alias("processed_or_raw"))
    draft = js(tool.alias("tool"), p("artifact_id").alias("artifact_id"), p("relative_path").alias("relative_path"), p("ok").alias("ok"), F.when(V.truthy(p("errors")), p("errors")).otherwise(F.parse_json(F.lit("[]"))).alias("errors"), V.truthy(p("circuit_broken")).alias("circuit_broken"))
    read = js(tool.alias("tool"), scalar_fields(F.col("payload")).alias("fields"))
    t = F.col("type")
    drafts, reads = tool.isin(*DRAFT_TOOLS, EXTRA_TOOL), tool.isin(*READ_TOOLS)
    name = (
        F.when(t == "run_start", "distill.run.created").when(t == "main_step", "distill.plan.step").when(t == "sub_call", "distill.sub_lm.call").when((t == "tool_call") & reads, "distill.evidence.read")
        .when((t == "tool_call") & drafts, "distill.draft.created").when(t == "result", "distill.plan.done").when(t == "run_end", "distill.run.completed")
    )
    data = F.when(t == "run_start", created).when(t == "main_step", step).when(t == "sub_call", sub).when((t == "tool_call") & reads, read).when((t == "tool_call") & drafts, draft).otherwise(F.lit("{}"))
    return events.withColumn("event", name).where("event is not null").withColumn("data", data)


def replay_feed(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """run_keys, seq, event, data: the feed of each run in replay order; a run that never said so gets its completion."""
    shown = feed(events.where("run_id <> ''")).select(*run_keys, "step_key", order().alias("place"), "event", "data", F.lit(0).alias("made"))
    known = events.where("run_id <> ''").select(*run_keys).distinct()
    open_runs = known.join(events.where("type = 'run_end'").select(*run_keys).distinct(), run_keys, "left_anti")
    ends = open_runs.select(*run_keys, F.lit(None).cast("bigint").alias("step_key"), F.lit(None).cast(shown.schema["place"].dataType).alias("place"), F.lit("distill.run.completed").alias("event"), F.lit("{}").alias("data"), F.lit(1).alias("made"))
    by = Window.partitionBy(*run_keys).orderBy("made", "step_key", "place")
    return shown.unionByName(ends).withColumn("seq", (F.row_number().over(by) - 1).cast("long")).select(*run_keys, "seq", "event", "data")


def without_repeats(rows: DataFrame, keys: list[str], by: list[str], value: str) -> DataFrame:
    """rows without those whose value equals that of the row before (nulls are equal to each other)."""
    along = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("__first", F.row_number().over(along) == 1).withColumn("__before", F.lag(value).over(along)).where(F.col("__first") | ~F.col(value).eqNullSafe(F.col("__before"))).drop("__first", "__before")
