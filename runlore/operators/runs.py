"""A run's plan, meta and drafting calls, and the plan assembled from them.

Runs are told apart by run_keys: run_id where all files are one set, (path, run_id) where files are kept apart. "First"
and "last" mean file order, (path, line_no). All steps share the partitioning by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.functions import variants as V

RUN = ["run_id"]
ACTIONS = ["keep", "prune", "promote_to_memory", "promote_to_skill"]
TOOL_OF = {"promote_to_memory": "draft_memory_file", "promote_to_skill": "draft_skill_file"}
DRAFT_TOOLS = list(TOOL_OF.values())
EXTRA_TOOL = "draft_skill_extra_file"
READ_TOOLS = ["list_memory_files", "read_memory_file", "read_transcript_chunk"]
CAUSES = ["ok", "invalid", "endpoint", "circuit_broken"]

PLAN = "array<struct<action:string,artifact_id:string,key_fields:variant>>"


def order() -> Column:
    return F.struct("path", "line_no")


def p(path: str) -> Column:
    """A value of the payload."""
    return V.get(F.col("payload"), f"$.{path}")


def tool() -> Column:
    return V.as_str(p("tool"))


def is_call(*tools: str) -> Column:
    return (F.col("type") == "tool_call") & F.coalesce(tool().isin(*tools), F.lit(False))


def draft_cause(payload: Column) -> Column:
    """ok, invalid, endpoint or circuit_broken: what is recorded, else the breaker, then an error of the endpoint (an
    empty one counts, a null one does not), then the verdict."""
    said = V.as_str(V.get(payload, "$.cause"))
    error = ~V.is_null(V.get(payload, "$.endpoint_error")) | ~V.is_null(V.get(payload, "$.error"))
    derived = F.when(V.truthy(V.get(payload, "$.circuit_broken")), F.lit("circuit_broken")).when(error, F.lit("endpoint")).when(V.truthy(V.get(payload, "$.ok")), F.lit("ok")).otherwise(F.lit("invalid"))
    return F.when(said.isin(*CAUSES), said).otherwise(derived)


def run_meta(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """run_keys, meta: of each run's first run_start; {} where it is no object. Runs without one have no row."""
    starts = events.where("type = 'run_start'")
    meta = F.when(V.is_object(p("meta")), p("meta")).otherwise(F.parse_json(F.lit("{}")))
    # VARIANT has no order, so it travels beside the order as JSON text.
    first = starts.groupBy(*run_keys).agg(F.min_by(F.to_json(meta), order()).alias("meta"))
    return first.withColumn("meta", F.parse_json("meta"))


def valid_plan(output: Column) -> Column:
    """The candidates of a plan, or null if it is invalid as a whole. No candidates key: an empty plan."""
    listed = V.get(output, "$.candidates")
    one = lambda c: F.struct(V.as_str(V.get(c, "$.action")).alias("action"), V.as_str(V.get(c, "$.artifact_id")).alias("artifact_id"), F.coalesce(V.get(c, "$.key_fields"), F.parse_json(F.lit("{}"))).alias("key_fields"))

    def sound(c):
        artifact = V.get(c, "$.artifact_id")
        fields = V.get(c, "$.key_fields")
        return V.is_object(c) & F.coalesce(V.as_str(V.get(c, "$.action")).isin(*ACTIONS), F.lit(False)) & (V.is_null(artifact) | V.as_str(artifact).isNotNull()) & (fields.isNull() | V.is_object(fields))

    found = V.as_array(listed)
    return F.when(listed.isNull(), F.array().cast(PLAN)).when(found.isNotNull() & F.forall(found, sound), F.transform(found, one).cast(PLAN))


def run_plans(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """run_keys, plan: of the last result whose output is an object; null if that one is invalid. Other runs have no row."""
    results = events.where("type = 'result'").withColumn("output", p("output")).where(V.is_object(F.col("output")))
    last = results.groupBy(*run_keys).agg(F.max_by(F.to_json("output"), order()).alias("output"))
    return last.withColumn("plan", valid_plan(F.parse_json("output"))).drop("output")


def draft_calls(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """run_keys, tool, artifact_id, draft, ok, cause, errors: the last call of each drafting tool for each artifact."""
    calls = events.where(is_call(*DRAFT_TOOLS)).withColumn("artifact_id", V.as_str(p("artifact_id"))).where("artifact_id <> ''")
    return _last(calls, [*run_keys, "tool", "artifact_id"])


def extra_calls(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """run_keys, artifact_id, relative_path, draft, ok, cause, errors, seen: the last call for each supplementary file;
    seen is the place of its first, which a retry does not change."""
    calls = events.where(is_call(EXTRA_TOOL)).withColumn("artifact_id", V.as_str(p("artifact_id"))).withColumn("relative_path", V.as_str(p("relative_path")))
    return _last(calls.where("artifact_id <> '' and relative_path <> ''"), [*run_keys, "artifact_id", "relative_path"])


def _last(calls: DataFrame, keys: list[str]) -> DataFrame:
    rows = calls.withColumn("tool", tool())
    detail = F.coalesce(F.array_join(F.transform(V.as_array(p("errors")), V.text_of), "; "), F.lit(""))
    kept = F.struct(V.as_str(p("draft")).alias("draft"), V.truthy(p("ok")).alias("ok"), draft_cause(F.col("payload")).alias("cause"), F.when(detail == "", F.lit("no detail recorded")).otherwise(detail).alias("errors"))
    out = rows.groupBy(*keys).agg(F.max_by(kept, order()).alias("last"), F.min(order()).alias("seen"))
    return out.select(*keys, "last.*", "seen")


def quoted(s: Column) -> Column:
    return F.concat(F.lit("'"), s, F.lit("'"))


def not_ok_problem(name: Column, cause: Column, errors: Column) -> Column:
    """Why a draft is not usable, by its cause."""
    # Readers of plans know these sentences.
    never = F.concat(F.lit("artifact "), quoted(name), F.lit(" was never drafted: "))
    broken = F.concat(never, F.lit("the drafting call tripped the circuit breaker (too many consecutive invalid drafts), so the model was never called — "), errors)
    endpoint = F.concat(never, F.lit("the drafting model endpoint failed after its retries, so no draft was produced and no format check ever ran — "), errors)
    return F.when(cause == "circuit_broken", broken).when(cause == "endpoint", endpoint).otherwise(F.concat(F.lit("artifact "), quoted(name), F.lit(" failed its format check: "), errors))


def blank(s: Column) -> Column:
    return F.coalesce(F.regexp_replace(s, "(?U)\\s+", ""), F.lit("")) == ""


def assembled(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """One row for each candidate of each valid plan: run_keys, index, action, artifact_id, key_fields, draft, draft_ok,
    extra_files (array of relative_path, draft, draft_ok in first-seen order) and problems (array, in a fixed order).

    Drafted text is joined from the calls by run, artifact and the tool that the action expects; an id that only the
    other tool drafted, or none, is a problem. Nothing raises: odd candidates are rows with problems. Runs without a
    valid plan have no rows. The events are read once (layout.laid_out).
    """
    from runlore.operators.layout import assembled_of, laid_out

    return assembled_of(laid_out(events, run_keys), run_keys)


def assemble(plans: DataFrame, calls: DataFrame, extra: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """assembled from what run_plans, draft_calls and extra_calls give."""
    plans = plans.where("plan is not null")
    rows = plans.select(*run_keys, F.posexplode("plan").alias("index", "c")).select(*run_keys, "index", "c.*")
    expected = F.when(F.col("action") == "promote_to_memory", F.lit("draft_memory_file")).when(F.col("action") == "promote_to_skill", F.lit("draft_skill_file"))
    rows = rows.withColumn("tool", expected).withColumn("named", F.coalesce(F.col("artifact_id") != "", F.lit(False)))
    # Both tools' calls of an artifact in one row, so one join answers "drafted", "by the other" and "never".
    each = calls.groupBy(*run_keys, "artifact_id").agg(*(F.first(F.when(F.col("tool") == t, F.struct("draft", "ok", "cause", "errors")), ignorenulls=True).alias(t) for t in DRAFT_TOOLS))
    extras = extra.groupBy(*run_keys, "artifact_id").agg(F.sort_array(F.collect_list(F.struct("seen", "relative_path", "draft", "ok", "cause", "errors"))).alias("extras"))
    out = rows.join(each, [*run_keys, "artifact_id"], "left").join(extras, [*run_keys, "artifact_id"], "left")
    skill = F.col("action") == "promote_to_skill"
    promotes = F.col("tool").isNotNull()
    own = F.when(skill, F.col("draft_skill_file")).otherwise(F.col("draft_memory_file"))
    other = F.when(skill, F.col("draft_memory_file")).otherwise(F.col("draft_skill_file"))
    other_tool = F.when(skill, F.lit("draft_memory_file")).otherwise(F.lit("draft_skill_file"))
    out = out.withColumn("own", F.when(promotes & F.col("named"), own)).withColumn("extras", F.when(skill & F.col("own").isNotNull(), F.coalesce("extras", F.array())))
    has = F.col("own").isNotNull()
    target = V.get(F.col("key_fields"), "$.target_path")
    named_target = V.truthy(target) & ~blank(V.text_of(target))
    say = F.concat
    of_extra = lambda x: F.array(
        F.when(blank(x["draft"]), say(F.lit("extra file "), quoted(x["relative_path"]), F.lit(" for artifact "), quoted(F.col("artifact_id")), F.lit(" recorded an empty draft"))),
        F.when(~x["ok"], not_ok_problem(F.concat(F.col("artifact_id"), F.lit(":"), x["relative_path"]), x["cause"], x["errors"])),
    )
    # Readers of plans know these sentences.
    first = F.array(
        F.when(~promotes & F.col("named"), say(F.lit("action "), quoted(F.col("action")), F.lit(" carries artifact_id "), quoted(F.col("artifact_id")), F.lit(", but only ['promote_to_memory', 'promote_to_skill'] draft an artifact"))),
        F.when((F.col("action") == "prune") & ~named_target, F.lit("action 'prune' carries no usable `key_fields[\"target_path\"]`, so nothing identifies the file it proposes to remove — apply refuses such a candidate")),
        F.when(promotes & ~F.col("named"), say(F.lit("action "), quoted(F.col("action")), F.lit(" carries no artifact_id, so there is no "), F.col("tool"), F.lit(" call to assemble its text from"))),
        F.when(promotes & F.col("named") & ~has & other.isNotNull(), say(F.lit("artifact_id "), quoted(F.col("artifact_id")), F.lit(" was drafted by "), other_tool, F.lit(" but the candidate's action "), quoted(F.col("action")), F.lit(" expects "), F.col("tool"))),
        F.when(promotes & F.col("named") & ~has & other.isNull(), say(F.lit("no "), F.col("tool"), F.lit(" tool_call for artifact_id "), quoted(F.col("artifact_id")), F.lit(" (the plan names an artifact this run never drafted)"))),
        F.when(has & blank(F.col("own.draft")), say(F.lit("artifact "), quoted(F.col("artifact_id")), F.lit(" recorded an empty draft"))),
        F.when(has & ~F.col("own.ok"), not_ok_problem(F.col("artifact_id"), F.col("own.cause"), F.col("own.errors"))),
    )
    problems = F.concat(first, F.coalesce(F.flatten(F.transform("extras", of_extra)), F.array().cast("array<string>")))
    files = F.transform("extras", lambda x: F.struct(x["relative_path"].alias("relative_path"), x["draft"].alias("draft"), x["ok"].alias("draft_ok")))
    return out.select(
        *run_keys, "index", "action", "artifact_id", "key_fields", F.col("own.draft").alias("draft"), F.col("own.ok").alias("draft_ok"),
        F.coalesce(files, F.array().cast("array<struct<relative_path:string,draft:string,draft_ok:boolean>>")).alias("extra_files"), F.filter(problems, lambda x: x.isNotNull()).alias("problems"),
    )


def unused_drafts(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """Drafting calls of artifacts that no candidate of their run names."""
    named = run_plans(events, run_keys).where("plan is not null").select(*run_keys, F.explode("plan.artifact_id").alias("artifact_id"))
    return draft_calls(events, run_keys).join(named, [*run_keys, "artifact_id"], "left_anti").select(*run_keys, "tool", "artifact_id")
