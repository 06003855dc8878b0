"""The dataset bundle: action records, their splits, fine-tuning turns, and labels by run."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlore.functions import variants as V
from runlore.operators import labels
from runlore.operators.runs import DRAFT_TOOLS, READ_TOOLS, RUN, order, p, run_meta


def actions(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """run_keys, step_id, kind (planner, tool or sub_call), tool, args, ok, output, reward: the complete, ordered record.
    output is the first of raw, result, results and preview; reward is always null."""
    kind = F.when(F.col("type") == "main_step", "planner").when(F.col("type") == "tool_call", "tool").when(F.col("type") == "sub_call", "sub_call")
    found = F.coalesce(*(F.when(~V.is_null(p(c)), p(c)) for c in ("raw", "result", "results", "preview")))
    planner = F.col("type") == "main_step"
    rows = events.where("run_id <> ''").withColumn("kind", kind).where("kind is not null")
    return rows.select(
        *run_keys, "path", "line_no", "step_id", "step_key", "kind", F.when(F.col("kind") == "tool", V.as_str(p("tool"))).alias("tool"),
        F.when(planner, V.text_of(p("code"))).otherwise(F.to_json(p("args"))).alias("args"), F.when(V.kind(p("ok")) == "BOOLEAN", F.try_variant_get(p("ok"), "$", "boolean")).alias("ok"),
        F.when(planner, V.text_of(p("output"))).otherwise(V.text_of(found)).alias("output"), F.lit(None).cast("double").alias("reward"),
    )


def splits(acts: DataFrame) -> dict[str, DataFrame]:
    """Slices of actions. A tool of neither list is in neither slice, and still in actions."""
    tools = acts.where("kind = 'tool'")
    return {"actions": acts, "drafting": tools.where(F.col("tool").isin(*DRAFT_TOOLS)), "orchestrator_tools": tools.where(F.col("tool").isin(*READ_TOOLS)), "planner": acts.where("kind = 'planner'")}


def sft_turns(events: DataFrame, run_keys: list[str] = RUN, history_turns: int | None = None) -> DataFrame:
    """run_keys, turn, initial (the run's meta as JSON), history (the earlier turns in order), reasoning, code, output.
    history_turns: only so many of the latest, where full histories would be too long; by default all."""
    rows = events.where("type = 'main_step' and run_id <> ''").select(*run_keys, V.as_int(p("turn")).alias("turn"), *(V.text_of(p(c)).alias(c) for c in ("reasoning", "code", "output")), "step_key", order().alias("place"))
    first = -history_turns if history_turns is not None else Window.unboundedPreceding
    by = Window.partitionBy(*run_keys).orderBy(F.coalesce("turn", F.lit(1 << 30)), "step_key", "place").rowsBetween(first, -1)
    rows = rows.withColumn("history", F.collect_list(F.struct("turn", "reasoning", "code", "output")).over(by))
    initial = run_meta(events, run_keys).select(*run_keys, F.to_json("meta").alias("initial"))
    return rows.join(initial, run_keys, "left").select(*run_keys, "turn", F.coalesce("initial", F.lit("{}")).alias("initial"), "history", "reasoning", "code", "output")


def sft_chain(events: DataFrame, run_keys: list[str] = RUN) -> tuple[DataFrame, DataFrame]:
    """sft_turns in space linear in the turns, as two tables.

    heads: run_keys, place (of the turn in its run, from 0), prefix and digest: the digests of the turns before it and of
    those with it; initial. turns: digest, turn, reasoning, code, output, once for each distinct digest, however many runs
    share their first turns. A digest is that of the run's sequence up to its turn: 128 bits, made from a hash of each
    turn and its place, so that a window adds them up.
    """
    rows = events.where("type = 'main_step' and run_id <> ''")
    said = [V.text_of(p(c)).alias(c) for c in ("reasoning", "code", "output")]
    rows = rows.select(*run_keys, V.as_int(p("turn")).alias("turn"), *said, "step_key", order().alias("place_"))
    by = Window.partitionBy(*run_keys).orderBy(F.coalesce("turn", F.lit(1 << 30)), "step_key", "place_")
    rows = rows.withColumn("place", F.row_number().over(by) - 1)
    # A null text is not an empty one: each is hashed with whether it is there.
    parts = ["place", "turn", *(x for c in ("reasoning", "code", "output") for x in (F.col(c).isNull(), c))]
    rows = rows.withColumn("h1", F.xxhash64(*parts)).withColumn("h2", F.xxhash64(F.lit(7), *parts))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    digest = F.concat(*(F.lpad(F.hex(F.bit_xor(h).over(upto)), 16, "0") for h in ("h1", "h2")))
    rows = rows.withColumn("digest", digest).withColumn("prefix", F.coalesce(F.lag("digest").over(by), F.lit("")))
    turns_ = rows.groupBy("digest").agg(*(F.any_value(c).alias(c) for c in ("turn", "reasoning", "code", "output")))
    initial = run_meta(events, run_keys).select(*run_keys, F.to_json("meta").alias("initial"))
    heads = rows.select(*run_keys, "place", "prefix", "digest").join(initial, run_keys, "left")
    return heads.withColumn("initial", F.coalesce("initial", F.lit("{}"))), turns_


def expanded(heads: DataFrame, turns_: DataFrame, run_keys: list[str] = RUN, history_turns: int | None = None) -> DataFrame:
    """sft_turns again, from what sft_chain gives."""
    rows = heads.join(turns_, "digest")
    first = -history_turns if history_turns is not None else Window.unboundedPreceding
    by = Window.partitionBy(*run_keys).orderBy("place").rowsBetween(first, -1)
    rows = rows.withColumn("history", F.collect_list(F.struct("turn", "reasoning", "code", "output")).over(by))
    return rows.select(*run_keys, "turn", "initial", "history", "reasoning", "code", "output")


def bundle(events: DataFrame, run_keys: list[str] = RUN) -> dict[str, DataFrame]:
    """The eight tables of the export. An empty set of runs is refused, as nothing would say that the input was missed."""
    if not events.where("run_id <> ''").limit(1).count():
        raise ValueError("no run was found in the input")
    out = {**splits(actions(events, run_keys)), "sft_turns": sft_turns(events, run_keys), "labels": labels.run_labels(events, run_keys), "metrics": labels.run_metrics(events, run_keys), "rubric_signal": labels.criteria_facts(events, run_keys)}
    for name, df in out.items():
        if name == "reward" or name in ("labels", "metrics", "rubric_signal") and "reward" in df.columns:
            raise ValueError("labels carry no reward")
    return out


#: The file that makes a bundle visible, written last.
MANIFEST = "_manifest"


def write_bundle(events: DataFrame, out_dir: str, run_keys: list[str] = RUN, buckets: int = 16) -> str:
    """Every table of the bundle as Parquet, in folders by the run's hash, as one commit: tables go to a folder of this
    attempt, and a manifest that names them and their rows is written when all are there. A failure before that leaves
    nothing that a reader sees; a later bundle replaces an earlier one for readers at once. Returns the attempt's name."""
    spark = events.sparkSession
    attempt = uuid.uuid4().hex
    hashed = F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int")
    entries = []
    for name, df in bundle(events, run_keys).items():
        path = f"{out_dir}/tables/{attempt}/{name}"
        df.withColumn("run_bucket", hashed).write.mode("errorifexists").partitionBy("run_bucket").parquet(path)
        rows = spark.read.schema(df.schema).parquet(path).count()
        entries.append((attempt, name, rows, df.schema.json()))
    made = spark.createDataFrame(entries, "attempt string, name string, rows long, schema string").coalesce(1)
    # One file in a folder of its own, numbered behind those that are there; a reader takes the last that is whole.
    number = _manifests(spark, out_dir).agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0] + 1
    made.write.mode("errorifexists").json(f"{out_dir}/{MANIFEST}/number={number}")
    return attempt


def _manifests(spark: SparkSession, out_dir: str) -> DataFrame:
    schema = "attempt string, name string, rows long, schema string, number int"
    try:
        return spark.read.schema(schema).json(f"{out_dir}/{MANIFEST}")
    except AnalysisException as e:  # no bundle yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_bundle(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The tables of the last bundle whose manifest was written; tables without a manifest are not seen."""
    entries = _manifests(spark, out_dir)
    last = entries.join(F.broadcast(entries.agg(F.max("number").alias("number"))), "number").collect()  # a row a table
    if not last:
        raise ValueError(f"{out_dir} holds no whole bundle")
    tables = {}
    for r in last:
        schema = StructType.fromJson(json.loads(r["schema"]))
        tables[r["name"]] = spark.read.schema(schema).parquet(f"{out_dir}/tables/{r['attempt']}/{r['name']}")
    return tables


def summary(events: DataFrame, run_keys: list[str] = RUN) -> DataFrame:
    """One row: runs, actions, drafting, orchestrator_tools, planner and turns, in one pass."""
    tool = V.as_str(p("tool"))
    call = F.col("type") == "tool_call"
    counted = events.where("run_id <> ''").agg(
        F.count_distinct(*run_keys).alias("runs"),
        F.count_if(F.col("type").isin("main_step", "tool_call", "sub_call")).alias("actions"),
        F.count_if(call & tool.isin(*DRAFT_TOOLS)).alias("drafting"),
        F.count_if(call & tool.isin(*READ_TOOLS)).alias("orchestrator_tools"),
        F.count_if(F.col("type") == "main_step").alias("planner"),
    )
    return counted.withColumn("turns", F.col("planner"))
