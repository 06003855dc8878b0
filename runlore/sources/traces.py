"""Run traces: JSON Lines events {schema, run_id, step_id, ts, type, payload} as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.functions import variants as V
from runlore.sources.jsonl import parsed
from runlore.sources.numbered import read_lines

EMPTY = "{}"


def normalised(events: DataFrame) -> DataFrame:
    """path, line_no, run_id, step_id, step_key, ts, ts_any, type, payload from rows with v (VARIANT).

    Lines that are not objects go. A payload that is no object counts as {}, and a meta in it that is none as absent.
    step_key: the numeric step, others last. ts: numbers alone; ts_any also counts booleans as 1 and 0.
    """
    v = F.col("v")
    payload = V.get(v, "$.payload")
    whole = F.when(V.is_object(payload), payload).otherwise(F.parse_json(F.lit(EMPTY)))
    step = V.text_of(V.get(v, "$.step_id"))
    ts = V.get(v, "$.ts")
    return events.where(V.is_object(v)).select(
        "path",
        "line_no",
        V.as_str(V.get(v, "$.run_id")).alias("run_id"),
        step.alias("step_id"),
        step_key(step).alias("step_key"),
        V.as_double(ts).alias("ts"),
        V.as_double(ts, booleans=True).alias("ts_any"),
        V.as_str(V.get(v, "$.type")).alias("type"),
        whole.alias("payload"),
    )


def step_key(step: Column) -> Column:
    """The step as a number; what is no number comes last."""
    return F.coalesce(F.when(step.rlike("^-?[0-9]{1,18}$"), step.cast("bigint")), F.lit(1 << 30))


def read_traces(spark: SparkSession, paths: str | list[str], run_id: str | None = None, on_torn: str = "fail", splits: bool | None = None) -> DataFrame:
    """The events of trace files. A torn line is an error, or is left out with on_torn='skip'; odd shapes are neither.

    Empty files give no rows. run_id: only that run's events. A null text or blank line gives no row; extra keys of an
    event are ignored. splits: as for read_lines; large files are read by many tasks.
    """
    rows = parsed(read_lines(spark, paths, splits=splits))
    if on_torn == "fail":
        said = F.concat(F.lit("torn JSON in "), F.col("path"), F.lit(" line "), F.col("line_no").cast("string"))
        rows = rows.where(F.when(F.col("torn"), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
    out = normalised(rows.where(F.col("v").isNotNull()))
    return out if run_id is None else out.where(F.col("run_id") == run_id)


def runs_found(events: DataFrame) -> DataFrame:
    """path, run_id of every run in every file, sorted. Files without a run contribute nothing."""
    return events.where("run_id <> ''").select("path", "run_id").distinct().orderBy("path", "run_id")
