"""Structured Streaming forms: the live feed, metrics as runs go on, closing of silent runs, repeats, hourly counts.

Over the same rows with trigger(availableNow=True) they give what the batch operators give. State is bounded by
watermarks. Trace files are append-only, which a file source cannot follow: streams read rotated files or a log.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from runlore.folders import new_dir
from runlore.functions.text import ANY_LINE_END, lines_of
from runlore.operators.runs import DRAFT_TOOLS, READ_TOOLS, draft_cause, is_call
from runlore.operators.timeline import feed
from runlore.sources.traces import normalised


def trace_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """The events of rotated trace files as they come, with event_time; torn and blank lines are left out."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).schema("value string").load(folder)
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(lines_of(F.col("value"), ANY_LINE_END)).alias("line_no", "line"))
    return timed(normalised(lines.withColumn("v", F.try_parse_json("line")).where("v is not null")))


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))


def live_feed(events: DataFrame) -> DataFrame:
    """run_id, step_id, event, data of each event that the feed shows; no state."""
    return feed(events).select("run_id", "step_id", "event", "data")


def live_metrics(events: DataFrame, late: str = "1 hour", part: str = "1 hour") -> DataFrame:
    """What run_metrics counts, by run and part (a tumbling window of event time), for output mode update: an event that
    comes twice within `late` counts once, later ones are dropped. State is bounded: a part's row goes once the watermark
    has passed it, however long its run goes on. merged_metrics adds the parts up."""
    drafts = is_call(*DRAFT_TOOLS)
    cause = F.when(drafts, draft_cause(F.col("payload")))
    once = events.where("run_id <> ''").withWatermark("event_time", late).dropDuplicatesWithinWatermark(["run_id", "step_id"])
    out = once.groupBy("run_id", F.window("event_time", part).alias("w")).agg(
        F.count_if(F.col("type") == "main_step").alias("steps"),
        *(F.count_if(is_call(t)).alias(f"{t}_calls") for t in [*READ_TOOLS, *DRAFT_TOOLS]),
        F.count_if(cause == "invalid").alias("draft_validator_rejects"),
        F.count_if(cause == "endpoint").alias("draft_endpoint_errors"),
        F.count_if(cause == "circuit_broken").alias("draft_circuit_breaks"),
        F.count_if(cause != "ok").alias("draft_not_ok"),
        F.count_if(F.col("type") == "sub_call").alias("sub_calls"),
        F.count("ts").alias("stamps"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    return out.select("run_id", F.col("w.start").alias("part"), *(c for c in out.columns if c not in ("run_id", "w")))


def merged_metrics(parts: DataFrame) -> DataFrame:
    """The metrics of each run from the latest rows of its parts."""
    counts = [c for c in parts.columns if c not in ("run_id", "part", "stamps", "first_ts", "last_ts")]
    elapsed = F.when(F.sum("stamps") >= 2, F.round(F.max("last_ts") - F.min("first_ts"), 3))
    return parts.groupBy("run_id").agg(*(F.sum(c).alias(c) for c in counts), elapsed.alias("elapsed_s"))


#: A stretch of a run: state open while it may go on, closed when it was silent, or completed when the run said so.
STRETCH = "run_id string, started long, ended long, events long, state string, event string, data string"


def run_lifecycle(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of each run without a silence of `gap`, for output mode update: run_id, started, ended, events, state,
    and event and data of what the feed is told.

    A run that ends with run_end tells so itself: its stretch is completed. One that falls silent never would, so once the
    watermark is `gap` past its last event a timer closes it and its row carries the event run.completed that was missing.
    Until then a stretch is given as open by every batch that touches it; merged_lifecycle keeps what is true. State is a
    few numbers a stretch that is open (events come in any order within `late`, so a run can have more than one) and goes
    when it closes.
    """
    gap_us = _micros(gap)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        gone: list[tuple[int, int]] = []
        for rows in () if state.hasTimedOut else batches:
            at = rows["at"].to_numpy()
            place = at.argsort(kind="stable")
            at, end = at[place], (rows["type"] == "run_end").to_numpy()[place]
            cuts = np.flatnonzero(np.diff(at) >= gap_us) + 1
            for a, e in zip(np.split(at, cuts), np.split(end, cuts), strict=True):
                open_, merged = _joined(open_, (int(a[0]), int(a[-1]), len(a), bool(e.any())), gap_us)
                gone += merged
        mark = state.getCurrentWatermarkMs() * 1000
        closed = [x for x in open_ if x[1] + gap_us <= mark]
        still = [x for x in open_ if x[1] + gap_us > mark]
        out = [(key[0], a, b, 0, "merged", None, None) for a, b in gone if a not in {x[0] for x in open_}]
        for a, b, n, said in closed:
            out.append((key[0], a, b, n, "completed" if said else "closed", None if said else "distill.run.completed", None if said else "{}"))
        if not state.hasTimedOut:
            out += [(key[0], a, b, n, "open", None, None) for a, b, n, _ in still]
        if still:
            state.update((json.dumps(still),))
            state.setTimeoutTimestamp(max(min(x[1] for x in still) + gap_us, mark + 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in STRETCH.split(", ")])

    # Times travel as microseconds, so that no session time zone comes between them and the watermark.
    rows = events.where("run_id <> '' and event_time is not null").withWatermark("event_time", late)
    rows = rows.select("run_id", "event_time", F.unix_micros("event_time").alias("at"), "type")
    out = rows.groupBy("run_id").applyInPandasWithState(step, STRETCH, "stretches string", "update", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})


def _micros(span: str) -> int:
    amount, unit = span.split()
    return int(float(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000)


def _joined(open_: list[tuple], new: tuple, gap: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """The open stretches (start, end, events, said) with one more, those less than gap apart joined; and those that are
    part of another now."""
    near = [x for x in open_ if x[0] - new[1] < gap and new[0] - x[1] < gap]
    rest = [x for x in open_ if x not in near]
    whole = [*near, new]
    start = min(x[0] for x in whole)
    joined = (start, max(x[1] for x in whole), sum(x[2] for x in whole), any(x[3] for x in whole))
    return sorted([*rest, joined]), [(x[0], x[1]) for x in near if x[0] != start]


def merged_lifecycle(rows: DataFrame) -> DataFrame:
    """Each stretch once, as its latest row says; those that became part of another are gone."""
    return rows.where("state <> 'merged'")


def hourly_activity(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, type, n: counts in tumbling hours, for output mode update; an hour's state goes once the watermark has passed it."""
    by = F.window("event_time", "1 hour")
    out = events.withWatermark("event_time", late).groupBy(by.alias("w"), "type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("hour"), "type", "n")


def without_repeats(turns: DataFrame, value: str = "reasoning", silence_ms: int = 3_600_000, late: str = "1 hour") -> DataFrame:
    """turns (run_id, step_key, value, event_time) without those whose value is that of the turn before them in their run.
    A run's state is its last value, and goes when the watermark is silence_ms past its last turn. Turns of a micro-batch
    are taken in step order."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = (True, state.get[0]) if state.exists else (False, None)
        rows = pd.concat(list(batches)).sort_values("step_key", kind="stable")
        kept = []
        for step, x in zip(rows["step_key"], rows[value], strict=True):
            x = None if pd.isna(x) else x
            if not seen or x != last:
                kept.append((key[0], step, x))
            seen, last = True, x
        state.update((last,))
        latest = int(rows["event_time"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + silence_ms)
        yield pd.DataFrame(kept, columns=["run_id", "step_key", value])

    return turns.withWatermark("event_time", late).groupBy("run_id").applyInPandasWithState(keep, f"run_id string, step_key long, {value} string", f"{value} string", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream in mode append has now, as a table: its batches are Parquet in the folder that driver and
    executors share, and no row passes through the driver."""
    top, _ = _run(stream, name, "append")
    return _batches(stream, top).drop("batch")


def upserted(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """All that a stream in mode update has now, as a table with the latest row of each key. A batch is a folder by its
    number: one that is written again after a failure replaces itself, so the table is right however often that happens."""
    top, _ = _run(stream, name, "update")
    return latest(_batches(stream, top), keys)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with batch the one with the greatest batch of each of keys; a batch has a key once at most."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*")


def _run(stream: DataFrame, name: str, mode: str) -> tuple[str, list[dict]]:
    """The folder with the batches of a stream, and the progress of each."""
    top = new_dir(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return top, [json.loads(p.json) for p in q.recentProgress]


def _batches(stream: DataFrame, top: str) -> DataFrame:
    """All batches of a folder of _run, with batch."""
    spark = stream.sparkSession
    schema = StructType([*stream.schema, StructField("batch", LongType())])
    try:
        return spark.read.schema(schema).parquet(f"{top}/rows")
    except AnalysisException as e:  # a stream without a batch has no folder
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def state_rows(progress: list[dict]) -> list[int]:
    """Rows of state after each batch, of all stateful operators."""
    return [sum(x["numRowsTotal"] for x in p["stateOperators"]) for p in progress]
