"""Streams over several micro-batches: bounded state, repeats of batches, and the end of silent runs."""

import os

import pytest
from helpers import event, write_lines
from pyspark.sql import functions as F

from runlore.operators import labels
from runlore.sources.traces import read_traces
from runlore.streaming import feeds

HOUR = 3600.0
#: An event at the epoch is as old as the first watermark, and late.
BASE = 1_700_000_000


@pytest.fixture
def files(tmp_path):
    """Six files, a few hours apart; runs that end, fall silent and go on."""
    for i in range(6):
        at = BASE + i * 5 * HOUR
        lines = [event(f"s{i}", k, "main_step", {"turn": k}, at + 60 * k) for k in range(4)]
        lines += [event("long", 10 * i + k, "tool_call", {"tool": "draft_memory_file", "ok": k == 0}, at + 100 + k) for k in range(2)]
        lines += [event(f"s{i}", 4, "run_end", {}, at + 300)] if i % 2 else []
        write_lines(tmp_path / "in", f"{i}.jsonl", lines)
    return tmp_path / "in"


def stream(spark, folder):
    for f in folder.iterdir():  # files come in the order of their times
        os.utime(f, (BASE + int(f.stem), BASE + int(f.stem)))
    return feeds.trace_stream(spark, f"file://{folder}", files_at_once=1)


def test_metrics_in_parts_are_those_of_the_batch_and_state_is_bounded(spark, files):
    s = feeds.live_metrics(stream(spark, files))
    top, progress = feeds._run(s, "parts", "update")
    rows = feeds._batches(s, top)
    got = {r["run_id"]: r.asDict() for r in feeds.merged_metrics(feeds.latest(rows, ["run_id", "part"])).collect()}
    want = {r["run_id"]: r.asDict() for r in labels.run_metrics(read_traces(spark, f"file://{files}")).collect()}
    for run, r in got.items():
        assert r == {k: want[run][k] for k in r}, run
    assert set(got) == set(want)
    held = feeds.state_rows(progress)
    assert len(held) > 6 and held[-1] < max(held)  # what the watermark has passed is gone
    assert max(held) < 30  # of 36 events and a part for each run and hour


def test_a_batch_that_is_written_again_replaces_itself(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 5, 0), ("a", 3, 1), ("a", 7, 3)], "k string, n int, batch long")
    assert {(r["k"], r["n"]) for r in feeds.latest(rows, ["k"]).collect()} == {("a", 7), ("b", 5)}


def life(spark, folder, gap="30 minutes", late="1 hour"):
    s = feeds.run_lifecycle(stream(spark, folder), gap, late)
    top, progress = feeds._run(s, "life", "update")
    rows = feeds.merged_lifecycle(feeds.latest(feeds._batches(s, top), ["run_id", "started"]))
    return {(r["run_id"], int(r["s"])): (r["events"], r["state"], r["event"]) for r in rows.select("*", (F.unix_micros("started") / 1e6).alias("s")).collect()}, progress


def test_silent_runs_get_the_end_that_is_missing(spark, files):
    got, progress = life(spark, files)
    for i in range(6):
        at = int(BASE + i * 5 * HOUR)
        own = ("open", None) if i == 5 else ("completed", None) if i % 2 else ("closed", "distill.run.completed")
        assert got[f"s{i}", at] == (4 + i % 2, *own)
        assert got["long", at + 100] == (2, *(("open", None) if i == 5 else ("closed", "distill.run.completed")))
    assert len(got) == 12
    held = feeds.state_rows(progress)
    assert held[-1] <= 4 and max(held) <= 4


def test_events_out_of_order_join_stretches(spark, tmp_path):
    """Two stretches of a run become one when what lies between them comes late; the later one's row goes."""
    for i, times in enumerate(([0, 600], [4000, 4100], [2000, 2900], [9000], [7300])):
        write_lines(tmp_path / "in", f"{i}.jsonl", [event("r", 100 * i + k, "main_step", {}, float(BASE + t)) for k, t in enumerate(times)])
    got, _ = life(spark, tmp_path / "in", "30 minutes", "2 hours")
    assert {k: v[:2] for k, v in got.items()} == {("r", BASE): (6, "open"), ("r", BASE + 7300): (2, "open")}


def test_hours_and_empty_streams(spark, files, tmp_path):
    hours = feeds.upserted(feeds.hourly_activity(stream(spark, files)), "hours", ["hour", "type"])
    want = read_traces(spark, f"file://{files}").groupBy(F.floor(F.col("ts") / 3600).alias("h"), "type").count()
    assert {((r["hour"].timestamp()) // 3600, r["type"], r["n"]) for r in hours.collect()} == {(r["h"], r["type"], r["count"]) for r in want.collect()}
    (tmp_path / "none").mkdir()
    assert feeds.upserted(feeds.live_metrics(stream(spark, tmp_path / "none")), "none", ["run_id", "part"]).count() == 0
    assert feeds.drained(feeds.live_feed(stream(spark, tmp_path / "none")), "none").count() == 0
