"""Lines of files that are read in splits, the index of rollouts, and the bundle as one commit."""

import json
import random

import pytest
from helpers import by, event, write_lines
from pyspark.sql import functions as F

from runlore.operators import export, layout, runs
from runlore.plans.files import setting
from runlore.sources import numbered
from runlore.sources.conversations import rollout_index, rollouts
from runlore.sources.traces import read_traces


def rows(df):
    return sorted(tuple(r) for r in df.select(F.regexp_extract("path", "([^/]*)$", 1), "line_no", "line").collect())


@pytest.mark.parametrize("ends", [numbered.ANY_LINE_END, numbered.PLAIN_LINE_END])
def test_splits_number_lines_as_whole_files_do(spark, tmp_path, ends):
    rng = random.Random(3)
    words = ["", "a", "héé", "x" * 40, "{}"]
    for name, breaks in (("plain", ["\n"]), ("mixed", ["\n", "\r\n", "\n\n"]), ("rare", ["\n", "\x0b", " ", "\n", "\x1c"])):
        text = "".join(rng.choice(words) + rng.choice(breaks) for _ in range(900))
        (tmp_path / f"{name}.jsonl").write_bytes((text + "end").encode())
    (tmp_path / "one.jsonl").write_bytes(b"no end")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "blank.jsonl").write_bytes(b"\n\n\n")
    with setting(spark, "spark.sql.files.maxPartitionBytes", "700"), setting(spark, "spark.sql.files.openCostInBytes", "10"):
        lines = numbered.numbered_lines(spark, f"file://{tmp_path}", ends)
        starts = numbered.split_starts(numbered._placed(spark, f"file://{tmp_path}", False, None, None), ends)
        assert max(r["count"] for r in starts.groupBy("path").count().collect()) > 5  # several splits a file
        got = rows(lines)
    assert got == rows(numbered.whole_lines(spark, f"file://{tmp_path}", ends)) and len(got) > 2000
    # The same numbers where the table of splits is too large to be sent out.
    with setting(spark, "spark.sql.files.maxPartitionBytes", "700"), pytest.MonkeyPatch.context() as m:
        m.setattr(numbered, "BROADCAST_SPLITS", 0)
        assert rows(numbered.numbered_lines(spark, f"file://{tmp_path}", ends)) == got


def test_files_that_change_while_they_are_numbered_are_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\n2\n")
    lines = numbered.numbered_lines(spark, f"file://{tmp_path}")
    (tmp_path / "a.txt").write_text("1\n2\n3\n")
    with pytest.raises(Exception, match="changed while"):
        numbered.numbered_lines(spark, f"file://{tmp_path}").unionByName(lines).collect()


def test_traces_in_splits(spark, tmp_path):
    write_lines(tmp_path, "t.jsonl", [x for i in range(400) for x in (event(f"r{i % 3}", i, "main_step", {"turn": i}), "" if i % 7 else '{"run_id": "r0", "type": "sub_call", "ts": NaN}')])
    with setting(spark, "spark.sql.files.maxPartitionBytes", "2000"):
        split = by(read_traces(spark, f"file://{tmp_path}", splits=True).drop("payload"), "line_no")
    assert split == by(read_traces(spark, f"file://{tmp_path}", splits=False).drop("payload"), "line_no") and len(split) == 458
    assert numbered.largest_file(spark, f"file://{tmp_path}") > 20_000


def rollout(folder, name, cwd, *texts):
    said = [{"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": t}]}} for t in texts]
    return write_lines(folder, f"rollout-{name}.jsonl", [{"type": "session_meta", "payload": {"cwd": cwd}}, *said])


def test_index_opens_only_what_is_new(spark, tmp_path, monkeypatch):
    import os

    from runlore.sources import conversations

    store, index_dir = tmp_path / "s", f"file://{tmp_path}/index"
    opened = []
    own = conversations.first_cwds
    monkeypatch.setattr(conversations, "first_cwds", lambda lines: (opened.append(sorted(x.rpartition("/")[2] for x in lines.inputFiles())), own(lines))[1])
    for name, cwd, at in (("a", "/p", 1000), ("b", "/q", 2000), ("c", 7, 3000)):
        os.utime(rollout(store, name, cwd, name)[7:], (at, at))
    first = by(rollout_index(spark, f"file://{store}", index_dir).select(F.regexp_extract("path", "([^/]*)$", 1).alias("f"), "cwd"), "f")
    assert {k: v["cwd"] for k, v in first.items()} == {"rollout-a.jsonl": "/p", "rollout-b.jsonl": "/q", "rollout-c.jsonl": None}
    os.utime(rollout(store, "b", "/moved", "b2")[7:], (5000, 5000))
    os.utime(rollout(store, "d", "/p", "d")[7:], (6000, 6000))
    (store / "rollout-a.jsonl").unlink()
    again = rollout_index(spark, f"file://{store}", index_dir)
    assert {(r["path"].rpartition("/")[2], r["cwd"]) for r in again.collect()} == {("rollout-b.jsonl", "/moved"), ("rollout-c.jsonl", None), ("rollout-d.jsonl", "/p")}
    assert opened == [["rollout-a.jsonl", "rollout-b.jsonl", "rollout-c.jsonl"], ["rollout-b.jsonl", "rollout-c.jsonl", "rollout-d.jsonl"]]  # c: as new as the newest known
    projects = spark.createDataFrame([("/p",), ("/moved",)], "cwd string")
    out = rollouts(spark, f"file://{store}", projects, again)
    assert {(r["cwd"], r["text"]) for r in out.collect()} == {("/moved", "user: b2"), ("/p", "user: d")}
    assert {(r["cwd"], r["text"]) for r in rollouts(spark, f"file://{store}", projects).collect()} == {("/moved", "user: b2"), ("/p", "user: d")}


def test_bundle_is_one_commit(spark, tmp_path, monkeypatch):
    events = read_traces(spark, write_lines(tmp_path / "t", "a.jsonl", [event("r", 0, "run_start", {"meta": {}}), event("r", 1, "main_step", {"turn": 0}), event("r", 2, "result", {"output": {}})]))
    out = f"file://{tmp_path}/out"
    with pytest.raises(ValueError, match="no whole bundle"):
        export.read_bundle(spark, out)
    good = export.bundle

    def torn(*args):
        tables = good(*args)
        return {k: v.withColumn("x", F.raise_error(F.lit("disk full"))) if k == "labels" else v for k, v in tables.items()}

    monkeypatch.setattr(export, "bundle", torn)
    with pytest.raises(Exception, match="disk full"):
        export.write_bundle(events, out)
    with pytest.raises(ValueError, match="no whole bundle"):  # tables are there, but no reader sees them
        export.read_bundle(spark, out)
    monkeypatch.setattr(export, "bundle", good)
    export.write_bundle(events, out)
    tables = export.read_bundle(spark, out)
    assert len(tables) == 8 and tables["labels"].count() == 1 and tables["planner"].count() == 1
    monkeypatch.setattr(export, "bundle", torn)
    with pytest.raises(Exception, match="disk full"):
        export.write_bundle(events.withColumn("run_id", F.lit("other")), out)
    assert export.read_bundle(spark, out)["labels"].first()["run_id"] == "r"  # the last whole one


def test_layout_reads_and_exchanges_events_once(spark, tmp_path):
    events = read_traces(spark, write_lines(tmp_path, "a.jsonl", [event("r", i, "tool_call", {"tool": "draft_memory_file", "artifact_id": f"a{i % 2}", "draft": str(i)}) for i in range(6)]))
    slots = layout.run_slots(events)
    plan = slots._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1
    assert {(r["artifact_id"], r["draft"]) for r in layout.draft_calls_of(slots).collect()} == {(r["artifact_id"], r["draft"]) for r in runs.draft_calls(events).collect()} == {("a0", "4"), ("a1", "5")}


def test_chained_turns_are_linear_and_expand_to_the_full_form(spark, tmp_path):
    turns = lambda run, n, own: [event(run, i, "main_step", {"turn": i, "reasoning": f"r{i}" if i < 20 else own, "code": None if i % 2 else "", "output": "o" * 50}) for i in range(n)]
    lines = [event("a", 0, "run_start", {"meta": {"transcripts": 1}}), *turns("a", 30, "x"), *turns("b", 25, "y"), *turns("c", 20, "z")]
    events = read_traces(spark, write_lines(tmp_path, "t.jsonl", lines))
    heads, nodes = export.sft_chain(events)
    full = export.sft_turns(events)
    key = lambda r: json.dumps(r.asDict(recursive=True), sort_keys=True)
    assert sorted(map(key, export.expanded(heads, nodes).collect())) == sorted(map(key, full.collect()))
    assert heads.count() == 75 and nodes.count() == 35  # the first 20 turns are one chain
    first = {r["place"]: r for r in heads.where("run_id = 'a'").collect()}
    assert first[0]["prefix"] == "" and all(first[i]["prefix"] == first[i - 1]["digest"] for i in range(1, 30))
    short = by(export.expanded(heads, nodes, history_turns=2), "run_id", "turn")
    assert len(short["a", 9]["history"]) == 2 and short["b", 3]["initial"] == "{}"
