"""Reading traces, assembling plans and the labels from them."""

import json

import pytest
from helpers import by, event, write_lines

from runlore.operators import export, labels, runs, timeline
from runlore.sources.traces import read_traces, runs_found


def draft(tool, artifact, **more):
    return {"tool": tool, "args": {}, "ok": True, "artifact_id": artifact, "draft": "text", "errors": [], **more}


def full_run(run="r1"):
    return [
        event(run, 0, "run_start", {"meta": {"transcripts": 2, "max_iterations": 2, "project_dir": "/home/me/proj", "harness": "claude_code"}}),
        event(run, 1, "tool_call", {"tool": "read_transcript_chunk", "ok": True, "args": {"transcript_index": 0}}),
        event(run, 2, "tool_call", {"tool": "read_transcript_chunk", "ok": True, "args": {"transcript_index": True}}),
        event(run, 3, "tool_call", draft("draft_memory_file", "a1", ok=False, errors=["bad"])),
        event(run, 4, "tool_call", draft("draft_memory_file", "a1")),
        event(run, 5, "tool_call", draft("draft_skill_file", "a2")),
        event(run, 6, "tool_call", {**draft("draft_skill_extra_file", "a2"), "relative_path": "references/x.md"}),
        event(run, 7, "tool_call", {**draft("draft_skill_extra_file", "a2", ok=False, errors=["no"]), "relative_path": "scripts/y.sh"}),
        event(run, 8, "tool_call", {**draft("draft_skill_extra_file", "a2"), "relative_path": "scripts/y.sh"}),
        event(run, 9, "main_step", {"turn": 0, "reasoning": "r", "code": "c", "output": "o"}),
        event(run, 10, "main_step", {"turn": 1, "reasoning": "r", "code": "", "output": "o"}),
        event(run, 11, "result", {"output": {"candidates": [
            {"action": "keep"}, {"action": "prune", "key_fields": {"target_path": "m/x.md"}}, {"action": "prune"}, {"action": "promote_to_memory", "artifact_id": "a1"},
            {"action": "promote_to_skill", "artifact_id": "a2", "key_fields": {"scope": "project"}}, {"action": "promote_to_memory", "artifact_id": "a2"}, {"action": "promote_to_skill", "artifact_id": "zz", "key_fields": {}}, {"action": "keep", "artifact_id": "a1"}]}}),
        event(run, 12, "run_end", {"ok": True}),
    ]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("traces")
    odd = [event("r2", 0, "run_start", {"meta": "nope"}), "42", "null", '"x"', "[1,2,3]", "", event("r2", 1, "tool_call", "text"), event("r2", 2, "result", {"output": {"candidates": [{"action": "sing"}]}}), event("r3", 0, "main_step")]
    invalid = [event("r4", 0, "result", {"output": {"candidates": []}}), event("r4", 1, "result", {"output": [1]}), '{"run_id": "r4", "run_id": "r4", "type": "sub_call", "ts": NaN, "payload": {"a": 1, "a": 2}}']
    write_lines(d, "a.jsonl", full_run())
    write_lines(d, "b.jsonl", odd + invalid)
    return read_traces(spark, f"file://{d}")


def test_shapes_are_normalised(events):
    rows = events.where("run_id = 'r2'").orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == [0, 6, 7] and rows[1]["payload"].toJson() == "{}"
    assert [tuple(r)[1] for r in runs_found(events).collect()] == ["r1", "r2", "r3", "r4"]
    assert events.where("run_id = 'r4'").count() == 3  # repeated keys and NaN are read as Python reads them


def test_torn_lines(spark, tmp_path):
    path = write_lines(tmp_path, "t.jsonl", [event("r", 0, "final"), '{"type": "fin'])
    with pytest.raises(Exception, match="torn JSON"):
        read_traces(spark, path).collect()
    assert read_traces(spark, path, on_torn="skip").count() == 1


def test_assembled(events):
    got = by(runs.assembled(events), "run_id", "index")
    problems = [got["r1", i]["problems"] for i in range(8)]
    assert problems[0] == problems[1] == problems[3] == problems[4] == []
    assert problems[2][0].startswith("action 'prune' carries no usable")
    assert problems[5] == ["artifact_id 'a2' was drafted by draft_skill_file but the candidate's action 'promote_to_memory' expects draft_memory_file"]
    assert problems[6] == ["no draft_skill_file tool_call for artifact_id 'zz' (the plan names an artifact this run never drafted)"]
    assert problems[7] == ["action 'keep' carries artifact_id 'a1', but only ['promote_to_memory', 'promote_to_skill'] draft an artifact"]
    assert [x["relative_path"] for x in got["r1", 4]["extra_files"]] == ["references/x.md", "scripts/y.sh"]
    assert got["r1", 3]["draft_ok"] is True and len([k for k in got if k[0] == "r4"]) == 0


def test_labels_and_metrics(events):
    lab, met, fac = by(labels.run_labels(events), "run_id"), by(labels.run_metrics(events), "run_id"), by(labels.trace_facts(events), "run_id")
    assert set(lab) == set(met) == set(fac) == {"r1", "r2", "r3", "r4"}
    assert lab["r1"]["finalized"] and lab["r1"]["n_candidates"] == 8 and lab["r1"]["n_unbacked"] == 4 and lab["r1"]["n_draft_not_ok"] == 2
    assert lab["r2"] == {"run_id": "r2", "finalized": False, "n_candidates": 0, "n_keep": 0, "n_prune": 0, "n_promote_memory": 0, "n_promote_skill": 0, "n_unbacked": 0, "n_draft_not_ok": 0, "plan_problems": ["no plan was produced by this run"]}
    assert lab["r4"]["finalized"] and lab["r4"]["n_candidates"] == 0
    m = met["r1"]
    assert (m["steps"], m["draft_memory_file_calls"], m["draft_not_ok"], m["draft_validator_rejects"], m["elapsed_s"], m["hit_iteration_cap"]) == (2, 2, 1, 1, 12.0, True)
    assert met["r3"]["elapsed_s"] is None
    f = fac["r1"]
    assert (f["n_transcripts"], f["n_transcripts_read"], f["min_read_step"], f["min_draft_step"], f["n_bad_skill_scope"], f["prune_targets_named"]) == (2, 1, 1, 3, 1, 1)
    seen = by(labels.criteria_facts(events), "run_id", "category")
    assert len(seen) == 16 and json.loads(seen["r2", "TF"]["observed"])["plan_problems"] == ["no plan was produced by this run"]


CAUSES = [
    ({"ok": True}, "ok"), ({"ok": False}, "invalid"), ({}, "invalid"), ({"ok": True, "cause": "endpoint"}, "endpoint"), ({"ok": True, "cause": "else"}, "ok"), ({"circuit_broken": True, "endpoint_error": ""}, "circuit_broken"),
    ({"endpoint_error": ""}, "endpoint"), ({"endpoint_error": None, "ok": True}, "ok"), ({"error": "x", "ok": True}, "endpoint"), ({"ok": "no"}, "ok"),
]


def test_draft_causes(spark, tmp_path):
    path = write_lines(tmp_path, "c.jsonl", [event("r", i, "tool_call", p) for i, (p, _) in enumerate(CAUSES)])
    from pyspark.sql import functions as F

    rows = read_traces(spark, path).select("line_no", runs.draft_cause(F.col("payload")).alias("cause")).orderBy("line_no").collect()
    assert [r["cause"] for r in rows] == [c for _, c in CAUSES]


def test_timeline(spark, tmp_path):
    live = [event("l", 0, "run_start", {"meta": {}}, 0.0), event("l", 5, "main_step", {"turn": 0}, 1.0), event("l", 6, "main_step", {"turn": 1}, 4.5), event("l", 1, "tool_call", {"tool": "list_memory_files", "count": 3}, 0.5), event("l", 2, "tool_call", {"tool": "odd"}, 2.0), event("l", "x", "sub_call", {"model": "m"}, 5.0), event("l", 9, "result", {}, 6.0)]
    fast = [{**e, "run_id": "f", "ts": e["ts"] / 1000} for e in live]
    events = read_traces(spark, write_lines(tmp_path, "t.jsonl", live + fast))
    t, turns = by(timeline.timeline(events), "run_id", "seq"), by(timeline.turns(events), "run_id", "index")
    assert [(t["l", i]["rel_s"], t["l", i]["duration_s"], t["l", i]["turn_index"]) for i in range(3)] == [(0.5, 0.5, 0), (2.0, 1.5, 0), (5.0, 3.0, 1)]
    assert t["l", 1]["fields"] == '{"unrecognized":true}' and t["f", 0]["turn_index"] is None
    assert [(turns["l", i]["rel_s"], turns["l", i]["duration_s"]) for i in range(2)] == [(1.0, 3.5), (4.5, 1.5)] and turns["f", 0]["rel_s"] is None
    feed = [r["event"] for r in timeline.replay_feed(events).where("run_id = 'l'").orderBy("seq").collect()]
    assert feed == ["distill.run.created", "distill.evidence.read", "distill.plan.step", "distill.plan.step", "distill.plan.done", "distill.sub_lm.call", "distill.run.completed"]


def test_bundle(events, spark, tmp_path):
    b = export.bundle(events)
    assert set(b) == {"actions", "drafting", "orchestrator_tools", "planner", "sft_turns", "labels", "metrics", "rubric_signal"}
    tools = b["actions"].where("kind = 'tool'")
    assert tools.count() - b["drafting"].count() - b["orchestrator_tools"].count() == 4  # supplementary files and a call without a tool
    assert b["actions"].where("reward is not null").count() == 0 and not b["drafting"].exceptAll(b["actions"]).count()
    turns = b["sft_turns"].where("run_id = 'r1'").orderBy("turn").collect()
    assert [len(t["history"]) for t in turns] == [0, 1] and json.loads(turns[0]["initial"])["transcripts"] == 2
    with pytest.raises(ValueError):
        export.bundle(events.limit(0))
    out = f"file://{tmp_path}/bundle"
    export.write_bundle(events, out)
    assert export.read_bundle(spark, out)["labels"].count() == 4
    assert by(export.summary(events), "runs")[4]["turns"] == 3
