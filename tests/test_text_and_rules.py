"""Text rules, redaction, front matter, replies, rendering, artifacts and outcomes."""

import random
import re
import time

import pytest
from helpers import by, event, write_lines
from pyspark.sql import functions as F

from runlore.functions import text as T
from runlore.functions.redaction import BUILT_IN, KEPT_AROUND, redact, redact_built_in, replace
from runlore.operators import artifacts, evaluate, lineage, outcomes, render
from runlore.sources import conversations
from runlore.sources.rules import RuleError, operator_rules, vendor_rules

NOTE = "---\nname: My Note\ndescription: d\nmetadata:\n  type: user\n---\nbody\n"
SECRETS = ["AKIA" + "A" * 16, "ghp_" + "b" * 20, "x password = 'hunter222' y", "Authorization: Bearer abcdefgh1=", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "sk-" + "a" * 24, "AIza" + "c" * 35, "nothing here"]


def test_redaction(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SECRETS)] + [(99, None)], "i int, s string")
    out = by(rows.select("i", redact_built_in(F.col("s")).alias("jvm"), redact(F.col("s")).alias("py")), "i")
    assert all(r["jvm"] == r["py"] for r in out.values())
    assert out[2]["py"] == "x password = '[REDACTED:secret_assignment]' y" and out[7]["py"] == "nothing here" and out[99]["py"] is None
    assert all("[REDACTED:" in out[i]["py"] for i in range(7))
    again = rows.select("i", redact(redact(F.col("s"))).alias("py"))
    assert {k: v["py"] for k, v in by(again, "i").items()} == {k: v["py"] for k, v in out.items()}


def test_gates_lose_nothing(spark):
    """Gated rules give what all rules in order give, in the JVM and in Python; the letters that equal ASCII ones count."""
    odd = ["PA\u017f\u017fWORD: abcdefgh", "author\u0130zation: bearer abcdefgh1", "TO\u212aEN", "Acces\u017f_To\u212aen = 'abcdefg'", "api-key=[x]abcdef", "secret: sk-" + "b" * 30, "password=AKIA" + "A" * 16, "", "gh_p", "pk-a" * 9, "-----BEGIN PRIVATE KEY-----password=\n-----END PRIVATE KEY-----=abcdefgh"]
    texts = SECRETS + odd + [a + sep + b for a in SECRETS for b in SECRETS + odd for sep in ("", "\n", "=")]
    patterns = [(re.compile(p), label, KEPT_AROUND.get(label)) for label, p in BUILT_IN]

    def ungated(text):
        for pattern, label, group in patterns:
            text = replace(pattern, label, group, True, text)
        return text

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    out = by(rows.select("i", redact_built_in(F.col("s")).alias("jvm"), redact(F.col("s")).alias("py")), "i")
    assert [(i, out[i]["jvm"], out[i]["py"]) for i in out] == [(i, ungated(texts[i]), ungated(texts[i])) for i in out]


def test_vendor_gate_and_groups(spark):
    rules = vendor_rules({"rules": [{"id": "b-hex", "regex": "(?:x|[a-f0-9]{40})", "keywords": ["SGP_"]}, {"id": "a-key", "regex": r"key=(k[0-9]{4})[;]", "keywords": ["key="]}]})
    assert [r.label for r in rules] == ["a-key", "b-hex"]
    rows = spark.createDataFrame([(0, "key=k1234; " + "a" * 40), (1, "sgp_ " + "a" * 40)], "i int, s string")
    out = by(rows.select("i", redact(F.col("s"), rules).alias("s")), "i")
    assert out[0]["s"] == "key=[REDACTED:a-key]; " + "a" * 40 and out[1]["s"] == "sgp_ [REDACTED:b-hex]"


RULE = {"label": "t", "regex": r"tok-(?P<v>[0-9]+)", "description": "d", "sample": "tok-12"}


@pytest.mark.parametrize("bad", [{"extra": 1}, {"label": "a[b"}, {"regex": "("}, {"sample": "none"}, {"replace_group": "w"}, {"description": ""}, {"regex": "x*"}])
def test_operator_rules_refuse(bad):
    with pytest.raises(RuleError):
        operator_rules([{**RULE, **bad}])
    with pytest.raises(RuleError):
        operator_rules([RULE, RULE])
    assert operator_rules([{**RULE, "replace_group": "v"}])[0].group == "v"


def test_text(spark):
    rows = spark.createDataFrame([(" My_Odd Näme! ", "a/b c--", "a\nb\x0bc\r\nd\n")], "a string, b string, c string")
    r = rows.select(T.slug(F.col("a")).alias("a"), T.run_slug(F.col("b")).alias("b"), T.lines_of(F.col("c")).alias("c"), T.label(F.lit("/etc/x")).alias("d"), T.label(F.lit("x" * 300)).alias("e"), T.elide(F.lit("abcdefghij"), 4).alias("f"), T.basename(F.lit("/a/b/")).alias("g")).first()
    assert r["a"] == "my-odd-nme" and r["b"] == "a-b-c" and r["c"] == "a\nb\x0bc\r\nd\n".splitlines() and r["d"] is None and r["e"] == "x" * 200 + "…"
    assert r["f"] == "ab\n... (6 characters omitted) ...\nij" and r["g"] == "b"


def test_slugs_equal_the_rule(spark):
    """Against the rule in Python: texts of odd characters, any white space, ends of - and ., cuts within runs."""
    pick = random.Random(11)
    odd = [*"aZ09_-.!", *T.WHITE_SPACE, "\x1c", "\x00", "\u00e4", "\u0130", "\u212a", "\u03a3", "\u200b", "\ufeff", "\U0001d400", "  ", "__", "--", "..", " _ "]
    texts = ["", " ", "_", " _ ", " _a_ ", "-.", "x\n", "\n", *("".join(pick.choices(odd, k=pick.randint(1, 30))) for _ in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", T.slug(F.col("s")).alias("slug"), *(T.run_slug(F.col("s"), n).alias(f"r{n}") for n in (3, 7, 120)))
    space = f"[{re.escape(T.WHITE_SPACE)}]"
    assert [chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F] == sorted(T.WHITE_SPACE)
    for i, row in by(rows, "i").items():
        s = texts[i]
        assert row["slug"] == re.sub("[^a-z0-9-]", "", re.sub(f"({space}|_)+", "-", s.strip(T.WHITE_SPACE).lower())), repr(s)
        whole = re.sub("[^A-Za-z0-9._-]+", "-", s).strip("-.")
        assert all(row[f"r{n}"] == whole[:n].rstrip("-.") for n in (3, 7, 120)), repr(s)


def test_slugs_of_long_runs_take_linear_time(spark):
    """A long run of blanks, hyphens or dots within a text was gone through again from each of its characters."""
    for n in (10, 100_000):  # the first is a warm-up
        rows = spark.createDataFrame([("x" + " " * n + "y", "x" + "-." * (n // 2) + "y")], "a string, b string")
        began = time.time()
        r = rows.select(T.slug(F.col("a")).alias("a"), T.run_slug(F.col("b"), 120_000).alias("b")).first()
        took = time.time() - began
        assert r["a"] == "x-y" and r["b"] == "x" + "-." * (n // 2) + "y"
    assert took < 5


def test_slugs_do_not_slow_tasks_beside_them(spark):
    """Slugs cost a few times a plain fold of white space when tasks share a JVM; 20 and more times with classes of ranges and characters."""
    text = F.repeat(F.lit("Some words, of a text; with_marks and 12 numbers\n"), 400)
    rows = spark.range(0, 1600, 1, 4).select(F.concat(F.col("id").cast("string"), text).alias("s")).cache()

    def took(c):
        def once():
            began = time.time()
            rows.select(c.alias("c")).write.format("noop").mode("overwrite").save()
            return time.time() - began

        return min(once() for _ in range(3))

    try:
        rows.count()
        plain = took(F.regexp_replace("s", "(?U)[\\s_]+", "-"))
        assert took(F.concat(T.slug(F.col("s")), T.run_slug(F.col("s"), 40))) < 8 * plain
    finally:
        rows.unpersist()


def test_budgets_equal_the_fold(spark):
    """Against a fold over each corpus: no, many and long entries, those that just fit, and a rest that many could take."""
    pick = random.Random(7)
    corpora = {
        "none over": [5, 0, 100], "long": [70_000] * 6 + [0, 1], "exact": [60_000] * 4 + [0, 1, 0], "rest": [60_000] * 3 + [58_500, 1_501, 700, 1_400, 700, 0, 101, 100, 0, 1, 0],
        "small": [60_000] * 3 + [59_000] + [pick.randint(1, 1_500) for _ in range(400)], "same": [60_000] * 3 + [58_100, 60_001] + [3] * 900, "mixed": [pick.choice([0, 10, 1_999, 2_000, 30_000, 59_999, 61_000]) for _ in range(300)],
    }
    want = {}
    for name, lengths in corpora.items():
        left = 240_000
        for i, n in enumerate(lengths):
            most = min(60_000, left)
            stub = n > most and most < 2_000
            want[name, i] = (i, -1 if stub else most)
            left -= 0 if stub else min(n, most)
    rows = spark.createDataFrame([(c, i * 7, n) for c, ns in corpora.items() for i, n in enumerate(ns)], "corpus string, at long, n int")
    out = evaluate.budgets(rows.repartition(5), ["corpus"], ["at"]).collect()
    assert {(r["corpus"], r["at"] // 7): (r["position"], r["most"]) for r in out} == want and len(out) == len(want)
    assert evaluate.budgets(rows.limit(0), ["corpus"], ["at"]).count() == 0


def test_replies(spark):
    good = '{"scores": {"TF": 11, "TA": -1, "TG": 3, "PA": 4.5}, "notes": "n"}'
    cases = [good, f"```json\n{good}\n```", f"so: {good} ok", good.replace("11", "true"), good.replace("11", "NaN"), good.replace("11", "Infinity"), "none", good.replace('"TF": 11, ', ""), '{"scores": 3}', None, "{bad}"]
    out = by(evaluate.parse_replies(spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, raw string")), "i")
    assert [out[i]["ok"] for i in range(11)] == [True, True, True, False, False, True, False, False, False, False, False]
    assert out[0]["TF"] == 10.0 and out[0]["TA"] == 0.0 and out[5]["TF"] == 10.0 and out[3]["TA"] is None and "NaN" in out[4]["errors"][0]
    card = evaluate.scorecard(evaluate.score_rows(evaluate.parse_replies(spark.createDataFrame([("a", good), ("b", "x")], "run_id string, raw string"))), "m", "v").first()
    assert card["n"] == 2 and card["n_unscored"] == 1 and card["mean_TF"] == 10.0
    stub = evaluate.judged(spark.createDataFrame([("a", "p")], "run_id string, prompt string"))
    assert evaluate.parse_replies(stub).first()["TG"] == 5.0


def test_prompts(spark):
    texts = spark.createDataFrame([("c", i, "x" * n) for i, n in enumerate([70_000, 60_000, 60_000, 59_000, 3_000, 500])], "corpus string, transcript_index int, text string")
    shown = evaluate.excerpts(texts, ["corpus"])
    body = shown.first()["excerpts"]
    assert "--- transcript 4 (elided: 3000 chars) ---" in body and "--- transcript 5 ---\n" + "x" * 500 in body and "(10000 characters omitted)" in body
    plans = spark.createDataFrame([("r", "c", "plan"), ("s", "d", "plan")], "run_id string, corpus string, plan_text string")
    tasks = spark.createDataFrame([("r", " truth ")], "id string, reference string")
    out = by(evaluate.prompts(plans, shown, ["corpus"], tasks), "run_id")
    assert "=== EXPECTED PLAN" in out["r"]["prompt"] and "(none supplied)" in out["s"]["prompt"] and "=== EXPECTED PLAN" not in out["s"]["prompt"]


def test_conversations(spark, tmp_path):
    p = tmp_path / "projects" / "-home-me"
    msg = lambda role, content, **m: {"type": role, "message": {"role": role, "content": content}, **m}
    blocks = [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Run"}, {"type": "tool_result", "content": "abc"}, {"type": "tool_result", "content": [1, 2]}, {"type": "tool_result"}, {"type": "odd"}, 3, "s", None, True, {"type": "thinking", "thinking": ""}]
    write_lines(p, "s1.jsonl", [msg("user", "hello"), "", '{"torn', msg("assistant", blocks), msg("user", "side", isSidechain=True), {"type": "summary"}, msg("user", "  ")])
    write_lines(p, "s2.jsonl", [{"type": "x"}])
    write_lines(p / "s1" / "subagents", "agent-a1.jsonl", [msg("user", "task", isSidechain=True)])
    write_lines(p / "s1" / "subagents" / "workflows" / "w1", "agent-a2.jsonl", [msg("user", "deep", isSidechain=True)])
    write_lines(p / "s1" / "subagents", "agent-a3.jsonl", ["x"])
    write_lines(p / "s1" / "subagents", "journal.jsonl", [msg("user", "no")])
    write_lines(p / "gone" / "subagents", "agent-z.jsonl", [msg("user", "no", isSidechain=True)])
    write_lines(p / "s1" / "subagents", "agent-a1.meta.json", ['{"agentType": "worker", "spawnDepth": 1, "description": 7}'])
    plain = by(conversations.corpora(spark, f"file://{tmp_path}/projects"), "session")
    want = "user: hello\nassistant: hi\n[used tool: Run]\n[tool result: 3 chars]\n[tool result: 2 blocks]\n[tool result: unrecognized content shape]\n[unrecognized content block: odd]\n[unrecognized content block: int]\n[unrecognized content block: str]\n[unrecognized content block: NoneType]\n[unrecognized content block: bool]"
    assert plain["s1"]["text"] == want and plain["s2"]["text"] == "" and plain["s1"]["transcript_index"] == 0
    full = conversations.corpora(spark, f"file://{tmp_path}/projects", include_subagents=True).orderBy("transcript_index").collect()
    assert [(r["kind"], r["id"], r["parent"]) for r in full] == [("session", "s1", ""), ("subagent", "a1", "session:s1"), ("subagent", "a2", "workflow:w1"), ("session", "s2", "")]
    assert full[1]["text"].startswith("[1] subagent a1 parent=session:s1 type=worker depth=1\nsession=s1 agent=a1 subpath=subagents/agent-a1\ntask: (not recorded)\nuser: task")


def test_rollouts(spark, tmp_path):
    item = lambda p: {"type": "response_item", "payload": p}
    d = tmp_path / "sessions" / "2024"
    write_lines(d, "rollout-a.jsonl", ["", {"type": "session_meta", "payload": {"cwd": "/p"}}, item({"type": "message", "role": "user", "content": [{"type": "input_text", "text": "a"}, {"type": "output_text", "text": "b"}, {"type": "x", "text": "c"}]}), item({"type": "function_call", "name": "go"}), item({"type": "local_shell_call"}), item({"type": "reasoning"})])
    write_lines(d, "rollout-b.jsonl", [{"type": "session_meta", "payload": 3}, {"type": "session_meta", "payload": {"cwd": "/p"}}])
    out = conversations.rollouts(spark, f"file://{tmp_path}/sessions").collect()
    assert sorted((r["cwd"] or "", r["text"]) for r in out) == [("", ""), ("/p", "user: ab\n[used tool: go]\n[used tool: local_shell_call]")]
    assert conversations.rollouts(spark, f"file://{tmp_path}/sessions", spark.createDataFrame([("/p",)], "cwd string")).count() == 1


def test_artifact_checks(spark):
    files = spark.createDataFrame([("/m/memory/a.md", None, NOTE), ("/m/memory/MEMORY.md", None, "x"), ("/g/tool/SKILL.md", "global", "plain"), ("/x/y.txt", None, "")], "path string, scope string, text string")
    index = artifacts.artifact_index(files).withColumn("c", F.lit("c"))
    assert {(r["kind"], r["scope"], r["name"]) for r in index.collect()} == {("memory", "project", "My Note"), ("index", "project", "MEMORY.md"), ("skill", "global", "tool")}
    drafts = spark.createDataFrame([(0, "c", NOTE, "user"), (1, "c", NOTE.replace("My Note", "New"), "project"), (2, "c", " ", None), (3, "c", "plain", None), (4, "c", NOTE.replace("My Note", "New"), None)], "i int, c string, text string, requested_type string")
    out = by(artifacts.check_memory_drafts(drafts, index, ["c"]), "i")
    assert [len(out[i]["errors"]) for i in range(5)] == [1, 1, 1, 1, 0]
    skills = spark.createDataFrame([(0, "c", "---\nname: Tool\ndescription: d\n---\nb", "project"), (1, "c", "---\nname: Tool\ndescription: d\n---\nb", "global"), (2, "c", "---\nname: Tool\ndescription: d\n---\nb", "odd")], "i int, c string, text string, requested_scope string")
    said = by(artifacts.check_skill_drafts(skills, index, ["c"]), "i")
    assert "GLOBAL" in said[0]["errors"][0] and "in the global scope" in said[1]["errors"][0] and len(said[2]["errors"]) == 2
    extra = spark.createDataFrame([(0, "reference", "references/a.md", "x"), (1, "reference", "scripts/a.sh", ""), (2, None, None, "x")], "i int, kind string, relative_path string, text string")
    assert [len(by(artifacts.check_extra_drafts(extra), "i")[i]["errors"]) for i in range(3)] == [0, 3, 1]


def test_outcomes(spark):
    skill = "---\nname: Helper\ndescription: d\n---\nb"
    schema = "run_id string, index int, action string, draft string, draft_ok boolean, scope string, target_path string, files string, problems array<string>, harness string"
    rows = [
        ("r", 0, "keep", None, None, None, None, "", [], "h"), ("r", 1, "promote_to_skill", skill, True, "global", None, "", [], None), ("r", 2, "promote_to_skill", skill, True, "project", None, "", [], None), ("r", 3, "prune", None, None, None, "/m/a.md", "", [], None),
        ("r", 4, "prune", None, None, None, "/m/none.md", "", [], None), ("r", 5, "promote_to_memory", NOTE, True, None, None, "", [], None), ("r", 6, "promote_to_memory", NOTE, False, None, None, "", [], None), ("r", 7, "promote_to_skill", skill.replace("Helper", "H2"), True, "project", None, "scripts/u,scripts/u/v", [], None),
        ("r", 8, "promote_to_skill", skill.replace("Helper", "H3"), True, "project", None, "../x", [], None), ("r", 9, "promote_to_memory", NOTE.replace("My Note", "z" * 200), True, None, None, "", [], None), ("r", 10, "prune", None, None, None, "/m/a.md", "", [], "other"), ("r", 11, "keep", None, None, None, None, "", [], None), ("r", 12, "prune", None, None, None, "/m/sub/a.md", "", [], None),
    ]
    c = spark.createDataFrame(rows, schema)
    files = F.transform(F.filter(F.split("files", ","), lambda x: x != ""), lambda x: F.struct(x.alias("relative_path"), F.lit("t").alias("draft"), F.lit(True).alias("draft_ok")))
    c = c.withColumn("key_fields", F.to_variant_object(F.struct("scope", "target_path"))).withColumn("extra_files", files).withColumn("artifact_id", F.lit(None).cast("string"))
    approvals = spark.createDataFrame([("r", i, False) for i in range(13) if i != 11], "run_id string, index int, overwrite boolean")
    index = spark.createDataFrame([("r", "/m/a.md", "memory", "project", "A"), ("r", "/m/sub/a.md", "memory", "project", "A")], "run_id string, path string, kind string, scope string, name string")
    roots = spark.createDataFrame([("r", "/m", "/g", "/p")], "run_id string, memory_dir string, global_skills_dir string, project_skills_dir string")
    out = by(outcomes.apply_outcomes(c, approvals, index, roots, "T"), "index")
    assert [out[i]["status"] for i in range(13)] == ["noop", "applied", "refused", "applied", "refused", "applied", "refused", "refused", "refused", "refused", "refused", "skipped", "applied"]
    assert out[1]["path"] == "/g/helper/SKILL.md" and "a global skill" in out[2]["reason"] and out[5]["path"] == "/m/my-note.md" and "conflict" in out[7]["reason"] and "over 120" in out[9]["reason"]
    assert {out[3]["path"], out[12]["path"]} == {"/_archive/T-a.md", "/_archive/T-2-a.md"}
    with pytest.raises(ValueError):
        outcomes.apply_outcomes(c, spark.createDataFrame([("r", 77, False)], "run_id string, index int, overwrite boolean"), index, roots, "T")


def test_lineage(spark):
    p = spark.createDataFrame([("s", "b", "a"), ("s", "c", "b"), ("s", "d", "b"), ("s", "e", None), ("s", "x", "y"), ("s", "y", "x")], "k string, id string, parent string")
    ask = spark.createDataFrame([("s", "a", "c"), ("s", "d", "c"), ("s", "e", "a"), ("t", "a", "c")], "k string, a string, b string")
    assert [r["independent"] for r in lineage.independence(ask, p, ["k"]).orderBy("k", "a").collect()] == [False, False, True, True]


def test_windows(spark):
    t = spark.createDataFrame([("c", 0, "0123456789"), ("c", 1, "")], "corpus string, transcript_index int, text string")
    ask = spark.createDataFrame([(0, "c", 0, 2, 3), (1, "c", 0, 10, 1), (2, "c", 2, 0, 1), (3, "c", 0, -1, 1), (4, "d", 0, 0, 1), (5, "c", None, 0, 1), (6, "c", 0, None, None)], "i int, corpus string, transcript_index int, offset int, limit int")
    out = by(render.read_windows(ask, t, ["corpus"]), "i")
    assert out[0]["text"] == "234" and out[6]["text"] == "0123456789" and [bool(out[i]["note"]) for i in range(6)] == [False, True, True, True, True, True]
    assert "no transcripts" in out[4]["note"] and out[1]["total_length"] == 10


def test_streams(spark, tmp_path):
    from runlore.streaming import feeds

    write_lines(tmp_path / "in", "a.jsonl", [event("r", 0, "main_step", {"turn": 0, "reasoning": "x"}), event("r", 0, "main_step", {"turn": 0, "reasoning": "x"}), event("r", 1, "main_step", {"turn": 1, "reasoning": "x"}), event("r", 2, "main_step", {"turn": 2, "reasoning": "y"}), "{torn", event("r", 3, "run_end")])
    stream = lambda: feeds.trace_stream(spark, f"file://{tmp_path}/in")
    got = feeds.merged_metrics(feeds.upserted(feeds.live_metrics(stream()), "m1", ["run_id", "part"])).collect()
    assert [(r["run_id"], r["steps"]) for r in got] == [("r", 3)]
    assert [r["event"] for r in feeds.drained(feeds.live_feed(stream()), "m2").collect()][-1] == "distill.run.completed"
    turns = stream().where("type = 'main_step'").selectExpr("run_id", "step_key", "event_time", "try_variant_get(payload, '$.reasoning', 'string') reasoning")
    assert [(r["step_key"], r["reasoning"]) for r in feeds.drained(feeds.without_repeats(turns), "m3").orderBy("step_key").collect()] == [(0, "x"), (2, "y")]
    life = feeds.merged_lifecycle(feeds.upserted(feeds.run_lifecycle(stream()), "m4", ["run_id", "started"]))
    assert [(r["run_id"], r["events"], r["state"], r["event"]) for r in life.collect()] == [("r", 5, "open", None)]


def test_files(spark, tmp_path):
    from runlore.sources.files import read_artifacts, read_taskset

    for path, text in (("memory/b.md", NOTE), ("memory/MEMORY.md", "i"), ("skills/s1/SKILL.md", "---\nname: S\ndescription: d\n---\n")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    index = read_artifacts(spark, f"file://{tmp_path}/memory", f"file://{tmp_path}/skills")
    assert [(r["kind"], r["scope"], r["name"]) for r in index.orderBy("position").collect()] == [("memory", "project", "My Note"), ("index", "project", "MEMORY.md"), ("skill", "global", "S")]
    lines = render.index_lines(index.withColumn("c", F.lit(1)), ["c"]).first()["text"].split("\n")
    assert len(lines) == 3 and lines[0].startswith("- [memory] My Note: d (file:") and lines[1].startswith("- [index] MEMORY.md: The memory index this harness maintains over the memory files. (")
    good = write_lines(tmp_path, "t.json", ['{"tasks": [{"id": "a", "reference": "x"}, {"id": "b", "project": {}}]}'])
    assert [tuple(r) for r in read_taskset(spark, good).select("id", "reference").orderBy("id").collect()] == [("a", "x"), ("b", "")]
    for bad in ('[{"id": "a"}, {"id": "a"}]', '[{"id": ""}]', '[{"id": "a", "project": 3}]', '{"x": 1}'):
        with pytest.raises(Exception, match="task"):
            read_taskset(spark, write_lines(tmp_path, "bad.json", [bad])).collect()


def test_workflows(spark, tmp_path):
    from runlore.plans import workflows
    from runlore.sources.traces import read_traces

    msg = {"type": "user", "message": {"role": "user", "content": "key AKIA" + "Z" * 16}}
    write_lines(tmp_path / "projects" / "p", "s.jsonl", [msg])
    text = workflows.redacted_corpus(spark, f"file://{tmp_path}/projects").first()["text"]
    assert text == "[0] session s\nsession=s\nuser: key [REDACTED:aws_access_key_id]"
    events = read_traces(spark, write_lines(tmp_path / "t", "a.jsonl", [event("r", 0, "run_start", {"meta": {"project_dir": "/a/b", "transcripts": 1}}), event("r", 1, "result", {"output": {}})]))
    shown = workflows.run_payload(events).first()
    assert shown["project"] == "b" and shown["plan"] == "(this run's plan proposed no candidates)"
    texts = spark.createDataFrame([("c", 0, "t")], "corpus string, transcript_index int, text string")
    assert workflows.score_runs(events, texts, "c").first()["TF"] == 5.0
    with pytest.raises(ValueError):
        workflows.score_runs(events, texts.withColumn("text", F.lit(" ")), "c")
    assert workflows.redacted_instructions(spark.createDataFrame([("",), ("sk-" + "a" * 24,)], "text string")).orderBy("text").collect()[1]["text"] == "[REDACTED:api_key]"


def test_drained_streams_are_files(spark, tmp_path):
    from runlore.streaming import feeds

    spark.range(10).write.parquet(f"file://{tmp_path}/a")
    stream = lambda: spark.readStream.schema("id long").parquet(f"file://{tmp_path}/a")
    out = feeds.drained(stream(), "files")
    assert out.count() == 10 and len(out.inputFiles()) > 0 and not spark.catalog.tableExists("files")
    assert out.count() == 10
