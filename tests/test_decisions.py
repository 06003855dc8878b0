"""Independence by intervals, nested paths, archive names and live rules, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from runlore.functions.redaction import alive
from runlore.operators import lineage, outcomes
from runlore.sources.rules import vendor_rules


def related(parent, a, b):
    """Whether two nodes of a forest (node to parent) are dependent."""

    def above(x):
        seen = []
        while parent.get(x) is not None and parent[x] not in seen:
            x = parent[x]
            seen.append(x)
        return seen

    return a == b or a in above(b) or b in above(a) or (parent.get(a) is not None and parent.get(a) == parent.get(b))


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_independence_against_brute_force(spark, shape):
    rng = random.Random(shape)
    n = 40 if shape != "chain" else 70
    pick = {"random": lambda i: rng.choice([None, *range(max(0, i - 9), i)]) if i else None, "chain": lambda i: i - 1 if i else None, "star": lambda i: 0 if i else None}[shape]
    parent = {i: pick(i) for i in range(n)}
    parent[n + 1] = n + 50  # its parent has no row
    parent[n + 2] = n + 50
    rows = [("s", i, p) for i, p in parent.items()] + [("t", 1, 0), ("t", 2, None)]
    pairs = list(itertools.product(range(n + 3), repeat=2))
    p = spark.createDataFrame(rows, "k string, id long, parent long").repartition(3)
    ask = spark.createDataFrame([("s", a, b, 1) for a, b in pairs] + [("t", 1, 2, 1), ("t", 1, 0, 1)], "k string, a long, b long, entry int")
    out = lineage.independence(ask, p, ["k"])
    assert out.columns == ["k", "a", "b", "entry", "independent"]
    got = {(r["k"], r["a"], r["b"]): r["independent"] for r in out.collect()}
    wrong = [x for x in pairs if got["s", *x] == related(parent, *x)]
    assert not wrong and got["t", 1, 2] and not got["t", 1, 0]
    placed = [r for r in lineage.intervals(p, ["k"]).collect() if r["k"] == "s"]
    assert sorted(r["entry"] for r in placed) == list(range(len(placed)))  # preorder, without gaps
    counts = {r["k"]: r["n"] for r in lineage.dependent_counts(p, ["k"]).collect()}
    ids = sorted({*parent, n + 50})
    assert counts["s"] == sum(related(parent, a, b) for a, b in itertools.combinations(ids, 2)) and counts["t"] == 1


def test_cycles_and_unknown_ids(spark):
    p = spark.createDataFrame([("s", 1, 2), ("s", 2, 3), ("s", 3, 1), ("s", 4, 1), ("s", 5, None), ("s", 6, 6), ("s", None, 1)], "k string, id long, parent long")
    ask = spark.createDataFrame([("s", 1, 5), ("s", 4, 5), ("s", 5, 6), ("s", 5, 99), ("s", 98, 99)], "k string, a long, b long")
    assert [r["independent"] for r in lineage.independence(ask, p, ["k"]).orderBy("a", "b").collect()] == [False, False, True, True, True]
    assert lineage.independence(ask, p.limit(0), ["k"]).where("independent").count() == 5
    assert lineage.independence(ask.limit(0), p, ["k"]).count() == 0


def test_nested_paths_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["a", "a-b", "b", "a b", "é", "c.md", "ab"]
    paths = {"/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(300)}
    want = set()
    for d in paths:
        above = [a for a in paths if d.startswith(a + "/")]
        if above:
            want.add((min(above, key=len), d))
    rows = spark.createDataFrame([(1, p) for p in paths] + [(1, sorted(paths)[0]), (2, "a"), (2, "b/c"), (2, None)], "c int, relative_path string").repartition(4)
    out = outcomes.path_conflicts(rows, ["c"])
    assert {(r["ancestor"], r["descendant"]) for r in out.collect() if r["c"] == 1} == want and out.where("c = 2").count() == 0
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def brute_archives(claims, held):
    used, out = set(held), {}
    for i, name in sorted(claims):
        n, path = 1, f"/x/T-{name}"
        while path in used:
            n += 1
            path = f"/x/T-{n}-{name}"
        used.add(path)
        out[i] = path
    return out


@pytest.mark.parametrize("names", [["a.md", "b.md"], ["x.md", "2-x.md", "3-2-x.md", "2-2-x.md", "02-x.md"]])
def test_archive_names_against_brute_force(spark, names):
    rng = random.Random(len(names))
    for runs in range(3):
        claims = [(i, rng.choice(names)) for i in range(25)]
        held = {f"/x/T-{rng.choice(['', '2-', '3-', '4-', '7-', '12-'])}{rng.choice(names)}" for _ in range(8)}
        rows = spark.createDataFrame([("r", i, "prune", "applied", f"/x/T-{n}") for i, n in claims] + [("r", 90, "keep", "noop", None), ("r", 91, "promote_to_memory", "applied", "/x/T-a.md")], "run_id string, index int, action string, status string, path string")
        archived = spark.createDataFrame([("r", p) for p in held] + [("other", "/x/T-a.md"), ("r", "/y/T-a.md"), ("r", "/x/U-a.md")], "run_id string, path string")
        got = {r["index"]: r["path"] for r in outcomes.distinct_archives(rows, ["run_id"], "T", archived).collect()}
        assert got.pop(90) is None and got.pop(91) == "/x/T-a.md"
        assert got == brute_archives(claims, held), runs


def test_live_rules(spark):
    rules = vendor_rules({"rules": [{"id": "b", "regex": "bb([0-9]{4})", "keywords": ["bb"]}, {"id": "a", "regex": "bb[0-9]{3,}", "keywords": ["bb"]}, {"id": "c", "regex": "[0-9]{6}x", "keywords": ["cc"]}, {"id": "d", "regex": "never$^", "keywords": []}]})
    samples = [("a", "bb1234"), ("b", "bb1234"), ("c", "123456x"), ("d", "never"), ("e", "x"), ("a", None)]
    covers = lambda *x: spark.createDataFrame([*x, ("z", "z")], "rule_id string, covered_by string")
    df = spark.createDataFrame(samples, "rule_id string, sample string")
    got = {(r["rule_id"], r["sample"]): r for r in alive(df, rules, covers(("b", "q"), ("q", "a"))).collect()}
    assert got["a", "bb1234"]["alive"] and got["a", "bb1234"]["own"]
    assert got["b", "bb1234"]["alive"] and got["b", "bb1234"]["covered_by"] == "a" and not got["b", "bb1234"]["own"]
    assert got["c", "123456x"]["alive"] and not any(got[k]["alive"] for k in (("d", "never"), ("e", "x"), ("a", None)))
    assert not [r["alive"] for r in alive(df.where("rule_id = 'b'"), rules, covers()).collect()][0]
    assert alive(df.limit(0), rules, covers()).count() == 0


def test_outcomes_with_taken_archive_names(spark):
    c = spark.createDataFrame([("r", 0, "prune", "/m/a.md"), ("r", 1, "prune", "/m/a.md")], "run_id string, index int, action string, target string")
    c = c.select("run_id", "index", "action", F.lit(None).cast("string").alias("artifact_id"), F.to_variant_object(F.struct(F.col("target").alias("target_path"))).alias("key_fields"), F.lit(None).cast("string").alias("draft"), F.lit(None).cast("boolean").alias("draft_ok"), F.array().cast("array<struct<relative_path:string,draft:string,draft_ok:boolean>>").alias("extra_files"), F.array().cast("array<string>").alias("problems"), F.lit("claude_code").alias("harness"))
    approvals = spark.createDataFrame([("r", 0, False), ("r", 1, False)], "run_id string, index int, overwrite boolean")
    index = spark.createDataFrame([("r", "/m/a.md", "memory", "project", "A")], "run_id string, path string, kind string, scope string, name string")
    roots = spark.createDataFrame([("r", "/m", None, None)], "run_id string, memory_dir string, global_skills_dir string, project_skills_dir string")
    archived = spark.createDataFrame([("r", "/_archive/T-a.md"), ("r", "/_archive/T-3-a.md")], "run_id string, path string")
    got = {r["index"]: r["path"] for r in outcomes.apply_outcomes(c, approvals, index, roots, "T", archived=archived).collect()}
    assert got == {0: "/_archive/T-2-a.md", 1: "/_archive/T-4-a.md"}
