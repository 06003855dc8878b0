"""Queries over paths, archive names, chained turns and rules of a vendor's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.folders import written
from runlore.functions.redaction import alive, redact
from runlore.operators import export, outcomes
from runlore.plans.derived import table, trace_events
from runlore.plans.registry import ORACLES, query
from runlore.sources.rules import vendor_rules

_PATHS = """CASE doc_id % 3 WHEN 0 THEN 'a' || (doc_id % 170) WHEN 1 THEN 'a' || (doc_id % 170) || '/b' || (doc_id % 5) ELSE 'a' || (doc_id % 170) || '/b' || (doc_id % 5) || '/c-' || doc_id END"""


@query(f"""WITH f AS (SELECT DISTINCT doc_id % 2 AS candidate, {_PATHS} AS path FROM documents)
SELECT d.candidate, arg_min(a.path, length(a.path)) AS ancestor, d.path AS descendant FROM f d JOIN f a ON a.candidate = d.candidate AND starts_with(d.path, a.path || '/') GROUP BY d.candidate, d.path""")
def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two candidates with very many files each those that lie under another file."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("candidate"), F.expr(_PATHS).alias("relative_path"))
    return outcomes.path_conflicts(rows, ["candidate"])


@query("""WITH claim AS (
  SELECT source AS run_id, doc_id AS index, 'n' || (doc_id % 7) || '.md' AS name, row_number() OVER (PARTITION BY source, doc_id % 7 ORDER BY doc_id) AS i FROM documents
), taken AS (
  SELECT DISTINCT source AS run_id, 'n' || (doc_id % 7) || '.md' AS name, doc_id % 9 + 1 AS number FROM documents JOIN labels USING (doc_id)
), held AS (SELECT run_id, name, list(number) AS numbers FROM taken GROUP BY ALL), free AS (
  SELECT c.run_id, c.name, list_filter(range(1, max(c.i) + 10), lambda n: NOT list_contains(coalesce(any_value(h.numbers), []), n)) AS numbers FROM claim c LEFT JOIN held h USING (run_id, name) GROUP BY c.run_id, c.name
), given AS (SELECT c.run_id, c.index, c.name, f.numbers[c.i] AS number FROM claim c JOIN free f USING (run_id, name))
SELECT run_id, index, '/p/_archive/S-' || CASE WHEN number > 1 THEN number || '-' ELSE '' END || name AS path FROM given""")
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that are archived, where some names are taken."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    name = F.concat(F.lit("n"), (F.col("doc_id") % 7).cast("string"), F.lit(".md"))
    path = F.concat(F.lit("/p/_archive/S-"), name)
    rows = docs.select(F.col("source").alias("run_id"), F.col("doc_id").alias("index"), F.lit("prune").alias("action"), F.lit("applied").alias("status"), path.alias("path"))
    number = F.when(F.col("doc_id") % 9 > 0, F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("-"))).otherwise("")
    held = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("run_id"), F.concat(F.lit("/p/_archive/S-"), number, name).alias("path"))
    return outcomes.distinct_archives(rows, ["run_id"], "S", held).select("run_id", "index", "path")


@query(ORACLES["sft_turns"])
def sft_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fine-tuning turns, from the chained form."""
    heads, turns = export.sft_chain(trace_events(spark, sf_dir))
    t = export.expanded(written(heads, "heads"), written(turns, "turns"))
    history = F.array_join(F.transform("history", lambda h: F.concat(h["turn"].cast("string"), F.lit(":"), h["output"])), ",")
    return t.select("run_id", "turn", F.substring("output", 2, 20).cast("long").alias("step"), history.alias("history"))


#: Rules in the vendor's shape: gates, one group, several groups, and one rule inside another. Made up for this query.
VENDOR = {
    "rules": [
        {"id": "alpha-any", "regex": r"alpha_[0-9a-f]{8,}", "keywords": ["alpha_"]},
        {"id": "alpha-key", "regex": r"\balpha_([0-9a-f]{12})\b", "keywords": ["alpha_"]},
        {"id": "beta-pair", "regex": r"(beta)-([A-Z0-9]{8})", "keywords": ["Beta"]},
        {"id": "delta-cloud", "regex": r"AKIA[0-9A-Z]{16}", "keywords": ["akia"]},
        {"id": "epsilon-vendor", "regex": r"\b[0-9a-f]{20}\b", "keywords": ["epsilon"]},
        {"id": "gamma-token", "regex": r"gamma=([0-9]{10})\b", "keywords": ["gamma"], "entropy": 3},
    ]
}
_SECRETS = """CASE doc_id % 6 WHEN 0 THEN 'alpha_' || lpad(doc_id::VARCHAR, 12, '0') WHEN 1 THEN 'beta-' || lpad(doc_id::VARCHAR, 8, '0') WHEN 2 THEN 'AKIA' || lpad(doc_id::VARCHAR, 16, '0') WHEN 3 THEN lpad(doc_id::VARCHAR, 20, '0') WHEN 4 THEN 'epsilon ' || lpad(doc_id::VARCHAR, 20, '0') ELSE 'gamma=' || lpad(doc_id::VARCHAR, 10, '0') END"""


def _secret() -> Column:
    i = F.col("doc_id").cast("string")
    padded = lambda head, n: F.concat(F.lit(head), F.lpad(i, n, "0"))
    k = F.col("doc_id") % 6
    return F.when(k == 0, padded("alpha_", 12)).when(k == 1, padded("beta-", 8)).when(k == 2, padded("AKIA", 16)).when(k == 3, padded("", 20)).when(k == 4, padded("epsilon ", 20)).otherwise(padded("gamma=", 10))


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') || ' ' || {_SECRETS} AS text FROM documents), a AS (SELECT doc_id, regexp_replace(text, '\bAKIA[0-9A-Z]{{16}}\b', '[REDACTED:aws_access_key_id]', 'g') AS text FROM t),
b AS (SELECT doc_id, lower(text) AS low, regexp_replace(regexp_replace(text, 'alpha_[0-9a-f]{{8,}}', '[REDACTED:alpha-any]', 'g'), 'beta-[A-Z0-9]{{8}}', '[REDACTED:beta-pair]', 'g') AS text FROM a),
c AS (SELECT doc_id, low, CASE WHEN contains(low, 'epsilon') THEN regexp_replace(text, '\b[0-9a-f]{{20}}\b', '[REDACTED:epsilon-vendor]', 'g') ELSE text END AS text FROM b)
SELECT doc_id, regexp_replace(text, 'gamma=[0-9]{{10}}\b', 'gamma=[REDACTED:gamma-token]', 'g') AS text FROM c""")
def redacted_by_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through the built-in rules and rules of the vendor's shape."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _secret())
    return table(spark, sf_dir, "documents").select("doc_id", redact(text, vendor_rules(VENDOR)).alias("text"))


@query(f"""WITH s AS (SELECT doc_id, (['alpha-key', 'beta-pair', 'delta-cloud', 'epsilon-vendor', 'unknown', 'alpha-any', 'gamma-token'])[doc_id % 7 + 1] AS rule_id, {_SECRETS} AS sample, doc_id % 6 AS k FROM documents),
m AS (SELECT *, CASE rule_id WHEN 'alpha-key' THEN k = 0 WHEN 'alpha-any' THEN k = 0 WHEN 'beta-pair' THEN k = 1 WHEN 'delta-cloud' THEN k = 2 WHEN 'epsilon-vendor' THEN k IN (3, 4) WHEN 'gamma-token' THEN k = 5 ELSE false END AS matches,
  (['alpha-any', 'beta-pair', 'aws_access_key_id', NULL, 'epsilon-vendor', 'gamma-token'])[k + 1] AS found FROM s),
r AS (SELECT *, CASE WHEN matches AND k = 3 THEN 'epsilon-vendor' ELSE found END AS shown FROM m)
SELECT doc_id, rule_id, matches, coalesce(shown = rule_id, false) AS own, CASE WHEN rule_id = 'alpha-key' AND shown = 'alpha-any' OR rule_id = 'delta-cloud' AND shown = 'aws_access_key_id' THEN shown END AS covered_by, matches AS alive FROM r""")
def live_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether rules still redact samples: their own, others' and none; some are covered by a rule that runs earlier."""
    ids = F.array(*(F.lit(x) for x in ("alpha-key", "beta-pair", "delta-cloud", "epsilon-vendor", "unknown", "alpha-any", "gamma-token")))
    samples = table(spark, sf_dir, "documents").select("doc_id", F.get(ids, (F.col("doc_id") % 7).cast("int")).alias("rule_id"), _secret().alias("sample"))
    covers = spark.createDataFrame([("alpha-key", "alpha-any"), ("delta-cloud", "between"), ("between", "aws_access_key_id")], "rule_id string, covered_by string")
    return alive(samples, vendor_rules(VENDOR), covers).select("doc_id", "rule_id", "matches", "own", "covered_by", "alive")
