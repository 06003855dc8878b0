"""The registered queries of the subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.llm import bpe, conversation_trie, decontamination, fill_in_middle, line_dedup, quality_model, quality_rules, sharding, simhash, substring_dedup, token_files, url_filter, warc
from runlore.llm.common import table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that stays; spans as start:size of the original, in order, and who keeps them."""
    out = substring_dedup.dedup_passages(table(spark, sf_dir, "documents"))
    spans = F.coalesce(F.array_join(F.transform("removed_spans", lambda x: F.concat_ws(":", x["start"], x["size"])), ","), F.lit(""))
    keepers = F.coalesce(F.array_join(F.transform("removed_spans", lambda x: x["keeper"].cast("string")), ","), F.lit(""))
    return out.select("doc_id", "text", "n_chars", F.coalesce(F.size("removed_spans"), F.lit(0)).cast("long").alias("n_removed"), "removed_words", spans.alias("spans"), keepers.alias("keepers"), F.col("removed_spans").isNotNull().alias("changed"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it overlaps; spans as first word:end."""
    out = decontamination.overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.array_distinct(F.transform("overlaps", lambda x: x["item_id"]))).cast("array<string>"), ",")
    spans = F.array_join(F.transform(F.array_sort(F.transform("overlaps", lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b")))), lambda x: F.concat_ws(":", x["a"], x["b"])), ",")
    return out.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.size("overlaps").cast("long").alias("n_overlaps"), F.coalesce(F.array_max(F.transform("overlaps", lambda x: x["matched"])), F.lit(0)).cast("long").alias("longest"), items.alias("items"), spans.alias("spans"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = token_files.fresh_dir(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), out_dir, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, out_dir).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = warc.fresh_dir(spark)
    warc.write_bundles(table(spark, sf_dir, "pages"), out_dir)
    return warc.read_bundles(spark, out_dir, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_distance=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=10, min_docs=2)
    return out.select("doc_id", "n_lines", F.size("dropped_lines").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, rate=50, spm_rate=80)
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"), lambda turns: conversation_trie.rebuilt(turns, block=5, most=9))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_substring_dedup, op2_url_filter, op3_decontamination, op4_token_files, op5_warc, op6_simhash, op7_sharding, op8_quality_rules, op9_bpe, op10_quality_model, op11_line_dedup, op12_fill_in_middle, op13_conversation_trie, pipeline]
    return {f.__name__: f for f in own}


ORACLES = {
    "op1_substring_dedup": r"""
WITH piece AS (
  SELECT doc_id, text, n_chars, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS pieces,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), start AS (
  SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS pos FROM piece WHERE len(words) >= 50
), unit AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos + 1:pos + 50], ' ')) AS unit FROM start
), ranked AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY unit) AS keeper FROM unit
), later AS (
  SELECT *, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50, -1) AS new FROM ranked WHERE keeper < doc_id
), ranged AS (
  SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM later
), gone AS (
  SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b, arg_min(keeper, pos) AS keeper FROM ranged GROUP BY doc_id, no
), length AS (
  SELECT doc_id, list_transform(pieces, lambda x: length(x)) AS sizes, length(text) - coalesce(list_sum(list_transform(pieces, lambda x: length(x))), 0) AS lead FROM piece
), span AS (
  SELECT g.*, (lead + coalesce(list_sum(sizes[1:a]), 0))::BIGINT AS start, list_sum(sizes[a + 1:b])::BIGINT AS size FROM gone g JOIN length USING (doc_id)
), spans AS (
  SELECT doc_id, count(*) AS n, sum(b - a) AS words, string_agg(start || ':' || size, ',' ORDER BY a) AS spans, string_agg(keeper::VARCHAR, ',' ORDER BY a) AS keepers FROM span GROUP BY doc_id
), placed AS (
  SELECT doc_id, unnest(pieces) AS piece, unnest(range(0, len(pieces))) AS pos FROM piece SEMI JOIN spans USING (doc_id)
), kept AS (
  SELECT p.doc_id, string_agg(piece, '' ORDER BY pos) AS text FROM placed p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND p.pos >= a AND p.pos < b) GROUP BY p.doc_id
), final AS (
  SELECT p.doc_id, p.n_chars, CASE WHEN n IS NULL THEN p.text ELSE p.text[1:lead] || coalesce(k.text, '') END AS text, s.* EXCLUDE (doc_id)
  FROM piece p JOIN length l USING (doc_id) LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id)
)
SELECT doc_id, text, CASE WHEN n IS NULL THEN n_chars ELSE length(text) END::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS n_removed, coalesce(words, 0)::BIGINT AS removed_words, coalesce(spans, '') AS spans, coalesce(keepers, '') AS keepers, n IS NOT NULL AS changed FROM final""",
    "op11_line_dedup": r"""
WITH line AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM line
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each
), common AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.*, coalesce(k.doc_id <> c.first, false) AS gone FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op12_fill_in_middle": r"""
WITH token AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, sha256('42:' || doc_id) AS hex FROM documents
), drawn AS (
  SELECT *, len(tokens) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || hex[i:i + 7])::BIGINT) AS h FROM token
), formed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT *, coalesce(array_to_string(tokens[1:a], ''), '') AS p, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS m, coalesce(array_to_string(tokens[b + 1:], ''), '') AS s FROM formed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut""",
    "op13_conversation_trie": r"""
WITH own AS (
  SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), drawn AS (
  -- crc32 bit by bit: a byte, then seven zeros, for each digit of the id
  SELECT *, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END), 4294967295) % 9 AS h FROM own
), rebuilt AS (
  SELECT d.conv_id, list_concat(coalesce(o.turns[1:h], []), d.turns[h + 1:]) AS turns FROM drawn d LEFT JOIN own o ON o.conv_id = d.base
), prefix AS (
  SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt
), member AS (
  SELECT conv_id, depth, sha256(turns[1:depth]::VARCHAR || '/' || depth) AS node, CASE WHEN depth > 0 THEN sha256(turns[1:depth - 1]::VARCHAR || '/' || (depth - 1)) END AS above,
    CASE WHEN depth > 0 THEN strlen(turns[depth][2]) ELSE 0 END AS bytes, len(turns) = depth AS ends
  FROM prefix
), node AS (
  SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(above) AS above, any_value(bytes) AS bytes, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY node
), child AS (
  SELECT above AS node, count(*) AS n_children FROM node GROUP BY above
), full_node AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, p.conv_id AS parent_conv_id FROM node n LEFT JOIN child c USING (node) LEFT JOIN node p ON p.node = n.above
), below AS (
  -- a node's ancestors and itself are the prefixes of its least member up to its depth
  SELECT m.node, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
  FROM full_node f JOIN member m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY m.node
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM full_node JOIN below USING (node)""",
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if v}
