"""Quality rules with risk-controlled thresholds (operator 8), in DataFrame functions alone.

Each rule rejects documents whose statistic is above a cutoff. Cutoffs are chosen by stratum (language) on labelled
holdouts: for every rule and candidate, the number of good documents that it would reject is tested by the exact binomial
tail against the rule's share of the allowed false rejections, at a level divided by the number of all tests. The lowest
cutoff that passes is used, and none if none passes. So with probability 1 - delta at least, every stratum loses no more
than alpha of its good documents to the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.llm.common import written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rules and their candidate cutoffs: shares in hundredths, and mean code points of a word in tenths.
RULES = {
    "symbol_share": [0.5, 1, 2, 3, 5, 8, 12, 20, 30],
    "same_line_share": [5, 10, 20, 30, 50],
    "repeat_share": [2, 5, 10, 15],
    "shout_share": [1, 2, 3, 5, 8, 12, 20],
    "capital_share": [10, 20, 30, 40, 60, 80],
    "word_length": [60, 70, 80, 100, 150],
}


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with text_, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, capitals, letters, shouts."""
    out = docs.withColumn("text_", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("words_", F.filter(F.split("text_", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    out = out.withColumn("lines_", F.filter(F.split("text_", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    out = out.withColumn("n_words", F.size("words_").cast("long"))
    # Windows as hashes; a text where all differ, as most do, has no repeats and needs no sort.
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words_") - 4)), lambda i: F.xxhash64(F.slice("words_", i, 5)))
    out = out.withColumn("windows_", F.when(F.col("n_words") >= 5, hashes).otherwise(F.array().cast("array<long>")))
    ordered = F.array_sort(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size("windows_") > F.size(F.array_distinct("windows_"))
    out = out.withColumn("sorted_", F.when(repeats, ordered))
    same = lambda a, b: F.get("sorted_", a)["h"].eqNullSafe(F.get("sorted_", b)["h"])
    found = F.array_sort(F.transform(F.filter("sorted_", lambda x, j: same(j, j + 1) | same(j, j - 1)), lambda x: x["i"]))
    out = out.withColumn("found_", found)
    # Each window adds the words that the next one does not cover again.
    gaps = F.transform("found_", lambda x, j: F.least(F.lit(5), F.coalesce(F.get("found_", j + 1) - x, F.lit(5))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0))
    count = lambda chars: (F.length("text_") - F.length(F.translate("text_", chars, ""))).cast("long")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return out.select(
        *docs.columns, "n_words", F.length(F.translate("text_", SPACES, "")).cast("long").alias("word_chars"), count(SYMBOLS).alias("n_symbols"), F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), count(upper).alias("capitals"), count(upper + lower).alias("letters"), count("!").alias("shouts"),
    )


def rule_values() -> dict[str, Column]:
    """What each rule compares with its cutoffs; null (never rejected) where there is nothing to divide by."""
    share = lambda a, b: 100 * F.col(a) / F.nullif(F.col(b), F.lit(0))
    return {
        "symbol_share": share("n_symbols", "word_chars"), "same_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "shout_share": share("shouts", "word_chars"), "capital_share": share("capitals", "letters"), "word_length": 10 * F.col("word_chars") / F.nullif(F.col("n_words"), F.lit(0)),
    }


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x >= 1 by Stirling's series at x + 8, good to twelve digits."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) with k below n p, exact but for rounding. Terms are summed downwards from k; they
    shrink, so those beyond some multiple of the standard deviation add nothing."""
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p * (1 - p))) + 100).cast("int")
    zero = F.struct(top.alias("term"), top.alias("total"))

    def add(s, i):
        j = k - i
        term = s["term"] * (j + 1) / (n - j) * ((1 - p) / p)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.when(k >= n * p, F.lit(1.0)).when(steps < 1, top).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), zero, add, lambda s: s["total"]))


def certified_cutoffs(labelled: DataFrame, alpha: float, delta: float) -> DataFrame:
    """stratum, rule, cutoff: the lowest certified cutoff of each rule in each stratum. labelled: stratum, good (1 or 0)
    and the rule columns. Only good rows count; a stratum without a certified cutoff has no row."""
    good = labelled.where("good = 1")
    counts = [F.count("*").alias("n")]
    for rule, cutoffs in RULES.items():
        counts += [F.count_if(F.col(rule) > c).alias(f"{rule}:{j}") for j, c in enumerate(cutoffs)]
    per = good.groupBy("stratum").agg(*counts)
    triples = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"`{r}:{j}`").alias("k")) for r, cs in RULES.items() for j, c in enumerate(cs)))
    rows = per.select("stratum", "n", F.explode(triples).alias("t")).select("stratum", "n", "t.*")
    each = sum(len(c) for c in RULES.values())
    # Bonferroni over all strata, rules and cutoffs.
    tests = each * max(1, per.count())
    passed = rows.where(binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= delta / tests)
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.06, delta: float = 0.05, stratum: str = "lang", label: str = "quality") -> DataFrame:
    """docs (doc_id, text, the stratum's column) as doc_id, the base statistics, base_failed, kept and rejected_by.

    kept is false for documents with fewer than 10 words or over a fifth of words in repeated 5-word windows, and where
    a certified rule rejects. labels: doc_id and a label of 0 and 1, a holdout of the documents; conflicting labels of an
    id count as bad. Null ids and labels certify nothing. A null stratum is one of its own. Null and empty texts have no
    words and fail the base. Repeated rows are judged alike; without labels no rule applies; an empty table gives an
    empty one. Other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    stats = base_statistics(own).drop("text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = written(stats.withColumns(rule_values()).withColumn("base_failed", failed), "statistics")
    taught = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("good"))
    # One row for each stratum; strata are a few languages, and more than a broadcast holds are joined by Spark's own choice.
    cutoffs = certified_cutoffs(rows.where("not base_failed").join(taught, "doc_id"), alpha, delta)
    wide = written(cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff")), "cutoffs")
    wide = wide.select("stratum", *(F.col(r).alias(f"{r}_cutoff") for r in RULES))
    out = rows.join(wide, "stratum", "left")
    hits = F.filter(F.array(*(F.when(F.col(r) > F.col(f"{r}_cutoff"), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    out = out.withColumn("rejected_by", F.concat_ws(",", hits)).withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
