"""Redaction of secrets in whole texts: built-in rules, a vendor's rules behind keywords, then an operator's.

Rules run in order over a whole text, as keywords and matches may lie lines apart. The work is CPU-bound pattern matching
with the meaning of Python's `re`, so it is a vectorised helper; batches are small, as one text may have megabytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The built-in rules, in order: label and pattern. Fixed values.
BUILT_IN = [
    ("private_key", r"(?s)-----BEGIN[ A-Z]*PRIVATE KEY-----.*?-----END[ A-Z]*PRIVATE KEY-----"),
    ("bearer_token", r"(?i)(?<=authorization:\s)(?:bearer|token)\s+[A-Za-z0-9\-._~+/]{8,}=*"),
    ("api_key", r"\b(?:sk|pk)-(?:[A-Za-z0-9]+-)?[A-Za-z0-9_\-]{20,}"),
    ("aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{16,}\b"),
    ("google_api_key", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    ("secret_assignment", r"(?i)(?<=\b)(?P<key>password|passwd|secret|api[_-]?key|access[_-]?token)(?P<sep>\s*[:=]\s*)(?P<quote>[\"']?)(?P<value>[^\s\"',;]{6,})(?P=quote)"),
]
#: Of the last, the value alone goes: which secret was set stays legible.
KEPT_AROUND = {"secret_assignment": "value"}
#: Strings of which a text holds one where the label's rule can match; those of FOLDED are sought in the lower-cased text.
GATES = {
    "private_key": ["PRIVATE KEY-----"],
    "api_key": ["sk-", "pk-"],
    "aws_access_key_id": ["AKIA", "ASIA"],
    "github_token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "google_api_key": ["AIza"],
}
FOLDED = {
    "bearer_token": ["authorization:"],
    "secret_assignment": ["password", "passwd", "secret", "apikey", "api_key", "api-key", "accesstoken", "access_token", "access-token"],
}
#: Letters beyond ASCII that equal an ASCII one where case is ignored: texts with one always meet the rules of FOLDED.
EQUAL_LETTERS = "\u0130\u0131\u017f\u212a"


def placeholder(label: str) -> str:
    return f"[REDACTED:{label}]"


def replace(pattern: re.Pattern[str], label: str, group: int | str | None, strict: bool, text: str) -> str:
    """text with matches replaced: the whole match, or the group's part of it. Where the group took no part, the whole
    match goes, or with strict nothing does."""
    mark = placeholder(label)

    def one(m: re.Match[str]) -> str:
        if group is None:
            return mark
        a, b = m.span(group)
        if a < 0:
            return m.group(0) if strict else mark
        return m.string[m.start() : a] + mark + m.string[b : m.end()]

    return pattern.sub(one, text)


def due_rules(text: str) -> set[str]:
    """Labels of the built-in rules that can match a text. Placeholders bring in no string of a gate that a later rule
    could match at, so the gates of the original text hold for all rules."""
    low = text.lower()
    odd = any(c in text for c in EQUAL_LETTERS)
    due = {label for label, parts in GATES.items() if any(p in text for p in parts)}
    return due | {label for label, parts in FOLDED.items() if odd or any(p in low for p in parts)}


def apply_rule(rule, pattern: re.Pattern[str], text: str) -> str:
    return replace(pattern, rule.label, rule.group, isinstance(rule.group, str), text)


class Redactor:
    """All rules compiled; one for each Python worker."""

    def __init__(self, vendor: list, operator: list):
        self.first = [(re.compile(p), label, KEPT_AROUND.get(label)) for label, p in BUILT_IN]
        self.vendor = [(re.compile(r.regex), r) for r in vendor]
        self.operator = [(re.compile(r.regex), r) for r in operator]
        # One scan finds every keyword of a text; a rule without keywords always runs.
        self.always = [i for i, (_, r) in enumerate(self.vendor) if not r.keywords]
        self.words = ahocorasick.Automaton()
        by: dict[str, set[int]] = {}
        for i, (_, r) in enumerate(self.vendor):
            for k in r.keywords:
                by.setdefault(k, set()).add(i)
        for k, rules in by.items():
            self.words.add_word(k, frozenset(rules))
        if by:
            self.words.make_automaton()

    def __call__(self, text: str) -> str:
        gates = due_rules(text)
        for pattern, label, group in self.first:
            if label in gates:
                text = replace(pattern, label, group, True, text)
        # The keywords are those of the text after the built-in rules.
        due = set(self.always)
        if len(self.words):
            for rules in {r for _, r in self.words.iter(text.lower())}:
                due |= rules
        for i in sorted(due):
            pattern, rule = self.vendor[i]
            text = apply_rule(rule, pattern, text)
        for pattern, rule in self.operator:
            text = apply_rule(rule, pattern, text)
        return text


_CACHE: dict[tuple, Redactor] = {}


def redactor(vendor: tuple, operator: tuple) -> Redactor:
    """One for each worker and set of rules."""
    if (vendor, operator) not in _CACHE:
        _CACHE.clear()
        _CACHE[vendor, operator] = Redactor(list(vendor), list(operator))
    return _CACHE[vendor, operator]


def redact(text: Column, vendor: list = (), operator: list = ()) -> Column:
    """The text without secrets. Null stays null; what is no string is its string. Redacting twice changes nothing more."""
    v, o = tuple(vendor), tuple(operator)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = redactor(v, o)
        for s in batches:
            yield s.map(lambda t: None if t is None else own(t))

    return run(text.cast("string"))


def redact_built_in(text: Column) -> Column:
    """The built-in rules alone, in the JVM: Python's meaning of classes and line ends is asked for by (?U) and (?d). A
    rule's pattern runs on texts that pass its gate."""
    whole = text.cast("string")
    return F.transform(F.array(F.struct(whole.alias("text"), F.lower(whole).alias("low"))), lambda r: _built_in(r["text"], r["low"]))[0]


def _built_in(text: Column, low: Column) -> Column:
    holds = lambda where, parts: reduce(or_, (F.contains(where, F.lit(p)) for p in parts))
    gates = {label: holds(text, parts) for label, parts in GATES.items()} | {label: holds(low, parts) | holds(text, EQUAL_LETTERS) for label, parts in FOLDED.items()}
    out = text
    for label, pattern in BUILT_IN:
        java = pattern.replace("(?P<", "(?<").replace("(?P=quote)", "\\k<quote>")
        flags = "(?Uud)" if java.startswith("(?i)") else "(?Ud)"
        kept = "${key}${sep}${quote}" + placeholder(label) + "${quote}" if label in KEPT_AROUND else placeholder(label)
        out = _gated(out, gates[label], flags + java, kept)
    return out


def _gated(text: Column, gate: Column, rule: str, by: str) -> Column:
    """A lambda's argument, so that a rule's input is computed once and not in both branches."""
    return F.transform(F.array(text), lambda t: F.when(gate, F.regexp_replace(t, rule, by)).otherwise(t))[0]


def matches(text: Column, regexes: dict[str, str], label: Column) -> Column:
    """Whether the rule of a label matches a text; null for a label without a rule."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series, labels: pd.Series) -> pd.Series:
        patterns = {k: re.compile(r) for k, r in regexes.items()}
        return pd.Series([None if name not in patterns or t is None else patterns[name].search(t) is not None for t, name in zip(texts, labels, strict=True)], dtype=object)

    return run(text, label)


def alive(samples: DataFrame, vendor: list, covers: DataFrame, operator: list = ()) -> DataFrame:
    """samples (rule_id, sample and any other columns) with whether each rule still does its work: matches (its pattern is
    found in its sample), secret_gone (what it would replace is not in the redacted sample), shown (labels in that, in
    order, as an array), own (its own label is one of them), covered_by (the rule that took the sample in its place, null
    if none that may) and alive (it matches, the secret is gone, and its own or a rule that may cover it is shown).

    covers (rule_id, covered_by): rules that may take another's sample; a rule covered by a covered one is covered too. A
    sample that does not open its rule's keyword gate is read behind the gate's first keyword. Unknown rules match
    nothing; a null sample matches nothing.
    """
    rules = {r.label: r for r in vendor}

    @F.pandas_udf("struct<matches:boolean,text:string,secret:string>")
    def tried(rule: pd.Series, sample: pd.Series) -> pd.DataFrame:
        out = []
        for label, text in zip(rule, sample, strict=True):
            r = rules.get(label)
            m = re.compile(r.regex).search(text) if r is not None and isinstance(text, str) else None
            if m is None:
                out.append((False, text, None))
                continue
            part = m.group(r.group) if r.group is not None else None
            closed = r.keywords and not any(k in text.lower() for k in r.keywords)
            out.append((True, f"{r.keywords[0]} {text}" if closed else text, part or m.group(0)))
        return pd.DataFrame(out, columns=["matches", "text", "secret"])

    rows = samples.select(F.struct(*samples.columns).alias("row"), "rule_id", tried("rule_id", "sample").alias("t"))
    rows = rows.withColumn("redacted", redact(F.col("t.text"), vendor, operator))
    shown = F.coalesce(F.regexp_extract_all("redacted", F.lit(r"\[REDACTED:([^\]]+)\]"), 1), F.array().cast("array<string>"))
    allowed = _closure(covers).groupBy("rule_id").agg(F.sort_array(F.collect_set("covered_by")).alias("allowed"))
    rows = rows.withColumn("shown", shown).join(F.broadcast(allowed), "rule_id", "left")  # a row a rule
    gone = F.coalesce(~F.col("redacted").contains(F.col("t.secret")), F.lit(False))
    own = F.array_contains("shown", F.col("rule_id"))
    may = F.filter("shown", lambda x: F.coalesce(F.array_contains("allowed", x), F.lit(False)))
    covered = F.when(~own, F.get(may, F.lit(0)))
    out = rows.select("row.*", F.col("t.matches").alias("matches"), gone.alias("secret_gone"), "shown", own.alias("own"), covered.alias("covered_by"))
    return out.withColumn("alive", F.col("matches") & F.col("secret_gone") & (F.col("own") | F.col("covered_by").isNotNull()))


def _closure(covers: DataFrame) -> DataFrame:
    """rule_id, covered_by: also over covered rules. Rules are a small table that a person writes: its closure is found by
    doubling, a join a round, until none is new."""
    out = covers.select("rule_id", "covered_by").where("rule_id <> covered_by").distinct()
    size = out.count()
    while size:
        step = out.alias("a").join(out.alias("b"), F.col("a.covered_by") == F.col("b.rule_id")).select("a.rule_id", "b.covered_by")
        out = out.unionByName(step).where("rule_id <> covered_by").distinct()
        now = out.count()
        if now == size:
            break
        size = now
    return out
