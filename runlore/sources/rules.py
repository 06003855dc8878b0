"""Redaction rules: a vendor's rule file and an operator's, checked before anything runs with them.

Rules are a small table that an operator writes by hand, so they are checked on the driver. A redactor that silently got
weaker would be worse than none: every fault is an error that names the rule.
"""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: The closed set of an operator rule's keys, and those it must have.
KEYS = {"label", "regex", "description", "sample", "replace_group"}
REQUIRED = ["label", "regex", "description", "sample"]


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    label: str
    regex: str
    #: Lower-cased words, one of which must be in the text for the rule to run; none: it always runs.
    keywords: tuple[str, ...] = ()
    #: What to replace: the whole match (None), or a group by number or name.
    group: int | str | None = None
    #: Recorded, never applied: a doubtful match is redacted.
    entropy: float | None = None
    sample: str | None = field(default=None, compare=False)


def compiled(regex: str, label: str) -> re.Pattern[str]:
    """The pattern; a warning of the compiler (an unknown class, say) is an error, as it would match something else."""
    re.purge()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        try:
            return re.compile(regex)
        except (re.error, Warning) as e:
            raise RuleError(f"rule {label!r}: {e}") from e


def whole_file(spark: SparkSession, path: str):
    rows = spark.read.text(path, wholetext=True).limit(2).collect()  # a rule file, not data
    if len(rows) != 1:
        raise RuleError(f"{path} is not one file")
    try:
        return json.loads(rows[0][0])
    except ValueError as e:
        raise RuleError(f"{path}: {e}") from e


def vendor_rules(document: dict) -> list[Rule]:
    """Rules {id, regex, keywords, entropy?}, in order of id. A pattern with one group that has no name replaces that
    group, any other the whole match."""
    out = []
    for entry in sorted(document["rules"], key=lambda e: e["id"]):
        pattern = compiled(entry["regex"], entry["id"])
        one = pattern.groups == 1 and not pattern.groupindex
        out.append(Rule(entry["id"], entry["regex"], tuple(k.lower() for k in entry.get("keywords") or ()), 1 if one else None, entry.get("entropy")))
    return out


def operator_rules(entries: list) -> list[Rule]:
    """An operator's rules {label, regex, description, sample, replace_group?}: no other keys, labels unique and without
    brackets, and each must redact its own sample, once and for all."""
    from runlore.functions.redaction import apply_rule

    if not isinstance(entries, list):
        raise RuleError("the rules are not a list")
    out: list[Rule] = []
    for i, e in enumerate(entries):
        if not isinstance(e, dict):
            raise RuleError(f"rule {i} is not an object")
        if extra := sorted(set(e) - KEYS):
            raise RuleError(f"rule {i} has unknown keys {extra}")
        for k in REQUIRED:
            if not isinstance(e.get(k), str) or not e[k].strip():
                raise RuleError(f"rule {i} has no {k}")
        label, group = e["label"], e.get("replace_group")
        if re.search(r"[\[\]]", label) or label in {r.label for r in out}:
            raise RuleError(f"label {label!r} has brackets or is used twice")
        pattern = compiled(e["regex"], label)
        if group is not None and group not in pattern.groupindex:
            raise RuleError(f"rule {label!r} has no group {group!r}")
        if pattern.search("") is not None:
            raise RuleError(f"rule {label!r} matches the empty text")
        rule = Rule(label, e["regex"], (), group, None, e["sample"])
        once = apply_rule(rule, pattern, e["sample"])
        if once == e["sample"]:
            raise RuleError(f"rule {label!r} does not redact its sample")
        if apply_rule(rule, pattern, once) != once:
            raise RuleError(f"rule {label!r} redacts its own placeholder")
        out.append(rule)
    return out


def load_vendor_rules(spark: SparkSession, path: str) -> list[Rule]:
    return vendor_rules(whole_file(spark, path))


def load_operator_rules(spark: SparkSession, path: str) -> list[Rule]:
    return operator_rules(whole_file(spark, path))
