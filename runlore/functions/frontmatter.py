"""Front matter of drafted files: a leading YAML block between --- lines.

Spark finds the block and reads plain ones itself: keys with one-line texts, and a metadata mapping of such. Only blocks
that need a YAML reader (quotes, lists, numbers, comments, folded texts) go to a helper, and only they leave the JVM.
"""

from __future__ import annotations

import datetime
import json

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

#: Line ends as splitlines() knows them, and white space within a line.
_END = "(?:\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029])"
_GAP = "[\\s\\x1f&&[^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]]*+"
#: Blank lines, a fence, the block, a fence, the body.
_PARTS = f"(?sU)\\A[\\s\\x1c-\\x1f]*+(?<=\\A|{_END}|[\\s\\x1f])---{_GAP}{_END}(|.*?{_END}){_GAP}---{_GAP}(?:{_END}|\\z)(.*)\\z"
#: A text that YAML takes as it stands, and lines of a block that Spark reads.
_TEXT = "[A-Za-z][A-Za-z0-9_.,/()'-]*+(?: [A-Za-z0-9_.,/()'-]++)*+"
_PLAIN = f"\\A(?:[a-z_]++: {_TEXT}\\n|metadata:\\n(?:  [a-z_]++: {_TEXT}\\n)++|\\n)*+\\z"
#: Lines with words that are no texts in YAML, as keys or values.
_WORD = "(?:true|false|yes|no|on|off|null)"
_WORDS = f"(?im)^ *(?:{_WORD}: .*|[a-z_]+: {_WORD})$"
_KINDS = {"name": StringType(), "description": StringType(), "type": StringType(), "has_meta": BooleanType(), "has_metadata": BooleanType(), "meta_json": StringType()}
ROW = StructType([StructField(c, t) for c, t in _KINDS.items()])


def read_block(block: str | None) -> tuple | None:
    """name, description, type, has_meta, has_metadata, meta_json of a block, as YAML reads it; None if it is torn."""
    try:
        meta = yaml.safe_load(block or "")
    except yaml.YAMLError:
        return None
    meta = meta if isinstance(meta, dict) else {}
    as_text = lambda x: x if isinstance(x, str) else None
    metadata = meta.get("metadata")
    kind = metadata.get("type") if isinstance(metadata, dict) else None
    safe = json.dumps(meta, default=lambda x: x.isoformat() if isinstance(x, datetime.date) else str(x), ensure_ascii=False, skipkeys=True)
    return as_text(meta.get("name")), as_text(meta.get("description")), as_text(kind), bool(meta), isinstance(metadata, dict), safe


@F.pandas_udf(ROW)
def _read(blocks: pd.Series) -> pd.DataFrame:
    none = (None,) * 6
    rows = [none if b is None else read_block(b) or none for b in blocks]
    return pd.DataFrame(rows, columns=list(_KINDS), dtype=object)


def _as_json(block: Column) -> Column:
    """A plain block as the JSON of its mapping, in the order of its keys."""
    lines = F.filter(F.split(block, "\n"), lambda x: x != "")
    start = F.struct(F.lit("").alias("json"), F.lit(False).alias("inside"))
    pair = lambda x: F.regexp_replace(x, "^ *([a-z_]+): (.*)$", '"$1": "$2"')

    def add(s: Column, x: Column) -> Column:
        opens, nested = x == "metadata:", x.startswith(" ")
        closed = F.when(s["inside"] & ~nested, F.concat(s["json"], F.lit("}"))).otherwise(s["json"])
        gap = F.when((closed == "") | closed.endswith("{"), "").otherwise(", ")
        return F.struct(F.concat(closed, gap, F.when(opens, F.lit('"metadata": {')).otherwise(pair(x))).alias("json"), (opens | nested).alias("inside"))

    return F.concat(F.lit("{"), F.aggregate(lines, start, add, lambda s: F.concat(s["json"], F.when(s["inside"], "}").otherwise(""))), F.lit("}"))


def _value(block: Column, key: str, indent: str = "") -> Column:
    found = F.regexp_extract(block, f"(?m)^{indent}{key}: (.*)$", 1)
    return F.when(found != "", found)


def frontmatter(text: Column) -> Column:
    """A struct of name, description, type (of metadata), has_meta, has_metadata, body and meta_json. Names and
    descriptions that are no strings are null. Empty lines may come first; a text without an opened and closed block, or
    with a torn one, is all body; of a block that is no mapping nothing is known. A null text is an empty body."""

    def cut(text: Column) -> Column:
        closed = text.rlike(_PARTS)
        return F.struct(text.alias("text"), F.when(closed, F.regexp_extract(text, _PARTS, 1)).alias("block"), F.when(closed, F.regexp_extract(text, _PARTS, 2)).alias("rest"))

    def read(p: Column) -> Column:
        block = p["block"]
        keys = F.regexp_extract_all(block, F.lit("(?m)^( *[a-z_]+):"), 1)
        plain = F.coalesce(block.rlike(_PLAIN) & ~block.rlike(_WORDS) & (F.size(F.array_distinct(keys)) == F.size(keys)), F.lit(False))
        simple = F.struct(
            _value(block, "name").alias("name"), _value(block, "description").alias("description"), _value(block, "type", "  ").alias("type"),
            (F.size(keys) > 0).alias("has_meta"), block.rlike("(?m)^metadata:$").alias("has_metadata"), _as_json(block).alias("meta_json"),
        )
        row = F.when(plain, simple.cast(ROW))
        return F.struct(p["text"].alias("text"), p["rest"].alias("rest"), row.alias("row"), F.when(~plain, block).alias("odd"))

    def finish(x: Column) -> Column:
        s = x["s"]
        row = F.coalesce(s["row"], F.when(x["h"]["meta_json"].isNotNull(), x["h"].cast(ROW)))
        fields = {"name": None, "description": None, "type": None, "has_meta": F.lit(False), "has_metadata": F.lit(False)}
        given = [(row[c] if other is None else F.coalesce(row[c], other)).alias(c) for c, other in fields.items()]
        body = F.when(row.isNotNull(), s["rest"]).otherwise(s["text"]).alias("body")
        return F.struct(*given, body, F.coalesce(row["meta_json"], F.lit("{}")).alias("meta_json"))

    # A lambda's argument is computed once, however often it is used.
    once = lambda x, f: F.transform(F.array(x), f)[0]
    parts = once(once(F.coalesce(text, F.lit("")), cut), read)
    return once(F.struct(parts.alias("s"), _read(parts["odd"]).alias("h")), finish)
