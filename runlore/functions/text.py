"""Text rules: slugs, labels, previews, elision, line splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW, LABEL = 16_000, 200
PREVIEW_MARK, LABEL_MARK = "\n…[truncated — full text in the trace]", "…"
#: What str.splitlines() ends a line at; the last line's end begins no other line.
ANY_LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
PLAIN_LINE_END = "\\r\\n|\\r|\\n"
#: The characters that (?U)\s matches.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def lines_of(text: Column, ends: str = ANY_LINE_END) -> Column:
    """The lines of a text as an array, as splitlines() gives them."""
    trimmed = F.regexp_replace(text, f"(?:{ends})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, ends))


def slug(name: Column) -> Column:
    """An artifact's file name: lower case, blanks to hyphens, all else but a-z, 0-9 and - dropped; never cut."""
    lower = F.btrim(F.lower(name), F.lit(WHITE_SPACE))
    # \w is [a-z0-9] here, as no A-Z or _ is left; a class of ranges and single characters is slow where tasks share a JVM
    return F.regexp_replace(F.regexp_replace(lower, "(?U)[\\s_]+", "-"), "[^\\w-]", "")


def run_slug(run_id: Column, most: int = 120, fallback: str | None = None) -> Column:
    """A run id as a file name: other characters folded to -, no - or . at the ends, cut; fallback for nothing left."""
    out = F.ltrim(F.regexp_replace(run_id, "[^\\w.-]+", "-"), F.lit("-."))
    out = F.rtrim(F.substring(out, 1, most), F.lit("-."))
    return out if fallback is None else F.when(F.coalesce(out, F.lit("")) == "", F.lit(fallback)).otherwise(out)


def storage_key(path: Column) -> Column:
    """The storage folder's name for an absolute project path."""
    return F.replace(path, F.lit("/"), F.lit("-"))


def looks_like_path(s: Column) -> Column:
    return s.startswith("/") | s.startswith("~/") | s.startswith("\\") | s.startswith("./") | s.startswith("../")


def label(s: Column, most: int = LABEL) -> Column:
    """A short identifying string: null if empty or shaped like a path, cut with a mark if long."""
    return F.when((s != "") & ~looks_like_path(s), F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit(LABEL_MARK))))


def preview(s: Column, most: int = PREVIEW) -> Column:
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit(PREVIEW_MARK)))


def elide(s: Column, limit: int) -> Column:
    """Head and tail of a long text, with the number of characters between them named."""
    head = limit // 2
    tail = limit - head
    mark = F.concat(F.lit("\n... ("), (F.length(s) - limit).cast("string"), F.lit(" characters omitted) ...\n"))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, head), mark, F.right(s, F.lit(tail))))


def basename(path: Column) -> Column:
    """The last part of a path; null for a blank one. The whole path is never shown."""
    trimmed = F.regexp_replace(path, "/+$", "")
    last = F.regexp_extract(trimmed, "([^/]*)$", 1)
    return F.when((F.trim(path) != "") & (last != ""), last)
