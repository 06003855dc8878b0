"""Typed access to dynamic JSON held as VARIANT.

A path that is absent, null or of another type gives null: `true` is never 1 and "7" never 7. Truthiness is that of the
JSON value: null, false, 0, "", [] and {} are false, all else is true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(v: Column, path: str) -> Column:
    """The VARIANT at a path such as $.meta.x, null where absent."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL(p,s), BOOLEAN, ARRAY<..>, OBJECT<..>, VOID for a JSON null; null where absent."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY"), F.lit(False))


def is_null(v: Column) -> Column:
    """Absent, or a JSON null."""
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True))


def as_str(v: Column) -> Column:
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def as_int(v: Column) -> Column:
    """Integers alone: no booleans, no 3.0."""
    return F.when(kind(v).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, "$", "bigint"))


def is_number(v: Column) -> Column:
    k = kind(v)
    return F.coalesce(k.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"), F.lit(False))


def as_double(v: Column, booleans: bool = False) -> Column:
    """Numbers alone, or also booleans as 1 and 0 where a rule counts them so."""
    number = F.when(is_number(v), F.try_variant_get(v, "$", "double"))
    return F.coalesce(number, F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))) if booleans else number


def as_array(v: Column) -> Column:
    return F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>"))


def as_map(v: Column) -> Column:
    return F.when(is_object(v), F.try_variant_get(v, "$", "map<string,variant>"))


def truthy(v: Column) -> Column:
    k = kind(v)
    value = (
        F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(k == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(is_number(v), F.try_variant_get(v, "$", "double") != 0)
        .when(is_array(v), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .when(is_object(v), F.size(F.try_variant_get(v, "$", "map<string,variant>")) > 0)
    )
    return F.coalesce(value, F.lit(False))


def text_of(v: Column) -> Column:
    """A value as text: strings as they are, others as JSON."""
    return F.when(~is_null(v), F.coalesce(as_str(v), F.to_json(v)))


def strings_of(v: Column) -> Column:
    """The strings of an array, in order; an empty array where it is none."""
    found = F.filter(F.transform(as_array(v), as_str), lambda x: x.isNotNull())
    return F.coalesce(found, F.array().cast("array<string>"))
