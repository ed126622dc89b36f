"""Soft validation of a model's answers: known members only, each coerced or dropped, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfence(raw: Column) -> Column:
    """The JSON text of an answer: without a code fence, else from the first brace to the last; null without braces."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?s)^\s*```[A-Za-z]*\s*", ""), r"(?s)\s*```\s*$", ""))
    body = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.when(body != "", body)


def readable(json: Column) -> Column:
    """Whether the text is a JSON value."""
    return F.try_parse_json(json).isNotNull()


def number(json: Column, path: str) -> Column:
    """A finite number at the path; null for numeric strings and other types."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, path, "double"))


def string(json: Column, path: str) -> Column:
    """A string at the path; null for other types."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def list_size(json: Column, path: str) -> Column:
    """The length of an array at the path; 0 for anything else."""
    return F.coalesce(F.size(F.try_variant_get(F.try_parse_json(json), path, "array<variant>")), F.lit(0))
