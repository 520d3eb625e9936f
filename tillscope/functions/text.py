"""Typed fields out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_after(text: Column, pattern: str) -> Column:
    """Whole number captured by group 1 of pattern; NULL when absent or not a number."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found).try_cast("int")


def field_int(text: Column, name: str) -> Column:
    """Value of `name: 12` inside a brace list, blanks ignored."""
    return int_after(F.replace(text, F.lit(" "), F.lit("")), rf"{name}:(-?\d+)(?:[,}}]|$)")


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.replace(text, F.lit(prefix), F.lit(""))


def find_text(text: Column, part: str) -> Column:
    """1-based position of part, 0 when absent."""
    return F.instr(text, part)


def contains_ci(text: Column, part: str) -> Column:
    """Case-blind substring test; no character of part is a wildcard."""
    return F.contains(F.lower(text), F.lower(F.lit(part)))


def json_field(doc: Column, name: str) -> Column:
    return F.get_json_object(doc, f"$.{name}")
