"""Structured payloads and dates in lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_payload(line: Column) -> Column:
    """The JSON object that a line is or ends in, as text; null if there is none."""
    at = F.instr(line, "{")
    rest = F.when(at > 0, F.substring(line, at, F.length(line)))
    return F.when(F.schema_of_variant(F.try_parse_json(rest)).startswith("OBJECT"), rest)


def payload_value(line: Column, *names: str) -> Column:
    """The first of some members of a line's payload, as text."""
    v = F.try_parse_json(json_payload(line))
    return F.coalesce(*[F.try_variant_get(v, f'$["{n}"]', "string") for n in names])


def day_month_year(text: Column) -> Column:
    """The date of ``31/12/2024``; null for anything else."""
    return F.when(text.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.try_to_date(text, "dd/MM/yyyy"))


def after(line: Column, mark: str) -> Column:
    """What stands behind a mark in a line, trimmed; null without the mark."""
    return F.when(F.contains(line, F.lit(mark)), F.trim(F.substring_index(line, mark, -1)))


def assignment(line: Column, name: str) -> Column:
    """The value of ``NAME=value`` or ``NAME="value"``."""
    return F.nullif(F.regexp_extract(line, rf'^{name}="?([^"]*)"?$', 1), F.lit(""))
