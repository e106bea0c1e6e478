"""Durations in log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Duration fields in the order in which they stand for an event, by their JSON names.
FIELDS = {"took": "took", "time_spent": "time spent", "duration": "duration", "exceeded": "exceeded-duration", "retry_timeout": "retry-timeout", "expected": "expected-duration"}
PRIMARY = ("took", "time_spent", "duration", "exceeded", "retry_timeout")


def field(line: Column, name: str) -> Column:
    """The text of a duration field, as JSON member or as ``name=value``; null if there is none."""
    json_name = FIELDS[name]
    member = F.nullif(F.regexp_extract(line, rf'(?i)(?:^|[,{{\s"]){json_name}"\s*:\s*"([^"]+)"', 1), F.lit(""))
    pair = F.nullif(F.regexp_extract(line, rf"(?i)(?:^|[\s,]){json_name.replace(' ', '[ _-]')}=([0-9][0-9.a-zµ]*)", 1), F.lit(""))
    return F.coalesce(member, pair)


def seconds(text: Column) -> Column:
    """Seconds of ``2.5ms``, ``300µs``, ``40ns`` or ``1.2s``: the first number by the unit that the text contains."""
    number = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    has = lambda unit: F.contains(text, F.lit(unit))
    return number / F.when(has("ms"), 1e3).when(has("us") | has("µs"), 1e6).when(has("ns"), 1e9).when(has("s"), 1.0)


def with_durations(rows: DataFrame, line: str, primary: str = "took_s", expected: str = "expected_s") -> DataFrame:
    """Adds the seconds of the first duration field that can be read, and of the expected duration.

    The texts of the fields are taken out of the line first, each once; what is made of them refers to columns.
    """
    texts = rows.select("*", *[field(F.col(line), n).alias(f"__{n}") for n in FIELDS])
    read = texts.select("*", *[seconds(F.col(f"__{n}")).alias(f"__{n}_s") for n in FIELDS])
    return read.withColumns({primary: F.coalesce(*[F.col(f"__{n}_s") for n in PRIMARY]), expected: F.col("__expected_s")}).drop(*[f"__{n}{end}" for n in FIELDS for end in ("", "_s")])


def to_ms(value: Column, unit: Column) -> Column:
    """Milliseconds of a value in ns, us, µs, ms, s or m; null for other units."""
    return F.when(unit == "ns", value / 1_000_000).when(unit.isin("us", "µs"), value / 1000).when(unit == "ms", value).when(unit == "s", value * 1000).when(unit == "m", value * 60_000)
