"""Signals of the daemon's journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


# How lines name the endpoints that they fail to reach.
ENDPOINT = r"https?://\d{1,3}(?:\.\d{1,3}){3}:\d{2,5}"
ADDRESS = r"\d{1,3}(?:\.\d{1,3}){3}:\d{2,5}"


def targets(signals: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, target): the distinct ``https://ip:port`` and ``ip:port`` that the lines of each key name."""
    found = F.concat(*[F.regexp_extract_all(F.col(line), F.lit(p), 0) for p in (ENDPOINT, ADDRESS)])
    return signals.select(*keys, F.explode(F.array_distinct(found)).alias("target")).distinct()


def signature_groups(signals: DataFrame, keys: list[str], kind: str, line: str, us: str) -> DataFrame:
    """Lines of each key and kind by their template: count, first and last time, label and retry intervals."""
    normal = signals.withColumn("template", T.template(F.col(line)))
    grouped = normal.groupBy(*keys, kind, "template").agg(F.count("*").alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.array_join(F.sort_array(F.collect_set(T.retry_interval(F.col(line)))), ",").alias("retry_intervals"))
    return grouped.withColumn("label", T.journal_label(F.col(kind), F.col("template")))


def repeating(groups: DataFrame, keys: list[str], most: int = 5, least: int = 3) -> DataFrame:
    """The ``most`` frequent signature groups of each key that have at least ``least`` lines, of equal counts by label, then template."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "label", "template"))
    return groups.where(F.col("n") >= least).withColumn("place", place).where(F.col("place") <= most)


def samples(signals: DataFrame, keys: list[str], us: str, id_: str, ends: int = 2) -> DataFrame:
    """The first and last ``ends`` lines of each key, and how many between them are left out.

    Either end is a ranked limit, which Spark applies before the shuffle, so a hot key is a few rows by then.
    """
    counts = signals.groupBy(*keys).agg(F.count("*").alias("__of"))
    up = F.row_number().over(W.partitionBy(*keys).orderBy(us, id_))
    down = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(us), F.desc(id_)))
    first = signals.withColumn("rn", up).where(F.col("rn") <= ends)
    last = signals.withColumn("rn", down).where(F.col("rn") <= ends)
    both = first.drop("rn").unionByName(last.join(counts, keys).where(F.col("__of") - F.col("rn") >= ends).drop("rn", "__of"))
    return both.join(counts, keys).withColumn("suppressed", F.greatest(F.lit(0), F.col("__of") - 2 * ends)).drop("__of")


def flatten_message(line: Column | str) -> Column:
    """The scalar values of a JSON line joined by blanks, in the order in which they stand; any other line as it is."""
    line = F.col(line) if isinstance(line, str) else line
    values = F.map_values(F.from_json(line, "map<string,string>"))
    flat = F.array_join(F.filter(values, lambda v: ~v.startswith("{") & ~v.startswith("[")), " ")
    return F.when(line.startswith("{"), F.coalesce(F.nullif(flat, F.lit("")), line)).otherwise(line)
