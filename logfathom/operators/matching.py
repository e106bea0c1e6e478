"""Lines against rules: classification, signatures, captures and pattern counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import severity
from ..rules.model import RulePack, Signature


def hit(line: Column, s: Signature, ignore_case: bool = False) -> Column:
    """Whether any pattern of a signature occurs in the line (and the one it requires as well)."""
    flag = "(?i)" if ignore_case else ""
    found = reduce(Column.__or__, [line.rlike(p if p.startswith("(?i)") else flag + p) for p in s.patterns])
    return found & line.rlike(flag + s.also) if s.also else found


def first_match(line: Column, pack: RulePack) -> Column:
    """The event type of the first signature that matches, ignoring case; null if none does.

    A signature whose own patterns match but whose required one doesn't ends the search without a type.
    """
    out = None
    for s in pack.signatures:
        bare = hit(line, Signature(s.id, s.event_type, s.severity, s.patterns), True)
        value = F.when(line.rlike("(?i)" + s.also), s.event_type) if s.also else F.lit(s.event_type)
        out = F.when(bare, value) if out is None else out.when(bare, value)
    return out


def base_severity(event_type: Column, pack: RulePack) -> Column:
    known = {s.event_type: s.severity for s in reversed(pack.signatures)}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), event_type), F.lit("info"))


def family(event_type: Column, pack: RulePack) -> Column:
    known = {s.event_type: s.family for s in reversed(pack.signatures) if s.family}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), event_type)


def match_signatures(lines: DataFrame, line: str, pack: RulePack, most: int = 3, severities: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each line and signature that it matches, the first ``most`` in the pack's order.

    Adds sig_ord, signature_id, event_type, severity, confidence, ports and the captures peer, port and reason. The
    cap comes before the filter by severity, so a signature that is filtered away still takes a place. All patterns
    are tested in one projection, without a join. Null lines match nothing; every other column is kept, and columns of
    the added names are replaced.
    """
    trimmed = F.trim(F.col(line))
    hits = F.filter(F.array(*[F.when(hit(trimmed, s), k) for k, s in enumerate(pack.signatures)]), lambda x: x.isNotNull())
    table = F.array(*[F.struct(F.lit(s.id).alias("signature_id"), F.lit(s.event_type).alias("event_type"), F.lit(s.severity).alias("severity"), F.lit(s.weight).alias("confidence"), F.array(*map(F.lit, s.ports)).cast("array<int>").alias("ports")) for s in pack.signatures])

    def capture(name: str) -> Column:
        out = F.lit(None).cast("string")
        for k, s in enumerate(pack.signatures):
            pattern = dict(s.captures).get(name)
            if pattern:
                out = F.when(F.col("sig_ord") == k, F.nullif(F.regexp_extract(trimmed, pattern, 1), F.lit(""))).otherwise(out)
        return out

    added = ("sig_ord", "signature_id", "event_type", "severity", "confidence", "ports", "peer", "port", "reason")
    kept = [c for c in lines.columns if c not in added]
    rows = lines.select(*kept, F.explode(F.slice(hits, 1, most)).alias("sig_ord")).withColumn("__sig", F.element_at(table, F.col("sig_ord") + 1))
    rows = rows.select(*kept, "sig_ord", "__sig.*", capture("peer").alias("peer"), capture("port").try_cast("int").alias("port"), capture("reason").alias("reason"))
    return rows.where(F.col("severity").isin(*severities)) if severities else rows


def count_patterns(lines: DataFrame, path: str, number: str, line: str, patterns: tuple[str, ...], day: Column | None = None, numbers: bool = False) -> DataFrame:
    """(pattern, path, day, n, first_line, last_line): hits of every pattern by file, and by day if one is given.

    Each line is read once; hits are exploded and aggregated with map-side combine, so a file with a third of all
    lines is a few rows before the shuffle. ``numbers`` adds those of the first and last line.
    """
    hits = F.filter(F.array(*[F.when(F.col(line).rlike(p), p) for p in patterns]), lambda x: x.isNotNull())
    rows = lines.select(F.col(path).alias("path"), F.col(number).alias("number"), F.col(line).alias("line"), (day if day is not None else F.lit(None).cast("string")).alias("day"), F.explode(hits).alias("pattern"))
    return rows.groupBy("pattern", "path", "day").agg(F.count("*").alias("n"), F.min_by("line", "number").alias("first_line"), F.max_by("line", "number").alias("last_line"), *([F.min("number").alias("first_number"), F.max("number").alias("last_number")] if numbers else []))


def with_zeros(counts: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """(pattern, n): totals with every pattern, also those without a hit."""
    spine = counts.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    totals = counts.groupBy("pattern").agg(F.sum("n").alias("n"))
    return spine.join(totals, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def with_day_zeros(counts: DataFrame, patterns: tuple[str, ...], days: list[str]) -> DataFrame:
    """(pattern, day, n): the hits of every pattern on every day, also those without a hit."""
    spine = counts.sparkSession.createDataFrame([(p, d) for p in patterns for d in days], "pattern string, day string")
    totals = counts.groupBy("pattern", "day").agg(F.sum("n").alias("n"))
    return spine.join(totals, ["pattern", "day"], "left").select("pattern", "day", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def density(n: Column, width: int = 20) -> Column:
    """The length of a bar in proportion to the greatest of a small result."""
    return F.floor(n / F.max(n).over(W.partitionBy(F.lit(1))) * width).cast("int")


def worst(events: DataFrame, keys: list[str], rank: Column, confidence: str, us: str, event_id: str) -> DataFrame:
    """The worst event of each key: most severe, then most confident, then earliest."""
    order = F.struct(-rank, -F.coalesce(F.col(confidence), F.lit(0.0)), F.coalesce(F.col(us), F.lit(2**62)), F.col(event_id))
    return events.groupBy(*keys).agg(F.min_by(event_id, order).alias("worst_event_id"))


def _by_type(values: dict) -> Column:
    return F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)])


def duration_severity(event_type: Column, ms: Column, key: Column, took_s: Column, expected_s: Column, pack: RulePack) -> Column:
    """The severity of an event raised by its duration and by the ratio of taken to expected time; never lowered.

    Ranks and limits are looked up in literal maps, so each argument occurs a few times at most; give columns.
    """
    limits = F.try_element_at(_by_type({name: F.array(*map(F.lit, map(float, t))) for name, t in pack.policies.items()}), event_type)
    for prefix, t in pack.keyspace_policies:
        limits = F.when(key.startswith(prefix), F.array(*map(F.lit, map(float, t)))).otherwise(limits)
    by_ms = F.coalesce(F.size(F.filter(limits, lambda t: ms >= t)), F.lit(0))
    ratio = took_s / F.nullif(expected_s, F.lit(0.0))
    medium, high, critical = pack.ratio_boost
    by_ratio = F.when(ratio >= critical, 4).when(ratio >= high, 3).when(ratio >= medium, 2).otherwise(0)
    ranks = {s.event_type: F.lit(severity.LABELS.index(s.severity)) for s in reversed(pack.signatures)}
    return severity.label(F.greatest(F.coalesce(F.try_element_at(_by_type(ranks), event_type), F.lit(0)), F.greatest(by_ms, F.lit(0)), by_ratio))
