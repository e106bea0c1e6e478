"""Threshold findings over sliding windows, with evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..rules.model import Compound, Heuristic
from ..session import cut, join_few
from .frames import counts_ahead, slotted

#: Findings of one heuristic in one scope.
MOST = 5
#: Rows of evidence of a finding from which no supporting events are added.
ROWS = 12


def firing_times(events: DataFrame, scope: list[str], event_type: str, us: str, h: Heuristic) -> DataFrame:
    """The distinct times of threshold events from which every threshold is met within the window, ends inclusive."""
    kinds = [k for k, _ in h.thresholds]
    sums = {f"t{i}": (F.col(event_type) == k).cast("int") for i, k in enumerate(kinds)}
    counted = counts_ahead(events.where(F.col(event_type).isin(*kinds)).select(*scope, event_type, us), scope, us, h.window_s * 1_000_000, sums)
    met = reduce(lambda a, b: a & b, [F.col(f"t{i}") >= n for i, (_, n) in enumerate(h.thresholds)])
    return counted.where(met).groupBy(*scope, us).agg(*[F.max(n).alias(n) for n in sums])


def pick_findings(times: DataFrame, scope: list[str], us: str, window_us: Column, most: int = MOST) -> DataFrame:
    """The earliest time of each scope, then the earliest after its window, and so on, ``most`` at most.

    Each round is one aggregation with map-side combine, so no list of candidates is gathered.
    """
    times = cut(times)
    picked = times.groupBy(*scope).agg(F.min(us).alias(us)).withColumn("place", F.lit(1))
    out = picked
    for place in range(2, most + 1):
        last = picked.select(*scope, F.col(us).alias("__last"))
        picked = times.join(last, scope).where(F.col(us) > F.col("__last") + window_us).groupBy(*scope).agg(F.min(us).alias(us)).withColumn("place", F.lit(place))
        out = out.unionByName(picked)
    return out


def _by_rule(rules: tuple[Heuristic, ...], value) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for h in rules for x in (h.id, value(h))]), F.col("heuristic_id"))


def findings(events: DataFrame, scope: list[str], event_type: str, us: str, rules: tuple[Heuristic, ...]) -> DataFrame:
    """(scope, heuristic_id, place, start_us, end_us, n_threshold, n_supports, confidence, severity) of all heuristics.

    ``n_threshold`` counts threshold events in the window, ``n_supports`` the supporting types seen there; each of these
    adds 0.05 to the heuristic's weight, 0.10 at most, up to 0.99. All heuristics go through the rounds together.
    """
    window = _by_rule(rules, lambda h: h.window_s * 1_000_000)
    times = reduce(DataFrame.unionByName, [firing_times(events, scope, event_type, us, h).select(*scope, F.lit(h.id).alias("heuristic_id"), us) for h in rules])
    found = cut(pick_findings(times, [*scope, "heuristic_id"], us, window).select(*scope, "heuristic_id", "place", F.col(us).alias("start_us"), (F.col(us) + window).alias("end_us")))
    kinds = events.sparkSession.createDataFrame([(h.id, k, True) for h in rules for k, _ in h.thresholds] + [(h.id, k, False) for h in rules for k in h.supports], "heuristic_id string, __kind string, __counts boolean")
    near = events.select(*scope, F.col(event_type).alias("__kind"), F.col(us).alias("__us"))
    seen = join_few(near, found.join(F.broadcast(kinds), "heuristic_id"), [*scope, "__kind"], "__us").where(F.col("__us").between(F.col("start_us"), F.col("end_us")))
    counted = seen.groupBy(*scope, "heuristic_id", "place", "start_us", "end_us").agg(F.count_if("__counts").alias("n_threshold"), F.count_distinct(F.when(~F.col("__counts"), F.col("__kind"))).alias("n_supports"))
    bonus = F.least(F.lit(0.10), F.col("n_supports") * 0.05)
    return counted.withColumn("confidence", F.round(F.least(F.lit(0.99), _by_rule(rules, lambda h: h.weight) + bonus), 3)).withColumn("severity", _by_rule(rules, lambda h: h.severity))


def evidence(found: DataFrame, events: DataFrame, scope: list[str], event_type: str, us: str, event_id: str, rules: tuple[Heuristic, ...]) -> DataFrame:
    """First, middle and last event of each threshold type in each finding, then first and last of each supporting type.

    Supporting types follow in the order of the rule until the finding has ``ROWS`` rows; threshold types are never cut.
    """
    kinds = [(h.id, k, i, i >= len(h.thresholds)) for h in rules for i, k in enumerate([*(k for k, _ in h.thresholds), *dict.fromkeys(h.supports)])]
    pairs = found.sparkSession.createDataFrame(kinds, "heuristic_id string, __kind string, __at int, __supports boolean")
    near = events.select(*scope, F.col(event_type).alias("__kind"), F.col(us).alias("us"), F.col(event_id).alias("event_id"))
    inside = join_few(near, cut(found).join(F.broadcast(pairs), "heuristic_id"), [*scope, "__kind"], "event_id").where(F.col("us").between(F.col("start_us"), F.col("end_us")))
    w = W.partitionBy(*scope, "heuristic_id", "place", "__at")
    numbered = inside.withColumn("rn", F.row_number().over(w.orderBy("us", "event_id"))).withColumn("of", F.count("*").over(w))
    middle = F.expr("of div 2") + 1
    sampled = numbered.where((F.col("rn") == 1) | (~F.col("__supports") & (F.col("rn") == middle)) | (F.col("rn") == F.col("of")))
    row = F.row_number().over(W.partitionBy(*scope, "heuristic_id", "place").orderBy("__at", "rn"))
    kept = sampled.withColumn("row", row).where(~F.col("__supports") | (F.col("row") <= ROWS))
    return kept.select(*scope, "heuristic_id", "place", F.col("__kind").alias("event_type"), "event_id", "us")


def compound_times(events: DataFrame, scope: list[str], event_type: str, us: str, rule: Compound) -> DataFrame:
    """(scope, rule, us): times from which all, any and none of a rule's types hold within its window."""
    kinds = sorted({*rule.all_of, *rule.any_of, *rule.none_of, *(k for k, _ in rule.thresholds)})
    sums = {f"k_{k}": (F.col(event_type) == k).cast("int") for k in kinds}
    counted = counts_ahead(events.where(F.col(event_type).isin(*kinds)).select(*scope, event_type, us), scope, us, rule.window_s * 1_000_000, sums)
    n = lambda k: F.col(f"k_{k}")
    met = F.lit(True)
    for k in rule.all_of:
        met &= n(k) > 0
    if rule.any_of:
        met &= reduce(lambda a, b: a | b, [n(k) > 0 for k in rule.any_of])
    for k in rule.none_of:
        met &= n(k) == 0
    for k, need in rule.thresholds:
        met &= n(k) >= need
    return counted.where(met).select(*scope, F.lit(rule.id).alias("rule"), us).distinct()


def related_within(events: DataFrame, scope: list[str], event_type: str, us: str, event_id: str, first: str, then: str, within_us: int) -> DataFrame:
    """Events of one type with the latest earlier event of another type in their scope, if it is near enough.

    An as-of join by one window over both types, in time slots that overlap by the reach; equal times count as earlier.
    """
    both = slotted(events.where(F.col(event_type).isin(first, then) & F.col(us).isNotNull()), us, within_us)
    w = W.partitionBy(*scope, "slot").orderBy(us, (F.col(event_type) == then).cast("int"), event_id).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(F.col(event_type) == first, F.struct(F.col(event_id).alias("id"), F.col(us).alias("us"))), ignorenulls=True).over(w)
    near = both.withColumn("__last", last).where(F.col("own") & (F.col(event_type) == then) & (F.col(us) - F.col("__last.us") <= within_us))
    return near.select(*scope, F.col(event_id), F.col("__last.id").alias("after_event_id"), (F.col(us) - F.col("__last.us")).alias("lag_us"))
