"""Gap-based incident windows and their rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import severity
from ..rules.packs import KEY_PREFIXES


def slot_of(us: Column, gap_us: int) -> Column:
    return F.floor((us - F.pmod(us, F.lit(gap_us).cast("bigint"))) / F.lit(gap_us)).cast("bigint")


def number_gaps(events: DataFrame, keys: list[str], us: str, gap_us: int) -> DataFrame:
    """(keys, slot, window): the number of the gap window that each time slot of a key belongs to.

    A new window begins where more than ``gap_us`` passed since the key's previous event. Events in one slot of the
    gap's length are always in one window, so only one row for each slot is put in order.
    """
    slots = events.where(F.col(us).isNotNull()).groupBy(*keys, slot_of(F.col(us), gap_us).alias("slot")).agg(F.min(us).alias("a"), F.max(us).alias("z"))
    w = W.partitionBy(*keys).orderBy("slot")
    opened = slots.withColumn("opens", F.coalesce((F.col("a") - F.lag("z").over(w) > gap_us).cast("int"), F.lit(1)))
    return opened.withColumn("window", F.sum("opens").over(w)).select(*keys, "slot", "window")


def with_windows(events: DataFrame, keys: list[str], us: str, gap_us: int) -> DataFrame:
    """The events with time and ``window``, numbered from 1 for each key. Null keys equal each other."""
    numbered = number_gaps(events, keys, us, gap_us)
    e = events.where(F.col(us).isNotNull()).withColumn("slot", slot_of(F.col(us), gap_us)).alias("e")
    n = numbered.alias("n")
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"n.{k}")) for k in [*keys, "slot"]]
    return e.join(n, on).select("e.*", "n.window").drop("slot")


def rollup(windows: DataFrame, keys: list[str], us: str, level: str) -> DataFrame:
    """One row for each window: start, end, events, counts by severity and the greatest severity."""
    rank = severity.rank(F.col(level))
    counts = [F.count_if(rank == k).alias(f"n_{name}") for k, name in enumerate(severity.LABELS)]
    return windows.groupBy(*keys, "window").agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count("*").alias("n_events"), *counts, severity.label(F.max(rank)).alias("max_severity"))


def totals(rolled: DataFrame, keys: list[str]) -> DataFrame:
    """Windows, events and the greatest severity of each key over its windows."""
    return rolled.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.sum("n_events").alias("n_events"), severity.label(F.max(severity.rank(F.col("max_severity")))).alias("max_severity"))


def first_signals(windows: DataFrame, keys: list[str], us: str, event_type: str, event_id: str) -> DataFrame:
    """The first event of each type in each window, in time order."""
    order = F.struct(F.col(us), F.col(event_id))
    return windows.groupBy(*keys, "window", event_type).agg(F.min_by(event_id, order).alias("event_id"), F.min(us).alias("us"), F.count("*").alias("n"))


def top_types(windows: DataFrame, keys: list[str], us: str, event_type: str, most: int = 10) -> DataFrame:
    """The most frequent types of each window; of equal counts the one that appears first, then by name."""
    counted = windows.groupBy(*keys, "window", event_type).agg(F.count("*").alias("n"), F.min(us).alias("first_us"))
    place = F.row_number().over(W.partitionBy(*keys, "window").orderBy(F.desc("n"), "first_us", event_type))
    return counted.withColumn("place", place).where(F.col("place") <= most).drop("first_us")


def slowest(windows: DataFrame, keys: list[str], event_type: str, ms: str) -> DataFrame:
    """The longest duration of each type in each window, above zero, in milliseconds with six decimals."""
    return windows.groupBy(*keys, "window", event_type).agg(F.round(F.max(ms), 6).alias("max_ms")).where("max_ms > 0")


def key_bucket(key: Column) -> Column:
    """The first known prefix of a key, else ``(other)``."""
    out = None
    for p in KEY_PREFIXES:
        out = F.when(key.startswith(p), p) if out is None else out.when(key.startswith(p), p)
    return out.otherwise("(other)")


def narrative(kinds: Column) -> Column:
    """What the types of a window tell, as an array of sentences."""
    has = lambda *names: F.arrays_overlap(kinds, F.array(*map(F.lit, names)))
    told = F.array_compact(
        F.array(
            F.when(has("raft_read_agreement_slow", "linearizable_read_slow", "readindex_retry"), "reads are under pressure"),
            F.when(has("apply_took_too_long", "raft_process_slow", "inmemory_index_scan_slow"), "applying entries is under pressure"),
            F.when(has("health_registry_read"), "the health key is read"),
            F.when(has("slow_fdatasync", "raft_heartbeat_miss"), "raft timing suffers: slow disk or overloaded leader"),
            F.when(has("applied_index_lag"), "correctness risk: the applied index lags"),
            F.when(has("raft_election", "raft_leadership_loss", "swarm_leader_change"), "leadership moved"),
        )
    )
    return F.when(F.size(told) == 0, F.array(F.lit("events without a known story"))).otherwise(told)
