"""Bounded burst clusters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .incidents import number_gaps, slot_of

#: Between the parts of a key in one string.
MARK = "\x1f"


def starts(batches: Iterable[pa.RecordBatch], span_us: int) -> Iterator[pa.RecordBatch]:
    """The cluster start of each (key, window, us), in that order: the state is one cluster."""
    at: tuple = ()
    start = 0
    for batch in batches:
        out = []
        for key, window, us in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, window) != at or us - start > span_us:
                at, start = (key, window), us
            out.append(start)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.int64())], ["key", "us", "start"])


def burst_members(events: DataFrame, keys: list[str], us: str, gap_us: int, span_us: int) -> DataFrame:
    """The events with ``cluster_start``: an event joins while the gap to the one before is at most ``gap_us`` and the cluster spans at most ``span_us``.

    A gap always ends a cluster, so gap windows are independent and spread over tasks, also those of one hot key; in a
    window, equal times share their fate, so only distinct times pass through the sequential step, which holds one
    cluster. Null key parts equal each other; rows without a time are left out.
    """
    key = F.concat_ws(MARK, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    rows = events.where(F.col(us).isNotNull()).withColumn("__key", key)
    times = rows.select(F.col("__key").alias("key"), F.col(us).alias("us")).distinct()
    windows = number_gaps(times, ["key"], "us", gap_us)
    placed = times.withColumn("slot", slot_of(F.col("us"), gap_us)).join(windows, ["key", "slot"]).select("key", "window", "us")
    begun = placed.repartition("key", "window").sortWithinPartitions("key", "window", "us").mapInArrow(lambda b: starts(b, span_us), "key string, us bigint, start bigint")
    begun = begun.select(F.col("key").alias("__key"), F.col("us").alias("__us"), F.col("start").alias("cluster_start"))
    return rows.join(begun, (rows["__key"] == begun["__key"]) & (rows[us] == begun["__us"])).drop("__key", "__us")


def burst_clusters(members: DataFrame, keys: list[str], us: str, at_least: int = 3) -> DataFrame:
    """(keys, cluster_start, start_us, end_us, n) of the clusters with enough events."""
    return members.groupBy(*keys, "cluster_start").agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count("*").alias("n")).where(F.col("n") >= at_least)


def top_values(members: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """The most frequent values in each cluster, of equal counts by value; nulls are left out."""
    counted = members.where(F.col(value).isNotNull()).groupBy(*keys, "cluster_start", value).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(W.partitionBy(*keys, "cluster_start").orderBy(F.desc("n"), value))).where(F.col("place") <= most)


def numbered(clusters: DataFrame, keys: list[str], prefix: str = "clu_") -> DataFrame:
    """Adds ``cluster_id``: ``clu_000001`` and so on by key as text, null as empty, then start.

    Clusters are counted by event type or whatever the first key is, and numbered inside, so no task orders them all.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    rows = clusters.withColumns({n: F.coalesce(F.col(k).cast("string"), F.lit("")) for n, k in zip(names, keys)})
    base = rows.groupBy(names[0]).agg(F.count("*").alias("__n"))
    base = base.withColumn("__base", F.coalesce(F.sum("__n").over(W.orderBy(names[0]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(W.partitionBy(names[0]).orderBy(*names[1:], "start_us"))
    number = (F.col("__base") + F.col("__rn")).cast("string")
    named = rows.withColumn("__rn", inside).join(base, names[0]).withColumn("cluster_id", F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.lit(6), F.length(number)), "0")))
    return named.drop(*names, "__rn", "__base")


def with_values(clusters: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
    """The clusters with the columns of a table by key and cluster start; null key parts equal each other."""
    own = [*keys, "cluster_start"]
    other = top.select(*[F.col(c).alias(f"__{c}") for c in own], *[c for c in top.columns if c not in own])
    same = [clusters[c].eqNullSafe(other[f"__{c}"]) for c in own]
    return clusters.join(other, same, "left").drop(*[f"__{c}" for c in own])
