"""Timelines, context lines and stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import stable_hash
from ..session import cut, small
from .frames import slotted


def timeline(events: DataFrame, clusters: DataFrame, scope: list[str], us: str, event_type: str, severity: str, event_id: str, chatty: tuple[str, ...], referenced: DataFrame, bucket_us: int, most: int) -> DataFrame:
    """(scope, place, kind, id, us): the timeline of each scope, the first ``most`` items by time.

    Kept are clusters, critical events, events that findings refer to and the first event of each type; of the rest, the
    earliest of each type in each time bucket. Events of a chatty type are left out where a cluster of the type exists, unless they
    are critical or referred to. ``clusters`` has (scope, event_type, cluster_id, start_us), ``referenced`` (scope, event_id).
    """
    refs = cut(referenced.select(*scope, F.col(event_id).alias("__id")).distinct()).withColumn("__ref", F.lit(True))
    noisy = small(cut(clusters.where(F.col("event_type").isin(*chatty)).select(*scope, F.col("event_type").alias("__noisy"), F.lit(True).alias("__has")).distinct()))
    e = events.where(F.col(us).isNotNull()).withColumn("__id", F.col(event_id)).join(refs, [*scope, "__id"], "left").withColumn("__noisy", F.col(event_type)).join(noisy, [*scope, "__noisy"], "left")
    must = (F.col(severity) == "critical") | F.coalesce(F.col("__ref"), F.lit(False))
    e = e.where(must | F.col("__has").isNull()).withColumn("__must", must)
    order = F.struct(F.col(us), F.col(event_id))
    firsts = e.groupBy(*scope, event_type).agg(F.min_by(event_id, order).alias("id"))
    sampled = e.where(~F.col("__must")).groupBy(*scope, event_type, F.floor(F.col(us) / bucket_us)).agg(F.min_by(event_id, order).alias("id"))
    kept = e.where("__must").select(*scope, F.col(event_id).alias("id"))
    ids = kept.unionByName(firsts.select(*scope, "id")).unionByName(sampled.select(*scope, "id")).distinct()
    shown = e.select(*scope, F.col(event_id).alias("id"), F.col(us).alias("us")).join(ids, [*scope, "id"]).withColumn("kind", F.lit("event"))
    items = clusters.select(*scope, F.col("cluster_id").alias("id"), F.col("start_us").alias("us"), F.lit("cluster").alias("kind")).unionByName(shown)
    place = F.row_number().over(W.partitionBy(*scope).orderBy("us", "kind", "id"))
    return items.withColumn("place", place).where(F.col("place") <= most).select(*scope, "place", "kind", "id", "us")


def context(lines: DataFrame, path: str, number: str, line: str, pre: int, post: int) -> DataFrame:
    """Adds ``pre`` and ``post``: the lines before and after each line of its file, nearest last and first.

    Line numbers are cut into slots that overlap by the context, so a long file spreads over many tasks.
    """
    reach = max(pre, post, 1)
    both = slotted(lines, number, reach).unionByName(slotted(lines, number, reach, forward=True).where(~F.col("own"))).distinct()
    w = W.partitionBy(path, "slot").orderBy(number)
    before = F.collect_list(line).over(w.rowsBetween(-pre, -1)) if pre else F.array().cast("array<string>")
    after = F.collect_list(line).over(w.rowsBetween(1, post)) if post else F.array().cast("array<string>")
    return both.withColumn("pre", before).withColumn("post", after).where("own").drop("slot", "own")


def sequential_ids(events: DataFrame, scope: list[str], order: list[str], bucket: Column, prefix: str = "evt_") -> DataFrame:
    """Adds ``seq_id``: ``evt_000001`` and so on in each scope, in a total order.

    ``bucket`` rises with the order (a file's number, an hour). Rows are counted by bucket and numbered inside, so only
    one row for each bucket of a scope is put in a single order. Nulls come first.
    """
    rows = events.withColumn("__bucket", bucket)
    sums = rows.groupBy(*scope, "__bucket").agg(F.count("*").alias("__n"))
    base = F.coalesce(F.sum("__n").over(W.partitionBy(*scope).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select(*[F.col(c).alias(f"__{c}") for c in scope], F.col("__bucket").alias("__of"), base.alias("__base"))
    inside = rows.withColumn("__rn", F.row_number().over(W.partitionBy(*scope, "__bucket").orderBy(*order)))
    on = [inside[c].eqNullSafe(bases[f"__{c}"]) for c in scope] + [inside["__bucket"].eqNullSafe(bases["__of"])]
    number = (F.col("__base") + F.col("__rn")).cast("string")
    named = inside.join(bases, on).withColumn("seq_id", F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.lit(6), F.length(number)), "0")))
    return named.drop("__bucket", "__rn", "__of", "__base", *[f"__{c}" for c in scope])


def event_hash(relpath: Column, number: Column, signature_id: Column, ts: Column, event_type: Column, peer: Column, port: Column, message: Column) -> Column:
    """A hash of what an event says, the same in every run."""
    return stable_hash(relpath, number, signature_id, ts, event_type, peer, port, message)


def byte_budget(lines: DataFrame, order: list[str], size: Column, most: int, bucket: str) -> DataFrame:
    """The lines in order until ``most`` bytes are read; the line that goes over is the last.

    Sums are first taken by ``bucket`` (a column that the order begins with, such as the file's number), so only
    one row for each bucket passes through an unpartitioned window.
    """
    sized = lines.withColumn("__size", size)
    sums = sized.groupBy(bucket).agg(F.sum("__size").alias("__sum"))
    base = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("__base") < most).drop("__sum")
    inside = F.coalesce(F.sum("__size").over(W.partitionBy(bucket).orderBy(*[c for c in order if c != bucket]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sized.join(base, bucket).withColumn("__before", F.col("__base") + inside).where(F.col("__before") < most).drop("__size", "__base", "__before")
