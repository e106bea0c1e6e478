"""Activity sessions by merging gap-length intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_sessions(events: DataFrame, key: Column, us: Column, kind: Column, identity: list[Column], gap_us: int) -> DataFrame:
    """Sessions of each key as (key, start_us, end_us, n_events, n_types).

    Every event opens the interval ``[us, us + gap_us]`` and overlapping or touching intervals of a key merge, so a new
    session begins where more than ``gap_us`` passed without an event. Two events in one time slot of length
    ``gap_us`` always belong together; the first stage therefore merges all intervals of a (key, slot) into one state
    row with map-side partial aggregation, and the second stage merges these few rows in slot order. A hot key never
    meets in one task before it is down to one row for each slot.

    ``identity`` names an event: rows that agree in it, key, time and kind are one redelivered event and count once.
    Rows without key or time are left out. Null kinds count as events but not as types. Equal times merge. Late rows
    need no care in a batch; ``streaming.sessions`` has the watermarked form. An empty input gives no rows. Only the
    given columns are read, so further columns of any name do no harm.
    """
    ids = [c.alias(f"id{i}") for i, c in enumerate(identity)]
    rows = events.select(key.alias("key"), us.alias("us"), kind.alias("kind"), *ids).where(F.col("key").isNotNull() & F.col("us").isNotNull()).distinct()
    slot = F.floor(F.col("us") / F.lit(gap_us).cast("decimal(20,0)")) if gap_us > 2**31 else F.expr(f"(us - pmod(us, {gap_us}L)) div {gap_us}L")
    states = rows.groupBy("key", slot.alias("slot")).agg(F.min("us").alias("a"), F.max("us").alias("z"), F.count("*").alias("n"), F.collect_set("kind").alias("kinds"))
    w = W.partitionBy("key").orderBy("slot")
    opened = states.withColumn("opens", F.coalesce((F.col("a") - F.lag("z").over(w) > gap_us).cast("int"), F.lit(1)))
    numbered = opened.withColumn("session", F.sum("opens").over(w))
    return numbered.groupBy("key", "session").agg(
        F.min("a").alias("start_us"),
        F.max("z").alias("end_us"),
        F.sum("n").alias("n_events"),
        F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))).cast("bigint").alias("n_types"),
    ).drop("session")
