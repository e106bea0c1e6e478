"""Range frames over hot keys: time slots with an overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A slot is this many times as long as the frame, so at most one row in so many is read twice.
SLOT_FRAMES = 16


def slotted(rows: DataFrame, us: str, reach_us: int, forward: bool = False) -> DataFrame:
    """The rows with ``slot`` and ``own``, repeated in the slots of other rows that may see them.

    A frame that reaches ``reach_us`` back (or forward) from a row of a slot finds all its rows in that slot, so a
    window can be partitioned by (key, slot): a key with a third of all rows spreads over its slots. A result keeps
    the rows where ``own`` is true.
    """
    length = SLOT_FRAMES * max(1, reach_us)
    own = F.expr(f"({us} - pmod({us}, {length}L)) div {length}L")
    seen = F.expr(f"({us} {'-' if forward else '+'} {reach_us}L - pmod({us} {'-' if forward else '+'} {reach_us}L, {length}L)) div {length}L")
    slots = F.array_distinct(F.array(own, seen))
    return rows.withColumn("slot", F.explode(slots)).withColumn("own", F.col("slot") == own)


def storms(events: DataFrame, keys: list[str], us: str, ord_: str, window_us: int, count: int) -> DataFrame:
    """Events at which the number of events of their key in the last ``window_us`` is exactly ``count``.

    Adds storm_count and window_start_us. The count is that of a sliding pair of pointers over the order (us, ord): it
    takes in the events at exactly ``window_us`` before and, of equal times, only those that come first. It fires again
    whenever the count returns to or stays at ``count``. Rows without a time are left out.
    """
    rows = slotted(events.where(F.col(us).isNotNull()), us, window_us)
    part = W.partitionBy(*keys, "slot")
    ordered = rows.withColumn("__rn", F.row_number().over(part.orderBy(us, ord_)))
    frame = part.orderBy(us).rangeBetween(-window_us, 0)
    counted = ordered.withColumn("storm_count", F.col("__rn") - F.min("__rn").over(frame) + 1).withColumn("window_start_us", F.min(us).over(frame))
    return counted.where(F.col("own") & (F.col("storm_count") == count)).drop("__rn", "slot", "own")


def counts_ahead(events: DataFrame, keys: list[str], us: str, reach_us: int, sums: dict[str, Column]) -> DataFrame:
    """Adds, for each row, sums over the rows of its key at its time and up to ``reach_us`` later, both inclusive."""
    rows = slotted(events.where(F.col(us).isNotNull()), us, reach_us, forward=True)
    frame = W.partitionBy(*keys, "slot").orderBy(us).rangeBetween(0, reach_us)
    return rows.select("*", *[F.sum(c).over(frame).alias(n) for n, c in sums.items()]).where("own").drop("slot", "own")
