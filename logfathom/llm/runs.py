"""Runs of repeated consecutive events, by a sorted streaming state machine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUT = "entity string, fields string, first_id string, last_id string, n bigint, a bigint, z bigint, line bigint, opens boolean, closes boolean"
NAMES = [x.split()[0] for x in OUT.split(", ")]
TYPES = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
ARROW = pa.schema([(n, TYPES[t]) for n, t in (x.split() for x in OUT.split(", "))])
#: Between the fields of an event; it can't occur in canonical fields.
MARK = "\x1f"
#: Runs inside a partition are final; this many buckets spread those of a hot entity.
SPREAD = 64


def machine(batches: Iterable[pa.RecordBatch], max_gap_us: int | None, min_similarity: float) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by entity and order, holding nothing but the open run.

    A row continues the run if it has the run's entity, agrees with the run's anchor (its first event) in at least
    ``min_similarity`` of the fields and comes within ``max_gap_us`` of the row before. Finished runs of one event are
    only emitted at the partition's edges, where they may go on in a neighbour.
    """
    run: list | None = None  # as OUT
    seen = object()
    edge = True
    done: list[list] = []

    def like(x: str, y: str) -> bool:
        if x == y or min_similarity >= 1:
            return x == y
        p, q = x.split(MARK), y.split(MARK)
        return sum(map(str.__eq__, p, q)) >= min_similarity * len(p)

    for batch in batches:
        for entity, fields, event, us, line in zip(*(c.to_pylist() for c in batch.columns)):
            if run is not None and entity == run[0]:
                if (event, us, line) == seen:  # redelivered
                    continue
                if like(run[1], fields) and (max_gap_us is None or us - run[6] <= max_gap_us):
                    run[3], run[6], seen = event, us, (event, us, line)
                    run[4] += 1
                    continue
            if run is not None and (run[4] > 1 or run[8]):
                done.append(run)
            run, seen, edge = [entity, fields, event, event, 1, us, us, line, edge, False], (event, us, line), False
        if len(done) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), ARROW.types)], schema=ARROW)
            done = []
    if run is not None:
        run[9] = True
        done.append(run)
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), ARROW.types)], schema=ARROW)


def collapse_runs(events: DataFrame, entity: Column, fields: list[Column], event_id: Column, us: Column, line: Column, max_gap_us: int | None = None, min_similarity: float = 1.0, min_events: int = 2) -> DataFrame:
    """Runs of consecutive like events: (entity, first_event_id, last_event_id, n_events, first_us, last_us).

    The order within an entity is ``us``, then ``line``, then ``event_id``. With exact fields the sorted order is cut
    by range, so an entity with a third of all rows spreads over many tasks; each task runs the state machine and a
    window over the runs at the edges of partitions joins those that a cut went through. With ``min_similarity``
    below 1 a run depends on its anchor, and each entity is streamed through one task instead (sorting may spill, the
    state is one run).

    Rows without entity or time are left out. Null fields are a value of their own: missing equals missing. A
    redelivered row (same order, same event_id) counts once. A null line sorts first. Equal orders of different events
    are both kept. An empty input gives no rows. Only the given columns are read, whatever else there is.
    """
    joined = F.concat_ws(MARK, *[F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields])
    rows = events.select(entity.alias("entity"), joined.alias("fields"), event_id.cast("string").alias("event_id"), us.cast("bigint").alias("us"), line.cast("bigint").alias("line")).where(F.col("entity").isNotNull() & F.col("us").isNotNull())
    order = ["entity", "us", "line", "event_id"]
    placed = rows.repartitionByRange(*order) if min_similarity >= 1 else rows.repartition("entity")
    partial = placed.sortWithinPartitions(*order).mapInArrow(lambda b: machine(b, max_gap_us, min_similarity), OUT)
    at_edge = F.col("opens") | F.col("closes")
    partial = partial.withColumn("part", F.when(at_edge, F.lit(-1)).otherwise(F.pmod(F.hash("first_id", "a"), F.lit(SPREAD))))
    w = W.partitionBy("entity", "part").orderBy("a", "line", "first_id", "z")
    goes_on = F.col("opens") & F.lag("closes").over(w) & (F.lag("fields").over(w) == F.col("fields"))
    if max_gap_us is not None:
        goes_on &= F.col("a") - F.lag("z").over(w) <= max_gap_us
    chained = partial.withColumn("fresh", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("chain", F.sum("fresh").over(w))
    whole = chained.groupBy("entity", "part", "chain").agg(
        F.min_by("first_id", F.struct("a", "line", "first_id")).alias("first_event_id"), F.max_by("last_id", F.struct("a", "line", "first_id", "z")).alias("last_event_id"), F.sum("n").alias("n_events"), F.min("a").alias("first_us"), F.max("z").alias("last_us")
    )
    return whole.where(F.col("n_events") >= min_events).drop("part", "chain")
