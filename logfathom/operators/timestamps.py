"""Timestamps of mixed formats, precisions and zones as UTC instants."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..session import cut, small

#: Mixture rounds, the weight of a parse that lies after the collection, and the posterior from which a parse holds.
ROUNDS, LATE, SURE = 30, 0.01, 0.99
#: Copies of each decision, so that the ambiguous rows of one source spread.
SALTS = 16
PARSES = pa.list_(pa.struct([("form", pa.string()), ("status", pa.string()), ("us", pa.int64())]))
PARSES_DDL = "array<struct<form:string,status:string,us:bigint>>"


def read(batches: Iterable[pa.RecordBatch], text: int, tz: int, latest: int) -> Iterator[pa.RecordBatch]:
    """Each row with all parses of its text, and the set of their forms as ``form:weight``."""
    for batch in batches:
        sets: list[str | None] = []
        parses: list[list[dict]] = []
        for t, z, end in zip(*(batch.column(k).to_pylist() for k in (text, tz, latest))):
            found = []
            weights = []
            if t is not None:
                own = times.zone(z)
                for r in times.readings(t):
                    got = times.resolve(r, own, end)
                    found.append({"form": r.form, "status": got.status, "us": got.us})
                    weights.append(f"{r.form}:{LATE if end is not None and got.us is not None and got.us > end + times.DAY else 1}")
            sets.append(" ".join(weights) or None)
            parses.append(found)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, pa.string()), pa.array(parses, PARSES)], [*batch.schema.names, "__time_set", "__time_parses"])


def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expectation-maximisation over the format mixture of each source.

    A row is a source with the sets of parses that its values allow and how many values have each set. Every value is
    drawn from one format of its source; the E step shares a value among its parses by the mixture, the M step sums
    the shares. Sets with one parse anchor the mixture.
    """
    for batch in batches:
        out: list[tuple] = []
        for source, sets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parsed = [({f: float(w) for f, w in (x.split(":") for x in s["parses"].split(" "))}, s["n"]) for s in sets]
            formats = sorted({f for p, _ in parsed for f in p})
            mixture = dict.fromkeys(formats, 1 / len(formats))
            for _ in range(ROUNDS):
                share = dict.fromkeys(formats, 1e-9)
                for p, n in parsed:
                    whole = sum(mixture[f] * w for f, w in p.items())
                    for f, w in p.items():
                        share[f] += n * mixture[f] * w / whole
                whole = sum(share.values())
                mixture = {f: x / whole for f, x in share.items()}
            for s, (p, _) in zip(sets, parsed):
                if len(p) > 1:
                    best = max(sorted(p), key=lambda f: mixture[f] * p[f])
                    out.append((source, s["parses"], best, mixture[best] * p[best] / sum(mixture[f] * w for f, w in p.items())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, [pa.string(), pa.string(), pa.string(), pa.float64()])], ["source", "parses", "best", "posterior"])


def normalise_times(rows: DataFrame, text: str, source: str, tz: str, latest_us: str) -> DataFrame:
    """``rows`` with ``time_us`` (UTC epoch microseconds or null), ``time_status`` and ``time_posterior``.

    Every parse that the form of the text and the calendar allow is a candidate. Where there are several, such as day
    and month in either order, the mixture of formats of the row's ``source`` gives each a posterior. The sources are
    summed up to their sets of candidates first, with map-side aggregation, so that a source with a third of all rows
    is a few counts, and the decisions on ambiguous sets come back by a salted join (broadcast if their counted number
    allows). A zone, offset or abbreviation in the text counts, the abbreviation as used in the row's zone ``tz``; else
    the text is wall time in ``tz``. Without a year it is the latest year that does not put the time after
    ``latest_us``. Finer digits than microseconds are cut off.

    time_status: ``ok``; ``missing`` (null or blank text); ``unreadable`` (no form fits, as with times since boot, or
    the calendar has no such time); ``ambiguous`` (no parse has a posterior of 0.99 and they differ); ``no_zone``
    (unknown zone or abbreviation); ``no_year`` (no ``latest_us``, or no year fits); ``skipped`` and ``repeated`` (a
    wall time that the zone's clock skips or passes twice). Only ``ok`` has a time.

    Null sources share one mixture. Every row stays, repeated rows too; a text of any length is read or found
    unreadable; an empty input stays empty. Columns ``time_us``, ``time_status`` and ``time_posterior`` of the input
    are replaced; names that start with ``__time_`` are reserved.
    """
    rows = rows.drop("time_us", "time_status", "time_posterior")
    names = rows.columns
    at = [names.index(c) for c in (text, tz, latest_us)]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "__time_set string", f"__time_parses {PARSES_DDL}"])
    base = cut(rows.mapInArrow(lambda b: read(b, *at), ddl).withColumn("__time_source", F.coalesce(F.col(source).cast("string"), F.lit(""))))

    sets = base.where("__time_set is not null").groupBy("__time_source", "__time_set").agg(F.count("*").alias("n"))
    by_source = sets.groupBy(F.col("__time_source").alias("source")).agg(F.collect_list(F.struct(F.col("__time_set").alias("parses"), "n")).alias("sets"))
    unsure = by_source.where(F.exists("sets", lambda s: F.instr(s["parses"], " ") > 0))
    decisions = cut(unsure.mapInArrow(decide, "source string, parses string, best string, posterior double"))
    decisions = decisions.select(F.col("source").alias("__time_source"), F.col("parses").alias("__time_set"), F.col("best").alias("__time_best"), F.col("posterior").alias("__time_p"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__time_salt"))
    several = F.size("__time_parses") > 1
    # rows with nothing to decide get salts of their own, spread, that no decision has
    salted = base.withColumn("__time_salt", F.when(several, F.pmod(F.xxhash64(text), F.lit(SALTS))).otherwise(-1 - F.pmod(F.xxhash64(text, "__time_source"), F.lit(10_000))).cast("int"))
    decided = salted.join(small(decisions), ["__time_source", "__time_set", "__time_salt"], "left")

    only = F.get("__time_parses", F.lit(0))
    agreed = F.size(F.array_distinct(F.transform("__time_parses", lambda p: F.struct(p["status"], p["us"])))) == 1
    chosen = F.when(several & ~agreed, F.when(F.col("__time_p") >= SURE, F.get(F.filter("__time_parses", lambda p: p["form"] == F.col("__time_best")), F.lit(0)))).otherwise(only)
    picked = decided.withColumn("__time_chosen", chosen)
    blank = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\r\n")) == ""
    status = F.coalesce(F.col("__time_chosen.status"), F.when(several & ~agreed, "ambiguous").when(blank, "missing").otherwise("unreadable"))
    return picked.select(*names, F.when(status == "ok", F.col("__time_chosen.us")).alias("time_us"), status.alias("time_status"), F.when(F.size("__time_parses") == 1, 1.0).otherwise(F.col("__time_p")).alias("time_posterior"))
