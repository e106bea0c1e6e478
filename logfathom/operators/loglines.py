"""Log lines of many programs as entries with time, level, component and message."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import loglex, times
from ..session import cut, small

PART = pa.schema([("path", pa.string()), ("line_number", pa.int64()), ("last_line", pa.int64()), ("n_lines", pa.int64()), ("ts_us", pa.int64()), ("log_level", pa.string()), ("component", pa.string()), ("message", pa.string()), ("head", pa.bool_()), ("opens", pa.bool_()), ("closes", pa.bool_())])
PART_DDL = "path string, line_number bigint, last_line bigint, n_lines bigint, ts_us bigint, log_level string, component string, message string, head boolean, opens boolean, closes boolean"
#: Copies of each plan where they are joined, so that the lines of one pattern spread.
SALTS = 16
#: Plans are sent to all workers if there are no more patterns than this, with no more characters than this.
PLANS, PLAN_CHARS = 200_000, 32_000_000
SLOTS = pa.schema([("pattern", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.string())), ("shape", pa.string()), ("zone", pa.int32())])
SLOTS_DDL = "pattern bigint, n bigint, tokens array<string>, shape string, zone int"
#: Names that may have a role among the keys of a structured line.
ROLE_KEYS = sorted({k for names in (loglex.TIME_KEYS, loglex.LEVEL_KEYS, loglex.MESSAGE_KEYS, loglex.COMPONENT_KEYS) for k in names})


def distinct_masks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The masks of a partition with how often they occur, summed up before anything is shuffled."""
    seen: Counter = Counter()
    for batch in batches:
        seen.update([loglex.mask(line) if line else None for line in batch.column(0).to_pylist()])
        if len(seen) > 50_000:
            yield _counted(seen)
            seen = Counter()
    yield _counted(seen)


def _counted(seen: Counter) -> pa.RecordBatch:
    del seen[None]
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["mask", "n"])


def with_mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = [loglex.mask(line) if line else None for line in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(masks, pa.string())], [*batch.schema.names, "mask"])


def in_slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each mask, the shape of what may be its header, and the number of its slots; no row without one."""
    for batch in batches:
        rows = []
        for pattern, mask, n in zip(*(c.to_pylist() for c in batch.columns)):
            got = loglex.slots(mask)
            form = got.kinds[0]
            shape = form if form in ("json", "pairs") else loglex.shape(got.kinds)
            if shape:
                rows.append((pattern, n, got.tokens, shape, len(got.tokens) if shape == form else len(shape.split(" "))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SLOTS.types)], schema=SLOTS)


def planned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plan of each leaf and shape from the slots of its template."""
    for batch in batches:
        plans = []
        for leaf, shape, slots in zip(*(c.to_pylist() for c in batch.columns)):
            slots.sort(key=lambda s: s["pos"])
            kinds = shape.split(" ")
            plans.append(loglex.plan(kinds, [s["share"] for s in slots] + [0.0] * len(kinds), [s["keys"] for s in slots]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(plans, pa.string())], ["leaf", "shape", "plan"])


def leaves(patterns: DataFrame) -> DataFrame:
    """(pattern, n, tokens, shape, zone, leaf): the leaf of each masked token sequence by iterative partitioning.

    ``patterns`` has the distinct sequences (pattern, n, tokens, shape, zone). They are split by their token count, then
    by the token at the position that varies least, then by the relation of the first two positions of the most
    frequent number of variants: pairs that go one to one, one to many or many to one are split by their single side.
    All steps are aggregations over distinct sequences.
    """
    step1 = cut(patterns.withColumn("size", F.size("tokens")))
    variants = step1.select("size", F.posexplode("tokens").alias("pos", "token")).groupBy("size", "pos").agg(F.count_distinct("token").alias("variants")).where("variants > 1")
    least = variants.groupBy("size").agg(F.min_by("pos", F.struct("variants", "pos")).alias("at"))
    step2 = cut(step1.join(small(least), "size", "left").withColumn("part", F.coalesce(F.try_element_at("tokens", F.col("at") + 1), F.lit(""))).drop("at"))

    part = ["size", "part"]
    variants = step2.select(*part, F.posexplode("tokens").alias("pos", "token")).groupBy(*part, "pos").agg(F.count_distinct("token").alias("variants")).where("variants > 1")
    frequent = variants.groupBy(*part, "variants").agg(F.sort_array(F.collect_list("pos")).alias("at")).where("size(at) > 1")
    two = frequent.groupBy(*part).agg(F.max_by("at", F.struct(F.size("at"), -F.col("variants"))).alias("at")).select(*part, F.get("at", F.lit(0)).alias("p"), F.get("at", F.lit(1)).alias("q"))
    step3 = step2.join(two, part, "left").withColumn("a", F.try_element_at("tokens", F.col("p") + 1)).withColumn("b", F.try_element_at("tokens", F.col("q") + 1)).drop("p", "q")
    mapped = step3.where("a is not null").select(*part, "a", "b").distinct()
    fan = mapped.withColumn("to_b", F.count("*").over(W.partitionBy(*part, "a"))).withColumn("to_a", F.count("*").over(W.partitionBy(*part, "b")))
    side = F.when(F.col("to_a") == 1, F.concat(F.lit("a="), F.col("a"))).when(F.col("to_b") == 1, F.concat(F.lit("b="), F.col("b"))).otherwise("")
    found = step3.join(fan.select(*part, "a", "b", side.alias("side")), [*part, "a", "b"], "left")
    return found.withColumn("leaf", F.xxhash64("size", "part", F.coalesce("side", F.lit("")))).select("pattern", "n", "tokens", "shape", "zone", "leaf")


def templates(leaved: DataFrame) -> DataFrame:
    """(leaf, template): the tokens that all sequences of a leaf share, and ``<*>`` for its variable slots."""
    slots = leaved.select("leaf", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "pos").agg(F.min("token").alias("t0"), F.max("token").alias("t1"))
    return slots.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("t0") == F.col("t1"), F.col("t0")).otherwise("<*>").alias("token")))), lambda x: x["token"]).alias("template"))


def plans(leaved: DataFrame) -> DataFrame:
    """(leaf, shape, plan): which slots of a leaf's template are time, level, component and message.

    Only the slots of the header's shape are looked at. A slot holds levels in a template if all its tokens there are
    level words; a bare word counts as level if it does so in at least half of the templates of the shape, so that a
    message that happens to begin with such a word keeps it. Of the keys of structured lines those count that a
    template has, whatever single lines leave out. A leaf that names no time and message gets no plan, and its lines
    begin no entry.
    """
    slot = F.posexplode(F.slice("tokens", F.lit(1), F.greatest(F.col("zone"), F.lit(1))))
    plain = F.lower(F.regexp_replace("token", r"\x1b\[[0-9;]*m", ""))
    name = F.regexp_replace("token", r'^"|"\s*:$', "")
    held = leaved.select("leaf", "shape", slot.alias("pos", "token")).groupBy("leaf", "shape", "pos").agg(F.bool_and(plain.isin(*loglex.LEVELS)).alias("is_level"), F.collect_set(F.when(F.col("shape").isin("json", "pairs") & name.isin(*ROLE_KEYS), name)).alias("keys"))
    share = held.groupBy("shape", "pos").agg(F.avg(F.col("is_level").cast("double")).alias("share"))
    slots = held.join(share, ["shape", "pos"]).groupBy("leaf", "shape").agg(F.collect_list(F.struct("pos", "share", "keys")).alias("slots"))
    return slots.mapInArrow(planned, "leaf bigint, shape string, plan string").where("plan is not null")


def assemble(batches: Iterable[pa.RecordBatch], tz: str, decided: Broadcast | None = None) -> Iterator[pa.RecordBatch]:
    """One pass over the lines of a partition in file order, holding the open entry.

    ``decided`` has the plan of each mask; without it the plans come as a column.
    Lines without a header at the start of a partition may belong to an entry of the partition before; they come out
    as a part without head.
    """
    zone, utc = times.zone(tz), tz == "UTC"
    ready: dict[str, loglex.Plan] = {}
    known = {}
    for mask, plan in decided.value.items() if decided is not None else ():
        if plan not in ready:
            ready[plan] = loglex.Plan(plan)
        known[mask] = ready[plan]
    entry: list | None = None  # as PART, the message as a list of lines
    edge = True
    done: list[list] = []
    last: tuple = ()

    def finish(closes: bool) -> None:
        if entry is not None:
            entry[7] = "\n".join(entry[7])
            entry[10] = closes
            done.append(entry)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(PART)], schema=PART)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        if decided is not None:
            columns.append([known.get(mask) if line and (mask := loglex.mask(line)) else None for line in columns[2]])
        else:
            for text in set(columns[4]) - ready.keys() - {None}:
                ready[text] = loglex.Plan(text)
            columns[4] = [ready.get(text) for text in columns[4]]
        for path, number, line, latest, plan in zip(*columns):
            if (path, number) == last:  # repeated row
                continue
            last = (path, number)
            line = line or ""
            got = plan.header(line) if plan is not None else None
            us = None
            if got is not None:
                us = times.plain_utc(got.time) if utc else None
                if us is None:
                    read = next(times.readings(got.time), None)
                    us = times.resolve(read, zone, latest).us if read else None
            if got is not None and us is not None:
                finish(False)
                entry = [path, number, number, 1, us, got.level or "none", got.component or "none", [got.message.replace("\r", "")], True, edge, False]
                edge = False
            elif entry is not None and entry[0] == path:
                entry[2], entry[3] = number, entry[3] + 1
                entry[7].append(line.replace("\r", ""))
            else:
                finish(False)
                entry = [path, number, number, 1, None, None, None, [line.replace("\r", "")], False, edge, False]
                edge = False
        if len(done) >= 5000:
            yield out()
            done = []
    finish(True)
    if done:
        yield out()


def log_entries(lines: DataFrame, path: Column, number: Column, line: Column, latest_us: Column, tz: str = "UTC") -> DataFrame:
    """(path, line_number, n_lines, ts_us, log_level, component, message): one row for each entry of each file.

    Lines with a time, or of keys and values, are reduced to masks, and the distinct ones are partitioned into leaf
    templates (see ``leaves``). The slots of a template say what its lines hold: where time, level, component and
    message stand (see ``plans``); no list of layouts is kept. A line begins an entry if its template has a plan, the
    plan reads the line and its time is one. The plans are broadcast if their counted number and size allow, else
    joined with salt. Then the lines are cut by range in file order and each task assembles entries in one pass, so a
    file with a third of all lines spreads over many tasks; entries that a cut went through are joined over the parts
    at the edges, two for each partition at most.

    ``log_level`` is debug, info, warning, error or critical, else ``none``; ``component`` as written without process
    id and line number, else ``none``. Times without a year are the latest year not after ``latest_us``; without one they are
    unknown and begin no entry. ``message`` is the text of the first line, decoded if it was quoted, then the further
    lines as they are, joined by line feeds, without carriage returns. Lines before the first entry of a file belong
    to none.

    A null line counts as empty; rows without path or number are left out; a repeated (path, number) counts once; long
    lines and entries are kept whole. An empty input gives no rows. Only the given columns are read.
    """
    rows = lines.select(path.alias("path"), number.cast("bigint").alias("number"), line.alias("line"), latest_us.cast("bigint").alias("latest")).where("path is not null and number is not null")
    masks = rows.select("line").mapInArrow(distinct_masks, "mask string, n bigint").groupBy("mask").agg(F.sum("n").alias("n"))
    masks = cut(masks.select(F.xxhash64("mask").alias("pattern"), "mask", "n"))
    leaved = cut(leaves(masks.mapInArrow(in_slots, SLOTS_DDL)))
    decisions = leaved.join(plans(leaved), ["leaf", "shape"]).select("pattern", "plan")
    size = masks.agg(F.count("*").alias("n"), F.sum(F.length("mask")).alias("chars")).first()
    if size["n"] <= PLANS and (size["chars"] or 0) <= PLAN_CHARS:
        decided = rows.sparkSession.sparkContext.broadcast({r["mask"]: r["plan"] for r in masks.join(decisions, "pattern").select("mask", "plan").collect()})
        placed = rows.repartitionByRange("path", "number").sortWithinPartitions("path", "number")
        parts = placed.mapInArrow(lambda b: assemble(b, tz, decided), PART_DDL)
    else:
        known = rows.mapInArrow(with_mask, "path string, number bigint, line string, latest bigint, mask string").withColumn("pattern", F.xxhash64("mask"))
        salted = known.withColumn("salt", F.when(F.col("mask").isNotNull(), F.pmod("number", F.lit(SALTS))).otherwise(-1 - F.pmod("number", F.lit(10_000))).cast("int")).drop("mask")
        copies = decisions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = salted.join(copies, ["pattern", "salt"], "left").select("path", "number", "line", "latest", "plan").repartitionByRange("path", "number").sortWithinPartitions("path", "number")
        parts = placed.mapInArrow(lambda b: assemble(b, tz), PART_DDL)

    parts = cut(parts)
    at_edge = F.col("opens") | F.col("closes")
    result = ["path", "line_number", "n_lines", "ts_us", "log_level", "component", "message"]
    chained = parts.where(at_edge).withColumn("chain", F.sum(F.col("head").cast("int")).over(W.partitionBy("path").orderBy("line_number")))
    pieces = F.sort_array(F.collect_list(F.struct("line_number", "message")))
    joined = chained.groupBy("path", "chain").agg(
        F.min("line_number").alias("line_number"), F.sum("n_lines").alias("n_lines"), F.max("ts_us").alias("ts_us"), F.max("log_level").alias("log_level"), F.max("component").alias("component"), F.array_join(F.transform(pieces, lambda p: p["message"]), "\n").alias("message"), F.bool_or("head").alias("head")
    )
    return parts.where(~at_edge & F.col("head")).select(*result).unionByName(joined.where("head").select(*result))
