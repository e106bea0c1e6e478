"""Whole runs over a bundle on disk: triage, incidents, pattern scan, redaction, inventory."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import durations, spelling, times
from ..functions.epoch import iso_of
from ..operators import bursts, filters, findings, frames, incidents, inventory, matching, redact, timeline
from ..render import markdown
from ..rules import packs
from ..session import cut
from ..sinks import tables
from ..sources import files, lines

KEYS = ["event_type", "peer", "port"]


def timed_lines(rows: DataFrame, line: str = "line", latest_us: int | None = None, tz: str = "UTC") -> DataFrame:
    """The lines with ``us``, the first time that stands in them by the forms that programs begin lines with."""
    forms = r'time="?([^"\s]+)|([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.,]+(?:Z|[+-][0-9]{2}:?[0-9]{2})?)|^((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ 0-9][0-9] [0-9:]{8})'

    @F.pandas_udf("bigint")
    def instant(texts):
        zone = times.zone(tz)

        def one(t):
            r = next(times.readings(t), None) if t else None
            return times.resolve(r, zone, latest_us).us if r else None

        return texts.map(one).astype("Int64")

    written = F.coalesce(*[F.nullif(F.regexp_extract(line, forms, k), F.lit("")) for k in (1, 2, 3)])
    return rows.withColumn("ts_raw", written).withColumn("us", instant(F.col("ts_raw")))


def top_targets(events: DataFrame, most: int = 3) -> DataFrame:
    """(event_type, top_targets): the most frequent ``peer:port`` of each type, of equal counts by text; a missing part is empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = events.withColumn("target", F.concat(part("peer"), F.lit(":"), part("port"))).where("target <> ':'").withColumn("cluster_start", F.lit(0))
    top = bursts.top_values(named, ["event_type"], "target", most)
    return top.groupBy("event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]), ", ").alias("top_targets"))


def triage(spark: SparkSession, root: str, out: str, severities: tuple[str, ...] = ("critical", "high", "medium", "info"), latest_us: int | None = None, overwrite: bool = False, max_events: int | None = None, grouped: bool = True) -> dict:
    """Events, clusters, findings and a report of a host bundle; returns the ledger. Without ``grouped`` only the events are written."""
    began = time.time()
    ledger: dict = {"root": root, "severities": list(severities)}
    try:
        paths, ledger["scan"] = files.discover(files.list_files(spark, root))
        raw = lines.read_lines(spark, paths, root)
        hits = matching.match_signatures(raw, "line", packs.HOST, severities=severities)
        timed = timed_lines(hits, latest_us=latest_us).withColumn("scope", F.lit(1))
        events = cut(timeline.sequential_ids(timed, ["scope"], ["file_ord", "line_number", "sig_ord"], F.struct("file_ord", F.floor(F.col("line_number") / 100_000))).withColumnRenamed("seq_id", "event_id"))
        if max_events is not None:
            ledger["events_truncated"] = events.limit(max_events + 1).count() > max_events
            events = events.orderBy(F.length("event_id"), "event_id").limit(max_events)  # evt_1000000 after evt_999999
        hashed = events.withColumn("event_hash", timeline.event_hash(*map(F.col, ("source_relpath", "line_number", "signature_id", "ts_raw", "event_type", "peer", "port", "line"))))
        tables.write_jsonl(hashed.drop("scope"), f"{out}/events", "events", overwrite)
        if not grouped:
            ledger["events"] = events.count()
            return ledger
        members = bursts.burst_members(events.where(F.col("event_type").isin(*packs.HOST.chatty)), KEYS, "us", 30_000_000, 60_000_000)
        clusters = bursts.burst_clusters(members, KEYS, "us").withColumn("scope", F.lit(1))
        clusters = cut(bursts.numbered(clusters, KEYS))
        named = clusters
        for value, most in (("reason", 3), ("source_relpath", 10)):
            top = bursts.top_values(members, KEYS, value, most).groupBy(*KEYS, "cluster_start").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(value).alias("v"), "n"))), lambda x: F.struct(x["v"].alias(value), x["n"].alias("n"))).alias(f"top_{value}s"))
            named = bursts.with_values(named, top, KEYS)
        tables.write_jsonl(members.select("event_id", *KEYS, "cluster_start"), f"{out}/cluster_members", overwrite=overwrite)
        tables.write_jsonl(named.drop("scope"), f"{out}/clusters", "clusters", overwrite)
        found = cut(findings.findings(events, ["scope"], "event_type", "us", packs.HOST.heuristics))
        tables.write_jsonl(found.drop("scope"), f"{out}/findings", "findings", overwrite)
        refs = findings.evidence(found, events, ["scope"], "event_type", "us", "event_id", packs.HOST.heuristics)
        shown = timeline.timeline(events, clusters, ["scope"], "us", "event_type", "severity", "event_id", packs.HOST.chatty, refs, 60_000_000, markdown.TIMELINE)
        types = events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")).join(top_targets(events), "event_type", "left")
        text = markdown.triage_report(Path(root).name, types.orderBy(F.desc("n"), "event_type").limit(markdown.TYPES).collect(), clusters.orderBy("start_us", *KEYS).limit(markdown.CLUSTERS).collect(), found.orderBy("start_us", "heuristic_id").limit(markdown.FINDINGS).collect(), shown.orderBy("place").collect())
        Path(out, "report.md").write_text(text, encoding="utf-8")
        ledger["events"] = events.count()
    except Exception as e:
        ledger["error"] = f"{type(e).__name__}: {e}"[:500]
        raise
    finally:
        ledger["seconds"] = round(time.time() - began, 1)
        tables.write_ledger(f"{out}/meta.json", ledger)
    return ledger


def store_events(raw: DataFrame, latest_us: int | None = None) -> DataFrame:
    """The events of a store's log, rated by duration: source, time, type, severity, milliseconds, key."""
    line = F.col("line")
    kinds = timed_lines(raw.withColumn("event_type", matching.first_match(line, packs.STORE)).where("event_type is not null"), latest_us=latest_us).where("us is not null")
    rated = durations.with_durations(kinds, "line").withColumn("key", F.regexp_extract(line, 'key[:=]"?([^"\\s]+)', 1))
    ms = F.round(F.col("took_s") * 1000, 6)
    return rated.withColumn("ms", ms).withColumn("severity", matching.duration_severity(F.col("event_type"), F.col("ms"), F.col("key"), F.col("took_s"), F.col("expected_s"), packs.STORE))


STORE_LOG = "ucp-kv.log"
#: The columns of a table of store events.
EVENT_COLUMNS = ("ts", "severity", "kind", "primary_duration", "primary_duration_src", "took", "expected", "duration", "time_spent", "exceeded", "retry_timeout", "key", "msg")


def event_table(events: DataFrame) -> DataFrame:
    """Store events as the rows of their table, beside the source: texts of all duration fields and which of them stands for the event."""
    texts = events.select("*", *[durations.field(F.col("line"), n).alias(f"__{n}") for n in durations.FIELDS])
    first = lambda value: F.coalesce(*[F.when(durations.seconds(F.col(f"__{n}")).isNotNull(), value(n)) for n in durations.PRIMARY])
    message = F.coalesce(F.nullif(F.regexp_extract("line", r'"msg"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit("")), F.col("line"))
    return texts.select("source_relpath", iso_of(F.col("us")).alias("ts"), "severity", F.col("event_type").alias("kind"), first(lambda n: F.col(f"__{n}")).alias("primary_duration"), first(F.lit).alias("primary_duration_src"), *[F.col(f"__{n}").alias(n) for n in ("took", "expected", "duration", "time_spent", "exceeded", "retry_timeout")], "key", message.alias("msg"))


def with_storms(base: DataFrame, rules: tuple = packs.STORE.storms) -> DataFrame:
    """Rated events and, for each rule, the storms of its type; the events are read once, each with the rule of its type.

    Rules of one window and count are found together.
    """
    frames_: dict[tuple[int, int], list] = {}
    for rule in rules:
        frames_.setdefault((rule.window_s, rule.count), []).append(rule)
    out = base
    for (window_s, count), own in frames_.items():
        label = F.create_map(*[F.lit(x) for r in own for x in (r.event_type, r.severity)])
        found = frames.storms(base.where(F.col("event_type").isin(*[r.event_type for r in own])), ["source_relpath", "event_type"], "us", "line_number", window_s * 1_000_000, count)
        out = out.unionByName(found.select("source_relpath", "line_number", "us", F.concat(F.lit("storm_"), "event_type").alias("event_type"), F.try_element_at(label, F.col("event_type")).alias("severity"), F.lit(None).cast("double").alias("ms"), "key", F.concat(F.lit("storm: "), F.col("storm_count").cast("string"), F.lit(" events since "), F.col("window_start_us").cast("string")).alias("line")))
    return out


def incident_table(windows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each window: extent, severities, counts by kind, greatest durations by kind, narrative, first signal of each kind."""
    ends = [*keys, "window"]
    kinds = windows.groupBy(*ends, "event_type").agg(F.count("*").alias("n"), F.max("ms").alias("ms"), F.min(F.struct("us", "line_number")).alias("first"))
    entry = lambda value, when=None: F.map_from_entries(F.sort_array(F.filter(F.collect_list(F.struct("event_type", value)), when or (lambda e: F.lit(True)))))
    told = kinds.groupBy(*ends).agg(entry(F.col("n").alias("v")).alias("event_counts"), entry(F.round("ms", 6).alias("v"), lambda e: e["v"] > 0).alias("max_duration_ms_by_kind"), F.sort_array(F.collect_list(F.struct("first.us", "event_type", "first.line_number"))).alias("signals_first"), F.collect_set(F.when(~F.col("event_type").startswith("storm_"), F.col("event_type"))).alias("__kinds"))
    rolled = incidents.rollup(windows, keys, "us", "severity")
    return rolled.join(told, ends).withColumn("duration_ms", F.floor((F.col("end_us") - F.col("start_us")) / 1000)).withColumn("narrative", incidents.narrative(F.col("__kinds"))).drop("__kinds")


def store_incidents(spark: SparkSession, root: str, out: str, levels: list[int] = [1, 2, 3, 4], time_range: tuple[int, int] | None = None, days: tuple[str, int] | None = None, overwrite: bool = False) -> DataFrame:  # noqa: B006
    """Events with storms, and incident windows, of every store log below a folder; the windows are returned.

    Storms are found on the events of the time range whatever their severity; windows are cut after the level filter.
    ``days`` is a date and the days around it. Written are the table of events (13 columns for each source), the
    incidents and their totals.
    """
    files_ = files.list_files(spark, root, STORE_LOG)
    if files_.limit(1).count() == 0:
        raise files.ScanError("NO_FILES_MATCHED")
    events = store_events(lines.lines_of(files_))
    if time_range:
        events = filters.time_range(events, "us", *time_range)
    if days:
        events = filters.date_window(events, "us", *days)
    base = cut(events.select("source_relpath", "line_number", "us", "event_type", "severity", "ms", "key", "line"))
    both = with_storms(base)
    if time_range:  # storms are checked once more, as events are
        both = filters.time_range(both, "us", *time_range)
    kept = cut(filters.by_level(both, "severity", levels))
    tables.write_csv(event_table(kept), f"{out}/events", overwrite=overwrite, by=["source_relpath"])
    windows = incidents.with_windows(kept, ["source_relpath"], "us", 120_000_000)
    rolled = cut(incident_table(windows, ["source_relpath"]))
    tables.write_jsonl(rolled, f"{out}/incidents", "incidents", overwrite)
    tables.write_jsonl(incidents.totals(rolled, ["source_relpath"]), f"{out}/totals", overwrite=overwrite)
    return rolled


def scan_patterns(spark: SparkSession, root: str, patterns: tuple[str, ...] = packs.PATTERNS, center: str | None = None, days: int = 0) -> DataFrame:
    """(pattern, n) over all text files of a folder, zero-filled; only lines of the days around ``center`` if it is given."""
    return matching.with_zeros(_pattern_counts(spark, root, patterns, center, days), patterns)


def _pattern_counts(spark: SparkSession, root: str, patterns: tuple[str, ...], center: str | None, days: int) -> DataFrame:
    listed = files.list_files(spark, root).where(files.is_text(F.col("relpath")))
    if listed.limit(1).count() == 0:
        raise files.ScanError("NO_FILES_MATCHED")
    rows = lines.lines_of(listed)
    day = filters.day_key(F.col("line"), center, days) if center else None
    if day is not None:
        rows = rows.where(day.isNotNull())
    return matching.count_patterns(rows, "source_relpath", "line_number", "line", patterns, day, numbers=True)


def scan_report(spark: SparkSession, root: str, out: str, patterns: tuple[str, ...] = packs.PATTERNS, center: str | None = None, days: int = 0, overwrite: bool = False) -> DataFrame:
    """The report of a pattern scan: (pattern, n, date_breakdown) as JSON lines, the hits of each file with its first and last line, and a summary.

    Each date of the window is in the breakdown of each pattern, with 0 where it has no hit.
    """
    counts = cut(_pattern_counts(spark, root, patterns, center, days))
    totals = matching.with_zeros(counts, patterns)
    if center:
        totals = totals.join(matching.with_day_zeros(counts, patterns, filters.days_around(center, days)).groupBy("pattern").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("day", "n")))).alias("date_breakdown")), "pattern")
    totals = cut(totals)
    tables.write_jsonl(totals, f"{out}/patterns", overwrite=overwrite, one_file=True)
    by_file = counts.groupBy("pattern", "path").agg(F.sum("n").alias("n"), F.min_by("first_line", "first_number").alias("first_line"), F.max_by("last_line", "last_number").alias("last_line"), F.map_from_entries(F.sort_array(F.filter(F.collect_list(F.struct("day", "n")), lambda e: e["day"].isNotNull()))).alias("date_counts"))
    tables.write_jsonl(by_file, f"{out}/files", overwrite=overwrite)
    expired = filters.expired_certificates(lines.lines_of(files.list_files(spark, root, "certdump.txt")), "line")
    tables.write_jsonl(expired, f"{out}/expired_certificates", overwrite=overwrite)
    rows = totals.collect()  # one for each pattern
    Path(out, "summary.md").write_text(markdown.pattern_summary(Path(root).name, [r.asDict() for r in rows]), encoding="utf-8")
    return totals


def redact_tree(spark: SparkSession, root: str, out: str, nodes: str | None = None, overwrite: bool = True) -> DataFrame:
    """A copy of a folder with consistent pseudonyms in texts and paths; (entity, n) of the replacements.

    Hosts, addresses, clusters and node ids come from ``nodes``, a ``;`` table of an inventory (HOSTNAME, IP,
    CLUSTER-ID, NODE-ID), and from the node records in ``ucp-nodes.txt`` below the folder; mail and machine addresses,
    digests and ids of containers are found in the texts. All of them are replaced in texts and in paths. Files that
    are no text are copied. Two files that would get one name, whatever its case, are an error before anything is
    written. Written are the tree, the mapping, the table of nodes with its cells replaced, the changed files with
    their counts, and a report as JSON, markdown and HTML.
    """
    listed = files.list_files(spark, root).withColumn("is_text", files.is_text(F.col("relpath")))
    raw = lines.lines_of(listed.where("is_text"))
    seeded = [redact.seeds(inventory.node_records(files.list_files(spark, root, "ucp-nodes.txt")), "hostname", "address", "cluster_id", "node_id")]
    table_ = lines.read_semicolon_csv(spark, nodes) if nodes else None
    if table_ is not None:
        cells = {c.upper().strip(): c for c in table_.columns}
        column = lambda *names: next((F.col(f"`{cells[n]}`") for n in names if n in cells), F.lit(None).cast("string"))
        named = table_.select(column("HOSTNAME").alias("hostname"), F.regexp_extract(F.coalesce(column("IP", "IP/MASK", "ADDRESS"), F.lit("")), r"^([0-9.]*)", 1).alias("address"), column("CLUSTER-ID").alias("cluster_id"), column("NODE-ID").alias("node_id"))
        seeded.append(redact.seeds(named, "hostname", "address", "cluster_id", "node_id"))
    paths = listed.select("relpath")
    found = redact.tokens(raw, "line").unionByName(redact.containers(raw, "line")).unionByName(redact.containers(paths.withColumn("p", F.concat(F.lit("/"), "relpath")), "p"))
    for s in seeded:
        found = found.unionByName(s)
    mapped = cut(redact.with_short_hosts(redact.mapping(found.distinct())))
    every = (*redact.CLASSES, "host")
    targets = cut(redact.rewrite(listed.select("relpath", F.col("relpath").alias("p")), ["relpath"], "p", mapped, every, labels=True).select("relpath", F.col("redacted").alias("target"), F.col("n_replaced").alias("in_path")))
    if redact.path_collisions(targets, "target").limit(1).count():
        raise files.ScanError("PATHS_COLLIDE")
    lined = redact.rewrite(raw, ["source_relpath", "line_number"], "line", mapped, every, by_class=True, labels=True)
    rewritten = cut(lined.join(targets.withColumnRenamed("relpath", "source_relpath"), "source_relpath"))
    tables.write_tree(rewritten, "target", f"{out}/tree").write.format("noop").mode("overwrite").save()
    rest = listed.where(~F.col("is_text") | (F.col("size") == 0)).join(targets, "relpath")
    copied = cut(tables.copy_tree(rest, "target", f"{out}/tree"))
    counts = cut(rewritten.select("source_relpath", F.explode("replaced").alias("entity", "n")).groupBy("source_relpath", "entity").agg(F.sum("n").alias("n")))
    changed = tables.manifest(counts, "source_relpath").withColumnRenamed("source_relpath", "relpath")
    state = targets.join(changed, "relpath", "left").join(copied, "target", "left").join(listed.select("relpath", "is_text"), "relpath").withColumn("status", F.when(F.col("error").isNotNull(), "error").when(F.col("changes").isNotNull(), "changed").when(F.col("is_text"), "unchanged").otherwise("copied"))
    state = cut(state.select("relpath", "target", "status", "in_path", "changes", "error"))
    mode = "overwrite" if overwrite else "errorifexists"
    state.where("status = 'changed'").select(F.col("target").alias("path"), F.aggregate(F.map_values("changes"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total_replacements"), F.col("changes").alias("replacement_counts")).write.mode(mode).json(f"{out}/changed_files")
    tables.export_mapping(mapped, f"{out}/mapping", overwrite=overwrite)
    if table_ is not None:
        columns = {cells[n]: e for n, e in (("HOSTNAME", "host"), ("IP", "ip"), ("ADDRESS", "ip"), ("CLUSTER-ID", "cluster"), ("NODE-ID", "node")) if n in cells}
        tables.write_csv(redact.rewrite_columns(table_, columns, mapped), f"{out}/nodes", sep=";", overwrite=overwrite)
    totals = cut(counts.groupBy("entity").agg(F.sum("n").alias("n")))
    report = {
        "files": {r["status"]: r["n"] for r in state.groupBy("status").agg(F.count("*").alias("n")).collect()}, "renamed_paths": state.where("in_path > 0").count(),
        "seeded": {r["entity"]: r["n"] for r in mapped.groupBy("entity").agg(F.count("*").alias("n")).orderBy("entity").collect()}, "replacements_by_class": {r["entity"]: r["n"] for r in totals.orderBy("entity").collect()},
    }
    tables.write_ledger(f"{out}/report.json", report)
    Path(out, "report.md").write_text(markdown.redaction_report(report), encoding="utf-8")
    Path(out, "report.html").write_text(markdown.redaction_html([{"entity": k, "n": v} for k, v in report["replacements_by_class"].items()]), encoding="utf-8")
    return totals


def node_inventory(spark: SparkSession, path: str, facts: str | None = None, out: str | None = None, overwrite: bool = False) -> DataFrame:
    """The nodes of a cluster from JSON, in the order of a report, with what each node's ``dsinfo.txt`` below ``facts`` says.

    With ``out`` the rows are written as a ``;`` table and as JSON, and the statistics beside them.
    """
    texts = spark.read.option("wholetext", "true").text(path)
    n = inventory.parse_nodes(texts, [], "value")
    role = inventory.role(F.col("Spec.Role"), F.col("ManagerStatus").isNotNull(), F.col("ManagerStatus.Leader"))
    rows = n.select(
        F.substring("ID", 1, 10).alias("node_id"), F.col("Description.Hostname").alias("hostname"), role.alias("role"), F.col("Spec.Availability").alias("availability"), F.col("Status.State").alias("state"), F.col("Status.Addr").alias("address"),
        inventory.cpus(F.col("Description.Resources.NanoCPUs")).alias("cpus"), inventory.ram_gib(F.col("Description.Resources.MemoryBytes")).alias("ram_gib"), F.col("Description.Engine.EngineVersion").alias("engine"), inventory.swarm_time(F.col("UpdatedAt")).alias("updated"),
    )
    if facts is not None:
        told = inventory.facts(lines.lines_of(files.list_files(spark, facts, "dsinfo.txt")), ["source_relpath"], "line_number", "line", inventory.DSINFO)
        told = told.where("told_host is not null").groupBy(spelling.host_key(F.col("told_host")).alias("__host")).agg(*[F.min(c).alias(c) for c in inventory.DSINFO if c != "told_host"])
        rows = rows.withColumn("__host", spelling.host_key(F.col("hostname"))).join(told, "__host", "left").drop("__host")
    ordered = inventory.rows(rows, "role", "engine", "hostname")
    if out is not None:
        tables.write_csv(ordered.coalesce(1), f"{out}/nodes_csv", sep=";", overwrite=overwrite)
        tables.write_jsonl(ordered, f"{out}/nodes_json", overwrite=overwrite, one_file=True)
        kernels = F.collect_set("kernel") if "kernel" in rows.columns else F.array().cast("array<string>")
        stats = rows.agg(F.count("*").alias("total_nodes"), F.count_if(F.col("role").isin("leader", "manager", "BAD-Manager")).alias("managers"), F.count_if(F.col("role") == "worker").alias("workers"), F.sum("cpus").alias("vcpus"), F.sort_array(kernels).alias("kernels"))
        tables.write_jsonl(stats, f"{out}/stats", overwrite=overwrite, one_file=True)
    return ordered
