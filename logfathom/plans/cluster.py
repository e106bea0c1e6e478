"""A whole run over the hosts of a store's cluster: status tables, store logs, journals and what they say together."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spelling import safe_file_name
from ..operators import incidents, inventory, journal, matching, snapshot
from ..render import markdown
from ..rules import packs
from ..session import cut
from ..sinks import tables
from ..sources import files, lines
from . import pipelines

#: Hosts, endpoints and groups shown in the report; the tables beside it have all.
SHOWN = 10
STATUS, DSINFO = "etcd-status.txt", "dsinfo.txt"


def _host(df: DataFrame, path: str = "source_relpath") -> DataFrame:
    return df.withColumn("host", F.substring_index(path, "/", 1))


def journal_signals(raw: DataFrame, latest_us: int | None = None) -> DataFrame:
    """The lines of journals that are signals: host, line, kind, us; JSON lines are flattened first."""
    plain = _host(raw).withColumn("line", journal.flatten_message(F.col("line")))
    kinds = plain.withColumn("kind", matching.first_match(F.col("line"), packs.JOURNAL)).where("kind is not null")
    return pipelines.timed_lines(kinds, latest_us=latest_us)


def cluster_incidents(spark: SparkSession, root: str, out: str, levels: list[int] = [1, 2, 3, 4], time_range: tuple[int, int] | None = None, days: tuple[str, int] | None = None, latest_us: int | None = None, overwrite: bool = False) -> DataFrame:  # noqa: B006
    """Everything that the folders of a cluster's hosts say; returns (host, ip, skipped, events, windows, leader).

    A host needs a status file or a store log; others are written with the reason. Written are, as tables of JSON
    lines: nodes, health, status, members, slow endpoints, journal groups and targets, families and the synthesis of
    the cluster; the events, incidents and totals of the store logs; and a report that shows the leader's host first.
    """
    listed = files.list_files(spark, root)
    hosts = cut(files.scan_nodes(listed))
    if hosts.where("skipped is null").limit(1).count() == 0:
        raise files.ScanError("NO_FILES_MATCHED")
    texts = _host(files.list_files(spark, root, STATUS), "relpath").select("host", F.col("content").cast("string").alias("text"))
    health, status, members = snapshot.status_tables(texts, ["host"], "text")
    health, status = cut(health), cut(status)
    leads = status.groupBy("host").agg(F.min(F.when(F.col("is_leader"), F.col("endpoint"))).alias("leader"))
    scoped = status.join(leads, "host").withColumn("cluster", F.lit(Path(root).name))
    together = cut(snapshot.synthesis(scoped, health.withColumn("cluster", F.lit(Path(root).name)), ["cluster"]))
    told = inventory.facts(lines.lines_of(files.list_files(spark, root, DSINFO)), ["source_relpath"], "line_number", "line", inventory.DSINFO)
    named = _host(told).groupBy("host").agg(F.min("told_host").alias("hostname"), F.min("told_address").alias("ip"))
    nodes = hosts.join(named, "host", "left").join(leads, "host", "left")

    signals = cut(journal_signals(lines.lines_of(listed.where(F.substring_index("relpath", "/", -1).startswith("journalctl"))), latest_us))
    groups = cut(journal.signature_groups(signals, ["host"], "kind", "line", "us"))
    if listed.where(F.substring_index("relpath", "/", -1) == pipelines.STORE_LOG).limit(1).count():
        windows = pipelines.store_incidents(spark, root, out, levels, time_range, days, overwrite)
        of_store = _host(spark.read.option("header", "true").csv(f"{out}/events")).select("host", F.col("kind").alias("event_type")).where(~F.col("event_type").startswith("storm_"))
        nodes = nodes.join(_host(windows).groupBy("host").agg(F.count("*").alias("n_windows"), F.sum("n_events").alias("n_events")), "host", "left")
    else:
        of_store = hosts.select("host", F.lit(None).cast("string").alias("event_type")).limit(0)
        nodes = nodes.withColumn("n_windows", F.lit(None).cast("bigint")).withColumn("n_events", F.lit(None).cast("bigint"))
    one = lambda df: df.withColumn("cluster", F.lit(Path(root).name))
    families = snapshot.family_counts(one(signals.withColumn("family", matching.family(F.col("kind"), packs.JOURNAL)).withColumnRenamed("kind", "event_type")), one(of_store.withColumn("family", matching.family(F.col("event_type"), packs.STORE))), ["cluster"])
    address = named.where("ip is not null")
    nodes = cut(nodes.withColumn("file_name", safe_file_name(F.coalesce("hostname", "host"))))
    endpoints = inventory.endpoint_hosts(snapshot.slowest_endpoints(health, [], "endpoint", "took_ms"), "endpoint", address, "ip", "hostname")
    for name, df in {
        "nodes": nodes, "health": health, "status": status, "members": members, "synthesis": together, "slow_endpoints": endpoints, "families": families,
        "health_metrics": snapshot.health_metrics(health, ["host"], "endpoint", "took_ms"), "raft": snapshot.raft_metrics(status, ["host"], "term", "raft_index", "applied_index", F.col("is_learner")),
        "journal_groups": groups, "journal_targets": journal.targets(signals, ["host", "kind"], "line"), "journal_samples": journal.samples(signals, ["host", "kind"], "us", "line_number"),
        "journal_kinds": signals.groupBy("host", "kind").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")),
    }.items():
        tables.write_jsonl(df, f"{out}/{name}", overwrite=overwrite)
    leader = together.select("leader").first()
    led = address.where(F.contains(F.lit(leader["leader"] if leader else ""), F.col("ip"))).select("host").limit(1).collect()
    shown = snapshot.leader_first(nodes.where("skipped is null").withColumn("__leader", F.lit(led[0]["host"] if led else None).cast("string")), "host", "__leader").limit(SHOWN).collect()
    repeated = journal.repeating(groups.withColumn("__all", F.lit(1)), ["__all"]).orderBy("place").collect()
    counts = {"nodes_total_seen": hosts.count(), "nodes_skipped": hosts.where("skipped is not null").count()}
    counts["nodes_analyzed"] = counts["nodes_total_seen"] - counts["nodes_skipped"]
    row = together.first()
    tables.write_ledger(f"{out}/bundle.json", {"bundle_root": root, "filters": {"levels": levels, "time_range": time_range, "days": days}, "counts": counts, "cluster_synthesis": row.asDict(True) if row else None})
    Path(out, "cluster.md").write_text(markdown.cluster_report(Path(root).name, row.asDict(True) if row else {}, [r.asDict() for r in shown], [r.asDict() for r in endpoints.orderBy("place").limit(SHOWN).collect()], [r.asDict() for r in repeated], counts), encoding="utf-8")
    return nodes
