"""Node inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is read of a node's record; anything else and wrong types are ignored.
NODE = "ID string, Description struct<Hostname:string, Platform:struct<Architecture:string,OS:string>, Resources:struct<NanoCPUs:bigint,MemoryBytes:bigint>, Engine:struct<EngineVersion:string>>, Spec struct<Role:string, Availability:string, Labels:map<string,string>>, Status struct<State:string,Addr:string>, ManagerStatus struct<Leader:boolean,Reachability:string,Addr:string>, CreatedAt string, UpdatedAt string"


def parse_nodes(texts: DataFrame, keys: list[str], body: str) -> DataFrame:
    """One row for each record in JSON arrays of nodes; records without an id are left out, bad texts give none."""
    records = F.from_json(F.col(body), f"array<struct<{NODE.replace(' string', ':string').replace(' struct', ':struct').replace(' boolean', ':boolean')}>>")
    return texts.select(*keys, F.explode(records).alias("n")).where(F.trim("n.ID") != "").select(*keys, "n.*")


def node_records(files: DataFrame) -> DataFrame:
    """(hostname, address, cluster_id, node_id) of the node records in listed files with content; the cluster's id is not in them."""
    n = parse_nodes(files.select(F.col("content").cast("string").alias("body")), [], "body")
    return n.select(F.col("Description.Hostname").alias("hostname"), F.col("Status.Addr").alias("address"), F.lit(None).cast("string").alias("cluster_id"), F.col("ID").alias("node_id"))


# How a node's status file states its facts, the first line of each form.
DSINFO = {
    "told_host": r"^\s*(?:Static hostname|Hostname|hostname|Name)\s*[:=]\s*(\S+)", "told_address": r"^\s*(?:inet|IP|IP Address|Node Address)\s*[: ]\s*([0-9]{1,3}(?:\.[0-9]{1,3}){3})", "mask": r"^\s*inet\s+[0-9.]+/([0-9]{1,2})\b",
    "system": r"^\s*(?:Operating System|PRETTY_NAME)\s*[:=]\s*\"?([^\"]+?)\"?\s*$", "kernel": r"^\s*Kernel(?: Version)?\s*:\s*(.+?)\s*$", "hypervisor": r"^\s*(?:Virtualization|Hypervisor vendor)\s*:\s*(.+?)\s*$", "uptime": r"\bup\s+(.+?),\s+\d+ users?",
}


def role(spec_role: Column, has_status: Column, leader: Column) -> Column:
    """leader, manager, BAD-Manager (a manager without a manager's status) or worker."""
    return F.when(spec_role == "manager", F.when(~has_status, "BAD-Manager").when(F.coalesce(leader, F.lit(False)), "leader").otherwise("manager")).when(spec_role.isNotNull(), "worker")


def cpus(nano: Column) -> Column:
    return F.floor(nano / 1_000_000_000).cast("int")


def ram_gib(size: Column) -> Column:
    return F.round(size / (1024**3), 2)


def swarm_time(text: Column) -> Column:
    """``2024-03-01T10:00:00.123Z`` as ``2024-03-01_10:00:00``."""
    return F.replace(F.regexp_replace(text, r"\..*$", ""), F.lit("T"), F.lit("_"))


def env_value(env: Column, name: str) -> Column:
    """The value of ``NAME=value`` in an array of settings, else ``-``."""
    return F.coalesce(F.get(F.transform(F.filter(env, lambda e: e.startswith(f"{name}=")), lambda e: F.substring(e, len(name) + 2, 1_000_000)), F.lit(0)), F.lit("-"))


def rows(nodes: DataFrame, role_: str, type_: str, hostname: str) -> DataFrame:
    """The nodes in the order of a report: role, type, host name."""
    return nodes.orderBy(role_, type_, hostname)


def statistics(nodes: DataFrame, keys: list[str], type_: str, cpus_: str, ram: str, version: str) -> DataFrame:
    """Nodes, managers, workers, CPUs, memory and distinct engine versions of each key."""
    return nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"), F.count_if(F.col(type_) == "manager").alias("n_managers"), F.count_if(F.col(type_) == "worker").alias("n_workers"), F.sum(cpus_).cast("bigint").alias("cpus"), F.round(F.sum(F.col(ram).cast("decimal(20,6)")), 2).cast("double").alias("ram_gib"), F.array_join(F.sort_array(F.collect_set(version)), ",").alias("versions"))


def sections(lines: DataFrame, keys: list[str], number: str, line: str, begins: str, start: str, wanted: str) -> DataFrame:
    """(keys, section, found): whether ``wanted`` stands in a section between a line ``start`` and the next blank line.

    A line that begins with ``begins`` opens a section; its rest is the section's name.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(number)
    opened = lines.withColumn("section", F.last(F.when(F.col(line).startswith(begins), F.trim(F.expr(f"substr({line}, {len(begins) + 1})"))), ignorenulls=True).over(w))
    inner = W.partitionBy(*keys, "section").orderBy(number)
    flagged = opened.where("section is not null").withColumn("at", F.last(F.when(F.trim(line) == start, F.col(number)), ignorenulls=True).over(inner)).withColumn("blank", F.last(F.when(F.trim(line) == "", F.col(number)), ignorenulls=True).over(inner))
    hit = F.contains(F.col(line), F.lit(wanted)) & F.col("at").isNotNull() & (F.col("blank").isNull() | (F.col("blank") < F.col("at")))
    return flagged.groupBy(*keys, "section").agg(F.bool_or(hit).alias("found"))


def facts(lines: DataFrame, keys: list[str], number: str, line: str, patterns: dict[str, str]) -> DataFrame:
    """(keys, one column for each fact): the first group of the first line of each key that a fact's pattern matches.

    One aggregation with map-side combine gives all facts, such as host name, address, system and uptime of a node.
    """
    found = {n: F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for n, p in patterns.items()}
    return lines.groupBy(*keys).agg(*[F.min_by(v, F.when(v.isNotNull(), F.col(number))).alias(n) for n, v in found.items()])


def keyword_bucket(pattern: Column) -> Column:
    """What a pattern is about, of control-plane matters: store, leadership, election, clock; else null."""
    low = F.lower(pattern)
    return F.when(low.rlike("etcd"), "store").when(low.rlike("leader"), "leadership").when(low.rlike("election"), "election").when(low.rlike("clock|systime|time sync"), "clock")


def endpoint_hosts(endpoints: DataFrame, endpoint: str, nodes: DataFrame, address: str, hostname: str) -> DataFrame:
    """The endpoints with ``hostname``, the node whose address stands in them; of several the first by name."""
    known = nodes.where(F.col(address).isNotNull()).groupBy(F.col(address).alias("__ip")).agg(F.min(hostname).alias("hostname"))
    ip = F.regexp_extract(endpoint, r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})", 1)
    return endpoints.withColumn("__ip", ip).join(known, "__ip", "left").drop("__ip")
