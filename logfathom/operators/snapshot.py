"""Status tables of a key-value store cluster and rollups over its nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.durations import to_ms

#: Latency in milliseconds above which an endpoint is slow; lag of the applied index that is concerning.
SLOW_MS, CONCERNING_DRIFT = 110.0, 100


def table_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, section, row, cells map<string,string>): the rows of ``|``-ruled tables.

    A header row, with ENDPOINT in it, begins a section; its cells in lower case with underscores name those of the rows below.
    Rows with another number of cells are dropped. Each text is one row, so nothing is shuffled.
    """
    lines = F.filter(F.transform(F.split(F.col(text), r"\r?\n"), lambda c: F.trim(c)), lambda x: x.startswith("|") & x.endswith("|"))
    cells = F.transform(lines, lambda x: F.transform(F.filter(F.split(x, r"\|"), lambda c, i: (i > 0)), lambda c: F.trim(c)))
    cells = F.transform(cells, lambda c: F.slice(c, 1, F.size(c) - 1))
    exploded = texts.select(*keys, F.posexplode(cells).alias("row", "cells"))
    is_header = F.exists("cells", lambda c: F.upper(c) == "ENDPOINT")
    w = W.partitionBy(*keys).orderBy("row")
    named = exploded.withColumn("head", is_header).withColumn("section", F.sum(F.col("head").cast("int")).over(w)).withColumn("names", F.last(F.when(F.col("head"), F.transform("cells", lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_")))), ignorenulls=True).over(w))
    return named.where(~F.col("head") & (F.size("cells") == F.size("names"))).select(*keys, "section", "row", F.map_from_arrays("names", "cells").alias("cells"))


def health_line(line: Column) -> Column:
    """(endpoint, healthy, took_ms) of ``<endpoint> is healthy: successfully committed proposal: took = 1.2ms``."""
    p = r"(\S+) is (healthy|unhealthy)(?:.*took = ([0-9.]+)(ns|us|µs|ms|s|m))?"
    value, unit = F.nullif(F.regexp_extract(line, p, 3), F.lit("")).try_cast("double"), F.regexp_extract(line, p, 4)
    return F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, 1).alias("endpoint"), (F.regexp_extract(line, p, 2) == "healthy").alias("healthy"), to_ms(value, unit).alias("took_ms")))


def member_line(line: Column) -> Column:
    """(id, status, name, peer_urls, client_urls, is_leader, learner) of a member list line; other lines give null.

    Three forms: cells between commas, ``member <id> name=... peerURLs=...`` and ``<id>: name=... peerURLs=...``. A
    line of a name and a colon without any of these fields is no member.
    """
    parts = F.split(line, r",\s*")
    cells = (F.size(parts) >= 5) & F.get(parts, 0).rlike("^[0-9a-f]{8,16}$")
    urls = lambda c: F.split(F.nullif(c, F.lit("")), ",")
    value = lambda name: F.nullif(F.regexp_extract(line, rf"\b{name}\s*=\s*(\S+)", 1), F.lit(""))
    named = line.rlike(r"^\s*(?:(?i:member)\s+\S+\s|[^:\s]+\s*:\s).*\b(?:name|peerURLs|clientURLs)\s*=")
    by_cells = F.struct(F.get(parts, 0).alias("id"), F.get(parts, 1).alias("status"), F.get(parts, 2).alias("name"), urls(F.get(parts, 3)).alias("peer_urls"), urls(F.get(parts, 4)).alias("client_urls"), F.lit(None).cast("boolean").alias("is_leader"), (F.get(parts, 5) == "true").alias("learner"))
    id_ = F.coalesce(F.nullif(F.regexp_extract(line, r"^\s*(?i:member)\s+(\S+)\s", 1), F.lit("")), F.regexp_extract(line, r"^\s*([^:\s]+)\s*:", 1))
    by_name = F.struct(id_.alias("id"), F.lit(None).cast("string").alias("status"), value("name").alias("name"), urls(value("peerURLs")).alias("peer_urls"), urls(value("clientURLs")).alias("client_urls"), (F.lower(value("isLeader")) == "true").alias("is_leader"), (F.lower(value("isLearner")) == "true").alias("learner"))
    return F.when(cells, by_cells).when(named, by_name)


def took_ms(text: Column) -> Column:
    """Milliseconds of a cell such as ``1.2ms`` or ``300µs``; null for anything else."""
    form = r"^([0-9]+(?:\.[0-9]+)?)\s*(ns|us|µs|ms|s|m)\s*$"
    return to_ms(F.nullif(F.regexp_extract(text, form, 1), F.lit("")).try_cast("double"), F.regexp_extract(text, form, 2))


def status_tables(files: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(health, status, members) of status files, one row for each line or table row of the kind.

    health (keys, endpoint, healthy, took_ms, error) comes from narrative lines and from tables with HEALTH and TOOK;
    status (keys, endpoint, is_leader, is_learner, term, raft_index, applied_index) from tables with IS LEADER; members
    as ``member_line``. Cells that are no number give null.
    """
    rows = table_rows(files, keys, text)
    cell = lambda name: F.try_element_at("cells", F.lit(name))
    tabled = rows.where(cell("health").isNotNull() & (cell("endpoint") != "")).select(*keys, cell("endpoint").alias("endpoint"), F.lower(cell("health")).isin("true", "healthy").alias("healthy"), took_ms(cell("took")).alias("took_ms"), F.nullif(cell("error"), F.lit("")).alias("error"))
    lines = files.select(*keys, F.explode(F.split(F.col(text), r"\r?\n")).alias("line"))
    told = lines.select(*keys, health_line(F.col("line")).alias("h")).where("h is not null").select(*keys, "h.endpoint", "h.healthy", "h.took_ms", F.lit(None).cast("string").alias("error"))
    number = lambda name: cell(name).try_cast("bigint")
    status = rows.where(cell("is_leader").isNotNull() & (cell("endpoint") != "")).select(*keys, cell("endpoint").alias("endpoint"), (F.lower(cell("is_leader")) == "true").alias("is_leader"), (F.lower(cell("is_learner")) == "true").alias("is_learner"), number("raft_term").alias("term"), number("raft_index").alias("raft_index"), number("raft_applied_index").alias("applied_index"))
    members = lines.select(*keys, member_line(F.col("line")).alias("m")).where("m is not null").select(*keys, "m.*")
    return tabled.unionByName(told), status, members


def health_metrics(health: DataFrame, keys: list[str], endpoint: str, ms: str, slow_ms: float = SLOW_MS) -> DataFrame:
    """Least and greatest latency, their difference and ratio, and the slow endpoints of each key; nulls are left out."""
    order = F.when(F.col(ms).isNotNull(), F.struct(F.col(ms), F.col(endpoint)))
    return health.groupBy(*keys).agg(
        F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.round(F.max(ms) - F.min(ms), 6).alias("skew_ms"), F.round(F.max(ms) / F.nullif(F.min(ms), F.lit(0.0)), 6).alias("ratio"), F.min_by(endpoint, order).alias("fastest"), F.max_by(endpoint, order).alias("slowest"), F.count_if(F.col(ms) > slow_ms).alias("n_slow")
    )


def raft_metrics(status: DataFrame, keys: list[str], term: str, index: str, applied: str, learner: Column) -> DataFrame:
    """Terms, drift of the raft and applied index, members and learners of each key."""
    drift = F.max(index) - F.min(index)
    return status.groupBy(*keys).agg(F.count_distinct(term).alias("n_terms"), drift.alias("index_drift"), (F.max(applied) - F.min(applied)).alias("applied_drift"), F.count("*").alias("n_members"), F.count_if(learner).alias("n_learners"), (drift >= CONCERNING_DRIFT).alias("concerning"))


def leader_vote(votes: DataFrame, keys: list[str], leader: str) -> DataFrame:
    """The leader that most nodes of each key name, of equal votes the first by name, and whether all agree."""
    known = F.coalesce(F.col(leader), F.lit("unknown"))
    counted = votes.groupBy(*keys, known.alias("leader")).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min_by("leader", F.struct(-F.col("n"), F.col("leader"))).alias("leader"), F.max("n").alias("n_votes"), (F.count("*") == 1).alias("stable"))


def slow_endpoints(seen: DataFrame, keys: list[str], endpoint: str, ms: str, slow_ms: float = SLOW_MS) -> DataFrame:
    """How often each endpoint was seen and slow; significant from a third on, sustained if always."""
    stats = seen.groupBy(*keys, endpoint).agg(F.count("*").alias("n_seen"), F.count_if(F.col(ms) > slow_ms).alias("n_slow"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))
    return stats.where("n_slow > 0").withColumn("significant", F.col("n_slow") * 3 >= F.col("n_seen")).withColumn("pattern", F.when(F.col("n_slow") < F.col("n_seen"), "intermittent").otherwise("sustained"))


def family_counts(journal: DataFrame, store: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, family, n): journal signals count each time, store types once in the scope whatever the node.

    Both have (scope, event_type, family); timing of the store's disk is reported as disk timing.
    """
    a = journal.where("family is not null").groupBy(*scope, "family").agg(F.count("*").alias("n"))
    b = store.where("family is not null").select(*scope, "event_type", "family").distinct().groupBy(*scope, "family").agg(F.count("*").alias("n"))
    named = F.when(F.col("family") == "storage_timing", "disk_timing").otherwise(F.col("family"))
    return a.unionByName(b).withColumn("family", named).groupBy(*scope, "family").agg(F.sum("n").alias("n"))


def topology_risk(n_hosts: Column, n_endpoints: Column) -> Column:
    """What the number of voters allows: none may fail below three, an even number adds nothing."""
    n = F.least(n_hosts, n_endpoints)
    return F.when(n < 3, "no failure tolerated").when(n % 2 == 0, "even number of voters").otherwise("ok")


def synthesis(status: DataFrame, health: DataFrame, scope: list[str]) -> DataFrame:
    """One row for each scope: terms, drifts, members, leader and its votes, latencies, slow endpoints and risk.

    ``status`` has (scope, host, endpoint, term, raft_index, applied_index, is_learner, leader), ``health`` (scope, endpoint, took_ms).
    """
    raft = raft_metrics(status, scope, "term", "raft_index", "applied_index", F.col("is_learner"))
    vote = leader_vote(status, scope, "leader")
    latency = health_metrics(health, scope, "endpoint", "took_ms")
    slow = slow_endpoints(health, scope, "endpoint", "took_ms").groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("endpoint", "n_slow", "n_seen", "significant", "pattern"))).alias("slow_endpoints"))
    voters = status.groupBy(*scope).agg(F.count_distinct("host").alias("n_hosts"), F.count_distinct("endpoint").alias("n_endpoints")).withColumn("risk", topology_risk(F.col("n_hosts"), F.col("n_endpoints")))
    return raft.join(vote, scope, "left").join(latency, scope, "left").join(slow, scope, "left").join(voters, scope, "left")


def slowest_endpoints(seen: DataFrame, keys: list[str], endpoint: str, ms: str, most: int | None = None, slow_ms: float = SLOW_MS) -> DataFrame:
    """The slow endpoints of each key by their greatest latency, of equal ones by name, with ``place``; all or the first ``most``."""
    ranked = slow_endpoints(seen, keys, endpoint, ms, slow_ms).withColumn("place", F.row_number().over(W.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("max_ms"), endpoint)))
    return ranked if most is None else ranked.where(F.col("place") <= most)


def leader_first(rows: DataFrame, host: str, leader: str) -> DataFrame:
    """Rows in the order of a report: the leader's host, then the others by name."""
    return rows.orderBy(F.coalesce(F.col(host) != F.col(leader), F.lit(True)), host)
