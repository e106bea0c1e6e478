"""The pN_ queries of the core: time stamps (2), sessions (4) and log entries (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling
from ..functions.epoch import epoch_us
from ..operators.loglines import log_entries
from ..operators.sessions import merge_sessions
from ..operators.timestamps import normalise_times
from ..session import small, table

SESSION_GAP_US = 1_800_000_000


def host_of(relpath):
    """The host directory of ``bundle-<id>/<host>/<file>`` in the spelling of the table of nodes."""
    return F.substring_index(F.lower(F.get(F.split(relpath, "/"), 1)), ".", 1)


def collection_times(spark: SparkSession, folder: str) -> DataFrame:
    bundles = table(spark, folder, "bundles").groupBy("bundle_id").agg(F.max("collected_at").alias("at"))
    return bundles.select("bundle_id", epoch_us(bundles, "at").alias("collected_us"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "nodes").select(F.substring_index(F.lower(F.trim("hostname")), ".", 1).alias("host"), "tz")
    hosts = nodes.where("host is not null").groupBy("host").agg(F.min("tz").alias("tz"), F.max("tz").alias("other")).select("host", F.when(F.col("tz") == F.col("other"), F.col("tz")).alias("tz"))
    collected = collection_times(spark, folder)
    path = F.col("source_relpath")
    events = table(spark, folder, "event_candidates").select("event_id", "bundle_id", F.coalesce("ts_raw", "ts").alias("text"), host_of(path).alias("host"), F.concat_ws("/", host_of(path), F.regexp_replace(path, r"^[^/]*/[^/]*/", "")).alias("source"))
    events = events.dropDuplicates(["event_id"]).join(small(hosts), "host", "left").join(small(collected), "bundle_id", "left")
    return normalise_times(events, "text", "source", "tz", "collected_us").where("time_status = 'ok'").select("event_id", F.col("time_us").alias("us"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "timeline_events")
    sessions = merge_sessions(events, spelling.peer_ipv4(F.col("peer")), epoch_us(events, "ts"), spelling.canonical_type(F.col("event_type")), [F.col("event_id"), F.col("source_relpath"), F.col("line_number")], SESSION_GAP_US)
    return sessions.withColumnRenamed("key", "peer")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("source_relpath")
    lines = table(spark, folder, "bundle_lines").withColumn("__bundle", F.regexp_extract(path, r"^bundle-0*(\d+)/", 1).try_cast("bigint"))
    joined = lines.join(small(collection_times(spark, folder).withColumnRenamed("bundle_id", "__bundle").withColumnRenamed("collected_us", "__latest")), "__bundle", "left")
    return log_entries(joined, path, F.col("line_number"), F.col("line"), F.col("__latest")).withColumnRenamed("path", "source_relpath")


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found}

SQL = {
    "p4_found": r"""
with rows as (
  select distinct nullif(regexp_extract(peer, '(\d{1,3}(?:\.\d{1,3}){3})', 1), '') as peer, epoch_us(ts) as us,
         nullif(lower(regexp_replace(event_type, '[^a-zA-Z0-9]+', '', 'g')), '') as kind, event_id, source_relpath, line_number
  from timeline_events where ts is not null),
marked as (
  select *, case when us - lag(us) over (partition by peer order by us) <= 1800000000 then 0 else 1 end as opens
  from rows where peer is not null),
numbered as (select *, sum(opens) over (partition by peer order by us) as s from marked)
select peer, min(us) as start_us, max(us) as end_us, count(*) as n_events, count(distinct kind) as n_types
from numbered group by peer, s
"""
}
