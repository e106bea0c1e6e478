"""The pN_ queries of the llm subpackage: terms (1), personal data (3), runs (6), tokens (7), leaks (8), spans (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling
from ..functions.epoch import epoch_us
from ..session import table
from . import bpe, frequencies, leaks, pii, runs, spans

#: Ids in fewer records than this are rare; ids in more than this share of the records are common.
RARE_RECORDS, COMMON_SHARE = 3, 0.5


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "write_results").where("run_id is not null").select("run_id", "signatures_matched").dropDuplicates(["run_id"])
    events = table(spark, folder, "event_candidates").select("event_id", "bundle_id", "signature_id")
    matched = results.select("run_id", F.explode("signatures_matched").alias("id", "n")).select(F.lit("signatures_matched").alias("field"), F.col("id"), F.col("run_id").alias("record"), "n")
    named = events.where("signature_id is not null").dropDuplicates(["event_id"]).select(F.lit("signature_id").alias("field"), F.col("signature_id").alias("id"), F.col("bundle_id").cast("string").alias("record"), F.lit(1).cast("bigint").alias("n"))
    found = frequencies.term_frequencies(matched.unionByName(named), F.col("field"), spelling.canonical_id(F.col("id")), F.col("record"), F.col("n"))
    records = results.agg(F.count_distinct("run_id").alias("records")).withColumn("field", F.lit("signatures_matched")).unionByName(events.agg(F.count_distinct("bundle_id").alias("records")).withColumn("field", F.lit("signature_id")))
    mark = F.when(F.col("n_records") < RARE_RECORDS, "rare").when(F.col("n_records") > COMMON_SHARE * F.col("records"), "common").otherwise("useful")
    return found.join(F.broadcast(records), "field").select(F.col("field").alias("field_name"), F.col("term").alias("signature_id"), "n_total", "n_records", mark.alias("freq_mark"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "event_candidates"), [F.col("event_id")], ["message", "excerpt"])
    return found.select("event_id", F.inline("found")).select("event_id", "field_name", "kind", "found_text").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "timeline_events")
    fields = [spelling.canonical_type(F.col("event_type")), spelling.peer_name(F.col("peer")), F.coalesce(F.col("port"), spelling.peer_port(F.col("peer")))]
    found = runs.collapse_runs(events, F.col("source_relpath"), fields, F.col("event_id"), epoch_us(events, "ts"), F.col("line_number"))
    return found.select(F.col("entity").alias("source_relpath"), "first_event_id", "last_event_id", "n_events")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_ids(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"), table(spark, folder, "eval_items"), F.col("item_id"), F.col("text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}

SQL = {
    "p1_found": r"""
with runs as (select distinct on (run_id) run_id, signatures_matched from write_results),
evs as (select distinct on (event_id) event_id, bundle_id, signature_id from event_candidates),
m as (
  select 'signatures_matched' as field_name, lower(trim(e.key, E' \t\r\n')) as id, run_id as record, e.value as n
  from (select run_id, unnest(map_entries(signatures_matched)) as e from runs) where e.value > 0
  union all
  select 'signature_id', lower(trim(signature_id, E' \t\r\n')), cast(bundle_id as varchar), 1 from evs where signature_id is not null),
c as (select field_name, id, cast(sum(n) as bigint) as n_total, count(distinct record) as n_records from m where id <> '' group by 1, 2),
r as (select 'signatures_matched' as field_name, count(distinct run_id) as records from write_results
  union all select 'signature_id', count(distinct bundle_id) from event_candidates)
select c.field_name, id as signature_id, n_total, n_records,
       case when n_records < 3 then 'rare' when n_records > 0.5 * records then 'common' else 'useful' end as freq_mark
from c join r using (field_name)
""",
    "p6_found": r"""
with rows as (
  select distinct source_relpath, event_id, ts, line_number, lower(regexp_replace(event_type, '[^a-zA-Z0-9]+', '', 'g')) as kind,
         nullif(regexp_extract(peer, '(\d{1,3}(?:\.\d{1,3}){3})', 1), '') as machine,
         coalesce(port, try_cast(regexp_extract(peer, '\d{1,3}(?:\.\d{1,3}){3}\]?:(\d+)', 1) as integer)) as at_port
  from timeline_events where ts is not null),
marked as (
  select *, case when lag(event_id) over w is not null and kind is not distinct from lag(kind) over w and machine is not distinct from lag(machine) over w
                  and at_port is not distinct from lag(at_port) over w then 0 else 1 end as fresh
  from rows window w as (partition by source_relpath order by ts, line_number)),
chained as (select *, sum(fresh) over (partition by source_relpath order by ts, line_number rows unbounded preceding) as chain from marked)
select source_relpath, arg_min(event_id, (ts, line_number)) as first_event_id, arg_max(event_id, (ts, line_number)) as last_event_id, count(*) as n_events
from chained group by source_relpath, chain having count(*) > 1
""",
    "p8_found": r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items where text is not null),
dg as (select doc_id, array_to_string(w[k : k + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)),
ig as (select distinct item_id, array_to_string(w[k : k + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i))
select distinct doc_id, item_id from dg join ig using (g)
""",
    "p9_found": """
with w as (select doc_id, k, md5(substr(text, k, 300)) as h from (select doc_id, text, unnest(range(1, length(text) - 298)) as k from documents where text is not null)),
s as (select h from w group by h having min(doc_id) <> max(doc_id)),
p as (select doc_id, k, lag(k) over (partition by doc_id order by k) as before from w where h in (select h from s))
select doc_id, cast(sum(least(300, coalesce(k - before, 300))) as bigint) as shared_chars from p group by doc_id
""",
}
