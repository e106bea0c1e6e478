"""Queries over the operators of bundle triage, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import durations, payload, severity, spelling
from ..functions import text as T
from ..functions.epoch import epoch_us
from ..operators import bursts, filters, findings, frames, incidents, inventory, journal, matching, redact, snapshot, timeline
from ..rules import packs
from ..session import table

MINUTE, HOUR = 60_000_000, 3_600_000_000


def timeline_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events once each, with types, machines and ports in one spelling."""
    t = table(spark, folder, "timeline_events")
    peer = F.col("peer")
    return t.select(
        "event_id", "bundle_id", spelling.snake_type(F.col("event_type")).alias("event_type"), "severity", "confidence", epoch_us(t, "ts").alias("us"), "source_relpath", "line_number",
        spelling.peer_ipv4(peer).alias("peer"), F.coalesce(F.col("port"), spelling.peer_port(peer)).alias("port"), "reason", "message",
    ).distinct()


def candidate_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "event_candidates").select("event_id", "bundle_id", "source_relpath", "line_number", "message").distinct()


def bundle_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "bundle_lines").select("source_relpath", "file_ord", "line_number", "line").distinct()


TE = r"""te as (
  select distinct event_id, bundle_id, lower(regexp_replace(regexp_replace(trim(event_type, E' \t\r\n'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[ -]+', '_', 'g')) as event_type,
         severity, confidence, epoch_us(ts) as us, source_relpath, line_number, nullif(regexp_extract(peer, '(\d{1,3}(?:\.\d{1,3}){3})', 1), '') as peer,
         coalesce(port, try_cast(regexp_extract(peer, '\d{1,3}(?:\.\d{1,3}){3}\]?:(\d+)', 1) as integer)) as port, reason, message
  from timeline_events)"""
EC = "ec as (select distinct event_id, bundle_id, source_relpath, line_number, message from event_candidates)"
BL = "bl as (select distinct source_relpath, file_ord, line_number, line from bundle_lines)"
RANK = "case lower(trim({0})) when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 0 end"
LABEL = "case {0} when 0 then 'info' when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'critical' end"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _any(column: str, patterns, flag: str = "") -> str:
    return "(" + " or ".join(f"regexp_matches({column}, '{_q(p if p.startswith('(?i)') else flag + p)}')" for p in patterns) + ")"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {BL} select source_relpath, count(*) as n_lines, cast(sum(strlen(line)) as bigint) as n_bytes, min(line_number) as first_line, max(line_number) as last_line from bl group by 1")
def q01_line_scan(spark, folder):
    return bundle_lines(spark, folder).groupBy("source_relpath").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).cast("bigint").alias("n_bytes"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"))


_WORDS = ("timed out", "no space left on device", "[Ee]rror", "lost", "expired", "never said")


@query(f"with {BL}, p as (select unnest([{', '.join(repr(p) for p in _WORDS)}]) as pattern) select pattern, count(bl.line) as n from p left join bl on regexp_matches(bl.line, pattern) group by 1")
def q02_pattern_totals_zero_filled(spark, folder):
    return matching.with_zeros(matching.count_patterns(bundle_lines(spark, folder), "source_relpath", "line_number", "line", _WORDS), _WORDS)


@query(f"with {EC} " + " union all ".join(f"select '{_q(p)}' as pattern, source_relpath as path, cast(null as varchar) as day, count(*) as n, arg_min(message, (line_number, message)) as first_line, arg_max(message, (line_number, message)) as last_line from ec where regexp_matches(message, '{_q(p)}') group by source_relpath" for p in packs.PATTERNS))
def q03_pattern_counts(spark, folder):
    lines = candidate_lines(spark, folder).withColumn("order", F.struct("line_number", "message"))
    return matching.count_patterns(lines, "source_relpath", "order", "message", packs.PATTERNS)


_CLASS_SQL = "case " + " ".join(f"when {_any('message', s.patterns, '(?i)')} then '{s.event_type}'" for s in packs.STORE.signatures) + " end"
_BASE_SQL = "case kind " + " ".join(f"when '{s.event_type}' then '{s.severity}'" for s in packs.STORE.signatures) + " else 'info' end"


@query(f"with {EC}, k as (select event_id, {_CLASS_SQL} as kind from ec) select event_id, kind, {_BASE_SQL} as severity from k where kind is not null")
def q04_first_match_classify(spark, folder):
    kind = matching.first_match(F.col("message"), packs.STORE)
    rows = candidate_lines(spark, folder).select("event_id", kind.alias("kind")).where("kind is not null")
    return rows.select("event_id", "kind", matching.base_severity(F.col("kind"), packs.STORE).alias("severity"))


_JSQL = "case " + " ".join(f"when {_any('message', s.patterns, '(?i)')} then " + (f"case when {_any('message', [s.also], '(?i)')} then '{s.event_type}' end" if s.also else f"'{s.event_type}'") for s in packs.JOURNAL.signatures) + " end"


@query(f"with {EC}, k as (select bundle_id, {_JSQL} as kind, message from ec) select bundle_id, kind, count(*) as n from k where kind is not null group by 1, 2")
def q05_journal_signals(spark, folder):
    rows = candidate_lines(spark, folder).select("bundle_id", matching.first_match(F.col("message"), packs.JOURNAL).alias("kind"))
    return rows.where("kind is not null").groupBy("bundle_id", "kind").agg(F.count("*").alias("n"))


_HITS = "list_filter([" + ", ".join(f"case when {_any('m', s.patterns)} then {k} end" for k, s in enumerate(packs.HOST.signatures)) + "], lambda x: x is not null)[1:3]"
_IDS, _SEVS = (", ".join(f"'{getattr(s, a)}'" for s in packs.HOST.signatures) for a in ("id", "severity"))
_CAPS = {c: "case sig " + " ".join(f"when {k} then nullif(regexp_extract(m, '{_q(dict(s.captures)[c])}', 1), '')" for k, s in enumerate(packs.HOST.signatures) if c in dict(s.captures)) + " end" for c in ("peer", "port", "reason")}


@query(
    f"with {EC}, h as (select event_id, trim(message) as m, unnest({_HITS.replace('m,', 'trim(message),')}) as sig from ec), s as (select *, [{_IDS}][sig + 1] as signature_id, [{_SEVS}][sig + 1] as severity from h) "
    f"select event_id, signature_id, severity, {_CAPS['peer']} as peer, try_cast({_CAPS['port']} as integer) as port, {_CAPS['reason']} as reason from s where severity in ('critical', 'high')"
)
def q06_signature_match_cap(spark, folder):
    found = matching.match_signatures(candidate_lines(spark, folder), "message", packs.HOST, severities=("critical", "high"))
    return found.select("event_id", "signature_id", "severity", "peer", "port", "reason")


@query(f"with {BL}, d as (select source_relpath, regexp_extract(line, '(2024-03-0[1-9]|2024-03-1[0-9])', 1) as day from bl) select source_relpath, day, count(*) as n from d where day <> '' group by 1, 2")
def q07_date_window_filter(spark, folder):
    days = filters.day_key(F.col("line"), "2024-03-10", 9)
    return bundle_lines(spark, folder).select("source_relpath", days.alias("day")).where("day is not null").groupBy("source_relpath", "day").agg(F.count("*").alias("n"))


_DUR = {n: f"""coalesce(nullif(regexp_extract(message, '(?i)(?:^|[,{{\\s"]){j}"\\s*:\\s*"([^"]+)"', 1), ''), nullif(regexp_extract(message, '(?i)(?:^|[\\s,]){j.replace(" ", "[ _-]")}=([0-9][0-9.a-zµ]*)', 1), ''))""" for n, j in durations.FIELDS.items()}
_SEC = "case when contains({0}, 'ms') then n / 1000 when contains({0}, 'us') or contains({0}, 'µs') then n / 1000000 when contains({0}, 'ns') then n / 1000000000 when contains({0}, 's') then n end"


@query(f"with {EC}, t as (select event_id, {_DUR['took']} as took, {_DUR['expected']} as expected from ec), n as (select *, try_cast(nullif(regexp_extract(took, '(\\d+(?:\\.\\d+)?)', 1), '') as double) as n from t where took is not null) select event_id, took, expected, round({_SEC.format('took')}, 9) as seconds from n")
def q08_duration_extract(spark, folder):
    rows = candidate_lines(spark, folder).select("event_id", durations.field(F.col("message"), "took").alias("took"), durations.field(F.col("message"), "expected").alias("expected")).where("took is not null")
    return rows.select("event_id", "took", "expected", F.round(durations.seconds(F.col("took")), 9).alias("seconds"))


_LIM = "case " + " ".join(f"when starts_with(key, '{p}') then [{', '.join(map(str, t))}]" for p, t in packs.STORE.keyspace_policies) + " when kind in ('" + "', '".join(packs.STORE.policies) + "') then case kind " + " ".join(f"when '{k}' then [{', '.join(map(str, t))}]" for k, t in packs.STORE.policies.items()) + " end end"


@query(
    f"""with {EC}, t as (select event_id, {_CLASS_SQL} as kind, {_DUR['took']} as took, {_DUR['expected']} as expected, regexp_extract(message, 'key=(\\S+)', 1) as key from ec),
    n as (select *, try_cast(nullif(regexp_extract(took, '(\\d+(?:\\.\\d+)?)', 1), '') as double) as n from t where kind is not null),
    s as (select *, {_SEC.format('took')} as s from n), e as (select * exclude n, try_cast(nullif(regexp_extract(expected, '(\\d+(?:\\.\\d+)?)', 1), '') as double) as n from s),
    f as (select *, {_SEC.format('expected')} as x, {_LIM} as lim from e),
    r as (select event_id, kind, s, greatest({RANK.format(_BASE_SQL)}, coalesce(len(list_filter(lim, lambda t: round(s * 1000, 6) >= t)), 0), case when s / nullif(x, 0) >= 50 then 4 when s / nullif(x, 0) >= 10 then 3 when s / nullif(x, 0) >= 3 then 2 else 0 end) as rk from f)
    select kind, {LABEL.format('rk')} as severity, count(*) as n from r group by 1, 2"""
)
def q09_duration_severity(spark, folder):
    m = F.col("message")
    typed = candidate_lines(spark, folder).select("message", matching.first_match(m, packs.STORE).alias("kind"), F.regexp_extract(m, r"key=(\S+)", 1).alias("key")).where("kind is not null")
    rows = durations.with_durations(typed, "message")
    rated = matching.duration_severity(F.col("kind"), F.round(F.col("took_s") * 1000, 6), F.col("key"), F.col("took_s"), F.col("expected_s"), packs.STORE)
    return rows.select("kind", rated.alias("severity")).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query(
    f"""with {TE}, r as (select *, row_number() over (partition by source_relpath, event_type order by us, event_id) as rn from te where us is not null),
    c as (select *, rn - min(rn) over w + 1 as storm_count, min(us) over w as window_start_us from r window w as (partition by source_relpath, event_type order by us range between {10 * MINUTE} preceding and current row))
    select event_id, event_type, storm_count, window_start_us from c where storm_count = 5"""
)
def q10_storms(spark, folder):
    found = frames.storms(timeline_events(spark, folder), ["source_relpath", "event_type"], "us", "event_id", 10 * MINUTE, 5)
    return found.select("event_id", "event_type", F.col("storm_count").cast("bigint").alias("storm_count"), "window_start_us")


@query(
    f"""with {TE}, r as (select *, row_number() over (partition by source_relpath, event_type order by us, event_id) as rn from te where us is not null),
    c as (select *, rn - min(rn) over (partition by source_relpath, event_type order by us range between {10 * MINUTE} preceding and current row) + 1 as n from r)
    select source_relpath, event_type, us, severity from te where us is not null and severity in ('critical', 'high')
    union all select source_relpath, 'storm_' || event_type, us, 'high' from c where n = 5"""
)
def q11_events_with_storms(spark, folder):
    events = timeline_events(spark, folder)
    found = frames.storms(events, ["source_relpath", "event_type"], "us", "event_id", 10 * MINUTE, 5)
    both = events.where("us is not null").select("source_relpath", "event_type", "us", "severity").unionByName(found.select("source_relpath", F.concat(F.lit("storm_"), "event_type").alias("event_type"), "us", F.lit("high").alias("severity")))
    return filters.by_level(both, "severity", [1, 2])


_WIN = f"""{TE}, o as (select *, case when us - lag(us) over (partition by source_relpath order by us) <= {2 * MINUTE} then 0 else 1 end as opens from te where us is not null),
    w as (select *, sum(opens) over (partition by source_relpath order by us) as "window" from o)"""


def _windows(spark, folder):
    return incidents.with_windows(timeline_events(spark, folder), ["source_relpath"], "us", 2 * MINUTE)


_ROLL = f"""select source_relpath, cast("window" as bigint) as "window", min(us) as start_us, max(us) as end_us, count(*) as n_events, {', '.join(f"count(*) filter ({RANK.format('severity')} = {k}) as n_{n}" for k, n in enumerate(severity.LABELS))}, {LABEL.format('max(' + RANK.format('severity') + ')')} as max_severity from w group by 1, 2"""


@query(f"with {_WIN} {_ROLL}")
def q12_incident_windows(spark, folder):
    return incidents.rollup(_windows(spark, folder), ["source_relpath"], "us", "severity")


@query(f"with {_WIN}, r as ({_ROLL}) select source_relpath, count(*) as n_windows, cast(sum(n_events) as bigint) as n_events, {LABEL.format('max(' + RANK.format('max_severity') + ')')} as max_severity from r group by 1")
def q13_incident_totals(spark, folder):
    return incidents.totals(q12_incident_windows(spark, folder), ["source_relpath"])


@query(f"""with {_WIN} select source_relpath, cast("window" as bigint) as "window", event_type, arg_min(event_id, (us, event_id)) as event_id, min(us) as us, count(*) as n from w group by 1, 2, 3""")
def q14_incident_first_signals(spark, folder):
    return incidents.first_signals(_windows(spark, folder), ["source_relpath"], "us", "event_type", "event_id")


@query(f"""with {_WIN}, c as (select source_relpath, cast("window" as bigint) as "window", event_type, count(*) as n, min(us) as f from w group by 1, 2, 3), p as (select *, cast(row_number() over (partition by source_relpath, "window" order by n desc, f, event_type) as integer) as place from c) select source_relpath, "window", event_type, n, place from p where place <= 3""")
def q15_incident_top_types(spark, folder):
    return incidents.top_types(_windows(spark, folder), ["source_relpath"], "us", "event_type", 3)


_TELL = (("raft_read_agreement_slow', 'linearizable_read_slow', 'readindex_retry", "reads are under pressure"), ("apply_took_too_long', 'raft_process_slow', 'inmemory_index_scan_slow", "applying entries is under pressure"), ("health_registry_read", "the health key is read"), ("slow_fdatasync', 'raft_heartbeat_miss", "raft timing suffers: slow disk or overloaded leader"), ("applied_index_lag", "correctness risk: the applied index lags"), ("raft_election', 'raft_leadership_loss', 'swarm_leader_change", "leadership moved"))


@query(f"""with {_WIN}, k as (select source_relpath, cast("window" as bigint) as "window", list(distinct event_type) as kinds from w group by 1, 2),
    n as (select source_relpath, "window", concat_ws('; ', {', '.join(f"case when list_has_any(kinds, ['{k}']) then '{t}' end" for k, t in _TELL)}) as s from k) select source_relpath, "window", case when s = '' then 'events without a known story' else s end as narrative from n""")
def q16_incident_narrative(spark, folder):
    kinds = _windows(spark, folder).groupBy("source_relpath", "window").agg(F.collect_set("event_type").alias("kinds"))
    return kinds.select("source_relpath", "window", F.array_join(incidents.narrative(F.col("kinds")), "; ").alias("narrative"))


_GAP, _SPAN = 10 * MINUTE, 20 * MINUTE
_BURST = f"""{TE}, t as (select event_type, coalesce(peer, '') as peer, coalesce(port, -1) as port, us, count(*) as n from te where us is not null group by 1, 2, 3, 4),
  r as (select *, row_number() over k as rn from t window k as (partition by event_type, peer, port order by us)),
  g as (select event_type, peer, port, us, rn, us as st from r where rn = 1
        union all select r.event_type, r.peer, r.port, r.us, r.rn, case when r.us - g.us <= {_GAP} and r.us - g.st <= {_SPAN} then g.st else r.us end
        from g join r on r.event_type = g.event_type and r.peer = g.peer and r.port = g.port and r.rn = g.rn + 1),
  m as (select te.*, g.st as cluster_start from te join g on te.event_type = g.event_type and coalesce(te.peer, '') = g.peer and coalesce(te.port, -1) = g.port and te.us = g.us),
  b as (select event_type, peer, port, cluster_start, min(us) as start_us, max(us) as end_us, count(*) as n from m group by 1, 2, 3, 4 having count(*) >= 3)"""
_BKEY = ["event_type", "peer", "port"]


def _members(spark, folder):
    return bursts.burst_members(timeline_events(spark, folder), _BKEY, "us", _GAP, _SPAN)


@query(f"with recursive {_BURST} select event_type, peer, port, start_us, end_us, n from b")
def q17_burst_clusters(spark, folder):
    return bursts.burst_clusters(_members(spark, folder), _BKEY, "us").drop("cluster_start")


@query(f"with recursive {_BURST}, c as (select event_type, peer, port, cluster_start, reason, count(*) as n from m where reason is not null group by 1, 2, 3, 4, 5), p as (select *, cast(row_number() over (partition by event_type, peer, port, cluster_start order by n desc, reason) as integer) as place from c) select event_type, peer, port, cluster_start, reason, n, place from p where place <= 3")
def q18_cluster_top_reasons(spark, folder):
    return bursts.top_values(_members(spark, folder), _BKEY, "reason", 3)


def _finding_sql() -> str:
    parts = []
    for h in packs.HOST.heuristics:
        kinds, w = ", ".join(f"'{k}'" for k, _ in h.thresholds), h.window_s * 1_000_000
        need = " and ".join(f"t{i} >= {n}" for i, (_, n) in enumerate(h.thresholds))
        sums = ", ".join(f"sum(cast(event_type = '{k}' as integer)) over f as t{i}" for i, (k, _) in enumerate(h.thresholds))
        sup = ", ".join(f"'{k}'" for k in h.supports) or "''"
        parts.append(f"""c_{h.id} as (select distinct bundle_id, us from (select bundle_id, us, {sums} from te where us is not null and event_type in ({kinds}) window f as (partition by bundle_id order by us range between current row and {w} following)) where {need}),
  p_{h.id} as (select bundle_id, min(us) as us, 1 as place from c_{h.id} group by 1 union all
       select bundle_id, us, place from (select c.bundle_id, c.us, p.place + 1 as place, row_number() over (partition by c.bundle_id order by c.us) as rn from p_{h.id} p join c_{h.id} c on c.bundle_id = p.bundle_id and c.us > p.us + {w} where p.place < 5) where rn = 1),
  f_{h.id} as (select p.bundle_id, '{h.id}' as heuristic_id, p.place, p.us as start_us, p.us + {w} as end_us, count(*) filter (te.event_type in ({kinds})) as n_threshold, count(distinct case when te.event_type in ({sup}) then te.event_type end) as n_supports from p_{h.id} p join te on te.bundle_id = p.bundle_id and te.us between p.us and p.us + {w} group by 1, 2, 3, 4, 5)""")
    union = " union all ".join(f"select *, {h.weight} as weight, '{h.severity}' as severity from f_{h.id}" for h in packs.HOST.heuristics)
    return f"{TE}, {', '.join(parts)}, found as (select bundle_id, heuristic_id, place, start_us, end_us, n_threshold, n_supports, cast(round(least(0.99, weight + least(0.10, n_supports * 0.05)), 3) as double) as confidence, severity from ({union}))"


@query(f"with recursive {_finding_sql()} select * from found")
def q19_heuristic_findings(spark, folder):
    return findings.findings(timeline_events(spark, folder), ["bundle_id"], "event_type", "us", packs.HOST.heuristics)


_PAIRS = ", ".join(f"('{h.id}', '{k}', {i}, {str(i >= len(h.thresholds)).lower()})" for h in packs.HOST.heuristics for i, k in enumerate([*(k for k, _ in h.thresholds), *dict.fromkeys(h.supports)]))


_EVIDENCE = f"""{_finding_sql()},
    i as (select f.bundle_id, f.heuristic_id, f.place, v.ord, v.sup, te.event_type, te.event_id, te.us, row_number() over w as rn, count(*) over (partition by f.bundle_id, f.heuristic_id, f.place, v.ord) as n
      from found f join (values {_PAIRS}) v(h, k, ord, sup) on v.h = f.heuristic_id join te on te.bundle_id = f.bundle_id and te.event_type = v.k and te.us between f.start_us and f.end_us
      window w as (partition by f.bundle_id, f.heuristic_id, f.place, v.ord order by te.us, te.event_id)),
    j as (select *, row_number() over (partition by bundle_id, heuristic_id, place order by ord, rn) as line from i where rn = 1 or rn = n or not sup and rn = n // 2 + 1),
    evidence as (select bundle_id, heuristic_id, place, event_type, event_id, us from j where not sup or line <= 12)"""


@query(f"with recursive {_EVIDENCE} select * from evidence")
def q20_finding_evidence(spark, folder):
    events = timeline_events(spark, folder)
    return findings.evidence(findings.findings(events, ["bundle_id"], "event_type", "us", packs.HOST.heuristics), events, ["bundle_id"], "event_type", "us", "event_id", packs.HOST.heuristics)


@query(f"""with {TE}, p as (select event_type, peer || ':' || port as target, count(*) as n from te where peer is not null and port is not null group by 1, 2), t as (select event_type, string_agg(target, ',' order by place) as top_targets from (select *, row_number() over (partition by event_type order by n desc, target) as place from p) where place <= 3 group by 1)
    select e.event_type, count(*) as n, min(us) as first_us, max(us) as last_us, count(us) as n_timed, arg_min(event_id, (-({RANK.format('severity')}), -coalesce(confidence, 0), coalesce(us, 4611686018427387904), event_id)) as worst_event_id, any_value(top_targets) as top_targets from te e left join t using (event_type) group by 1""")
def q21_event_stream_summary(spark, folder):
    e = timeline_events(spark, folder)
    targets = e.where("peer is not null and port is not null").withColumn("target", F.concat_ws(":", "peer", F.col("port").cast("string"))).withColumn("cluster_start", F.lit(0))
    top = bursts.top_values(targets, ["event_type"], "target", 3).groupBy("event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]), ",").alias("top_targets"))
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("us").alias("n_timed"))
    return sums.join(matching.worst(e, ["event_type"], severity.rank(F.col("severity")), "confidence", "us", "event_id"), "event_type").join(top, "event_type", "left")


def _clusters(spark, folder):
    keys = ["bundle_id", "event_type"]
    members = bursts.burst_members(timeline_events(spark, folder), keys, "us", _GAP, _SPAN)
    found = bursts.burst_clusters(members, keys, "us")
    return found.select("bundle_id", "event_type", F.concat_ws("|", "event_type", F.col("start_us").cast("string")).alias("cluster_id"), "start_us")


_CHATTY = ", ".join(f"'{k}'" for k in packs.HOST.chatty)


@query(f"""with recursive {_EVIDENCE}, refs as (select distinct bundle_id, event_id from evidence),
    t as (select bundle_id, event_type, us, count(*) as n from te where us is not null group by 1, 2, 3), r as (select *, row_number() over (partition by bundle_id, event_type order by us) as rn from t),
    g as (select bundle_id, event_type, us, n, rn, us as st from r where rn = 1 union all
      select r.bundle_id, r.event_type, r.us, r.n, r.rn, case when r.us - g.us <= {_GAP} and r.us - g.st <= {_SPAN} then g.st else r.us end from g join r on r.bundle_id = g.bundle_id and r.event_type = g.event_type and r.rn = g.rn + 1),
    b as (select bundle_id, event_type, min(us) as start_us from g group by bundle_id, event_type, st having sum(n) >= 3),
    noisy as (select distinct bundle_id, event_type from b where event_type in ({_CHATTY})),
    e as (select te.*, te.severity is not distinct from 'critical' or refs.event_id is not null as must from te left join refs on refs.bundle_id = te.bundle_id and refs.event_id = te.event_id left join noisy on noisy.bundle_id = te.bundle_id and noisy.event_type = te.event_type
      where te.us is not null and (te.severity is not distinct from 'critical' or refs.event_id is not null or noisy.event_type is null)),
    ids as (select bundle_id, event_id as id from e where must union select bundle_id, arg_min(event_id, (us, event_id)) from e group by bundle_id, event_type union select bundle_id, arg_min(event_id, (us, event_id)) from e where not must group by bundle_id, event_type, us // {10 * MINUTE}),
    items as (select bundle_id, event_type || '|' || start_us as id, start_us as us, 'cluster' as kind from b union all select e.bundle_id, e.event_id, e.us, 'event' from e join ids on ids.bundle_id = e.bundle_id and ids.id = e.event_id),
    p as (select *, cast(row_number() over (partition by bundle_id order by us, kind, id) as integer) as place from items) select bundle_id, place, kind, id, us from p where place <= 40""")
def q22_timeline_downsample(spark, folder):
    events = timeline_events(spark, folder)
    refs = findings.evidence(findings.findings(events, ["bundle_id"], "event_type", "us", packs.HOST.heuristics), events, ["bundle_id"], "event_type", "us", "event_id", packs.HOST.heuristics)
    return timeline.timeline(events, _clusters(spark, folder), ["bundle_id"], "us", "event_type", "severity", "event_id", packs.HOST.chatty, refs, 10 * MINUTE, 40)


@query(f"""with {BL} select source_relpath, line_number, list(line) over (partition by source_relpath order by line_number rows between 2 preceding and 1 preceding) as pre, list(line) over (partition by source_relpath order by line_number rows between 1 following and 1 following) as post from bl""")
def q23_context_lines(spark, folder):
    rows = timeline.context(bundle_lines(spark, folder).select("source_relpath", "line_number", "line"), "source_relpath", "line_number", "line", 2, 1)
    none = F.lit(None).cast("array<string>")
    return rows.select("source_relpath", "line_number", F.when(F.size("pre") > 0, F.col("pre")).otherwise(none).alias("pre"), F.when(F.size("post") > 0, F.col("post")).otherwise(none).alias("post"))


@query(f"""with {TE} select event_id, 'evt_' || lpad(cast(row_number() over (partition by source_relpath order by us nulls first, line_number, event_id) as varchar), 6, '0') as seq_id,
    substr(sha1(concat_ws('|', coalesce(source_relpath, ''), coalesce(cast(line_number as varchar), ''), coalesce(event_type, ''), coalesce(cast(us as varchar), ''), coalesce(event_type, ''), coalesce(peer, ''), coalesce(cast(port as varchar), ''), coalesce(trim(regexp_replace(message, '\\s+', ' ', 'g')), ''))), 1, 12) as event_hash from te""")
def q24_stable_event_ids(spark, folder):
    e = timeline.sequential_ids(timeline_events(spark, folder), ["source_relpath"], ["us", "line_number", "event_id"], F.floor(F.col("us") / HOUR))
    return e.select("event_id", "seq_id", timeline.event_hash(*map(F.col, ("source_relpath", "line_number", "event_type", "us", "event_type", "peer", "port")), T.squeeze(F.col("message"))).alias("event_hash"))


_RX = {c: redact.CLASSES[c].replace("'", "''") for c in redact.CLASSES}
_TOK = " union ".join(f"select '{c}' as entity, lower(unnest(regexp_extract_all(message, '{_RX[c]}'))) as original from ec" for c in redact.CLASSES)
_PAD = "lpad(cast(n as varchar), cast(greatest(3, length(cast(n as varchar))) as integer), '0')"
_NAMED = f"""num as (select *, row_number() over (partition by entity order by original) as n from tok),
  map as (select entity, original, case entity when 'host' then 'host-' || {_PAD} || '.example.invalid' when 'email' then 'user' || {_PAD} || '@example.invalid' when 'sha256' then 'sha256:digest-' || {_PAD}
    when 'ip' then '10.' || ((n - 1) // 64516) || '.' || (((n - 1) // 254) % 254 + 1) || '.' || ((n - 1) % 254 + 1) else entity || '-' || {_PAD} end as replacement from num)"""
_MAP = f"{EC}, tok as ({_TOK}), {_NAMED}"


@query(f"with {_MAP} select entity, original, replacement from map")
def q25_entity_mapping(spark, folder):
    return redact.mapping(redact.tokens(candidate_lines(spark, folder), "message"))


def _rewritten(table_: str, keys: str, text: str, pattern: str, map_: str) -> str:
    """SQL that looks up every token of a text and joins the pieces again."""
    return f"""m as (select map(list(original), list(replacement)) as m from {map_}),
  s as (select {keys}, {text} as t, regexp_split_to_array({text}, '{pattern}') as parts, regexp_extract_all({text}, '{pattern}') as toks from {table_}),
  z as (select {keys}, t, list_transform(list_zip(parts, toks), lambda x: coalesce(x[1], '') || coalesce(m[lower(x[2])], x[2], '')) as p, len(list_filter(toks, lambda x: m[lower(x)] is not null)) as n from s, m)
  select {keys}, case when t is not null then array_to_string(p, '') end as redacted, coalesce(n, 0) as n_replaced from z"""


_ALL = "|".join(f"(?:{_RX[c]})" for c in redact.CLASSES)


@query(f"with {_MAP}, {_rewritten('ec', 'event_id', 'message', _ALL, 'map')}")
def q26_redact_messages(spark, folder):
    lines = candidate_lines(spark, folder)
    return redact.rewrite(lines, ["event_id"], "message", redact.mapping(redact.tokens(lines, "message")))


@query(f"with {EC} select * from (" + " union all ".join(f"select source_relpath, '{c}' as entity, cast(sum(len(regexp_extract_all(message, '{_RX[c]}'))) as bigint) as n from ec where message is not null group by 1" for c in redact.CLASSES) + ") where n > 0")
def q27_redact_audit(spark, folder):
    return redact.audit(candidate_lines(spark, folder), "source_relpath", "message")


_LITERALS = [("Docker Application Container Engine", "<unit>"), ("Docker", "<daemon>"), ("memberlist", "<gossip>"), ("raft", "<consensus>")]
_REPL = "message"
for _a, _b in sorted(_LITERALS, key=lambda p: (-len(p[0]), p[0])):
    _REPL = f"replace({_REPL}, '{_a}', '{_b}')"


@query(f"with {EC} select event_id, {_REPL} as redacted, {' + '.join(f'''(length(message) - length(replace(message, '{a}', ''))) // {len(a)}''' for a, _ in _LITERALS)} as n from ec")
def q28_literal_replacement(spark, folder):
    n = sum((redact.count_literal(F.col("message"), a) for a, _ in _LITERALS[1:]), redact.count_literal(F.col("message"), _LITERALS[0][0]))
    return candidate_lines(spark, folder).select("event_id", redact.replace_literals(F.col("message"), _LITERALS).alias("redacted"), n.alias("n"))


@query("""with h as (select lower(hostname) as host, 'host-' || lpad(cast(row_number() over (order by lower(hostname)) as varchar), 3, '0') || '.example.invalid' as mapped from nodes),
  p as (select distinct source_relpath from bundle_lines), s as (select source_relpath, string_split(source_relpath, '/') as c from p)
  select source_relpath, c[1] || '/' || coalesce(mapped, c[2]) || '/' || array_to_string(c[3:], '/') as target from s left join h on h.host = lower(c[2])""")
def q29_path_rewrite(spark, folder):
    hosts = redact.mapping(table(spark, folder, "nodes").select(F.lit("host").alias("entity"), F.lower("hostname").alias("original")).distinct())
    paths = table(spark, folder, "bundle_lines").select("source_relpath").distinct()
    return filters.rewrite_components(paths, "source_relpath", hosts)


@query(f"""with {EC}, k as (select bundle_id, {_JSQL} as kind, message from ec), t as (select bundle_id, kind, unnest(list_concat(regexp_extract_all(message, 'https?://[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}:[0-9]{{2,5}}'), regexp_extract_all(message, '[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}:[0-9]{{2,5}}'))) as target from k where kind is not null) select distinct bundle_id, kind, target from t""")
def q30_journal_targets(spark, folder):
    rows = candidate_lines(spark, folder).withColumn("kind", matching.first_match(F.col("message"), packs.JOURNAL)).where("kind is not null")
    return journal.targets(rows, ["bundle_id", "kind"], "message")


_TPL = "line"
for _p, _r in T.MASKS:
    _TPL = f"regexp_replace({_TPL}, '{_p}', '{_r.replace('$', chr(92))}', 'g')"
_TPL = f"trim({_TPL})"


@query(f"with {BL}, t as (select {_TPL} as s, source_relpath from bl) select case when length(s) > 180 then substr(s, 1, 177) || '...' else s end as template, count(*) as n, count(distinct source_relpath) as n_files from t group by 1")
def q31_template_normalise(spark, folder):
    return bundle_lines(spark, folder).select(T.template(F.col("line")).alias("template"), "source_relpath").groupBy("template").agg(F.count("*").alias("n"), F.count_distinct("source_relpath").alias("n_files"))


@query(f"""with {TE}, d as (select bundle_id, peer as endpoint, cast(strlen(message) as double) as ms from te where peer is not null)
  select bundle_id, min(ms) as min_ms, max(ms) as max_ms, round(max(ms) - min(ms), 6) as skew_ms, round(max(ms) / nullif(min(ms), 0), 6) as ratio, arg_min(endpoint, (ms, endpoint)) filter (ms is not null) as fastest, arg_max(endpoint, (ms, endpoint)) filter (ms is not null) as slowest, count(*) filter (ms > 70) as n_slow from d group by 1""")
def q32_snapshot_metrics(spark, folder):
    d = timeline_events(spark, folder).where("peer is not null").select("bundle_id", F.col("peer").alias("endpoint"), F.octet_length("message").cast("double").alias("ms"))
    return snapshot.health_metrics(d, ["bundle_id"], "endpoint", "ms", 70.0)


@query(f"""with {TE} select peer, count(*) as n_seen, count(*) filter (line_number > 500) as n_slow, min(line_number) as min_ms, max(line_number) as max_ms, count(*) filter (line_number > 500) * 3 >= count(*) as significant, case when count(*) filter (line_number > 500) < count(*) then 'intermittent' else 'sustained' end as pattern from te where peer is not null group by 1 having count(*) filter (line_number > 500) > 0""")
def q33_slow_endpoints(spark, folder):
    return snapshot.slow_endpoints(timeline_events(spark, folder).where("peer is not null"), [], "peer", "line_number", 500)


@query(f"""with {TE}, v as (select bundle_id, coalesce(peer, 'unknown') as leader, count(*) as n from te group by 1, 2) select bundle_id, arg_min(leader, (-n, leader)) as leader, max(n) as n_votes, count(*) = 1 as stable from v group by 1""")
def q34_leader_vote(spark, folder):
    return snapshot.leader_vote(timeline_events(spark, folder), ["bundle_id"], "peer")


def _fam(pack) -> str:
    return "case kind " + " ".join(f"when '{s.event_type}' then '{s.family}'" for s in pack.signatures if s.family) + " end"


@query(f"""with {EC}, j as (select bundle_id, kind, {_fam(packs.JOURNAL)} as family from (select bundle_id, {_JSQL} as kind from ec)), s as (select distinct bundle_id, kind, {_fam(packs.STORE)} as family from (select bundle_id, {_CLASS_SQL} as kind from ec)),
  u as (select bundle_id, family from j where family is not null union all select bundle_id, family from s where family is not null) select bundle_id, case family when 'storage_timing' then 'disk_timing' else family end as family, count(*) as n from u group by 1, 2""")
def q35_family_counts(spark, folder):
    rows = candidate_lines(spark, folder)

    def with_family(pack):
        kind = matching.first_match(F.col("message"), pack)
        return rows.select("bundle_id", kind.alias("event_type")).withColumn("family", matching.family(F.col("event_type"), pack))

    return snapshot.family_counts(with_family(packs.JOURNAL), with_family(packs.STORE), ["bundle_id"])


@query("select cluster_id, count(*) as n_nodes, count(*) filter (node_type = 'manager') as n_managers, count(*) filter (node_type = 'worker') as n_workers, cast(sum(cpus) as bigint) as cpus, cast(round(sum(cast(ram_gib as decimal(20,6))), 2) as double) as ram_gib, coalesce(string_agg(distinct engine_version, ',' order by engine_version), '') as versions from nodes group by 1")
def q36_node_statistics(spark, folder):
    return inventory.statistics(table(spark, folder, "nodes"), ["cluster_id"], "node_type", "cpus", "ram_gib", "engine_version")


@query("select cluster_id, hostname, substr(node_id, 1, 10) as short_id, case when node_type = 'manager' and state is null then 'BAD-Manager' when node_type = 'manager' and availability = 'active' then 'leader' when node_type = 'manager' then 'manager' when node_type is not null then 'worker' end as role from nodes")
def q37_node_roles(spark, folder):
    r = inventory.role(F.col("node_type"), F.col("state").isNotNull(), F.col("availability") == "active")
    return table(spark, folder, "nodes").select("cluster_id", "hostname", F.substring("node_id", 1, 10).alias("short_id"), r.alias("role"))


@query(f"with {TE}, m as (select max(us) as newest from te) select event_id from te, m where us between newest - {24 * HOUR} and newest")
def q38_relative_days(spark, folder):
    return filters.last_days(timeline_events(spark, folder), "us", 1).select("event_id")


@query(f"with {TE} select event_type, count(*) as n from te where us >= 1709596800000000 and us < 1709683200000000 group by 1")
def q39_time_range(spark, folder):
    return filters.time_range(timeline_events(spark, folder), "us", 1_709_596_800_000_000, 1_709_683_200_000_000).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""with {EC}, k as (select regexp_extract(message, 'key=(/\\S+)', 1) as key from ec) select case {" ".join(f"when starts_with('/registry' || key, '{p}') then '{p}'" for p in packs.KEY_PREFIXES)} else '(other)' end as bucket, count(*) as n from k where key <> '' group by 1""")
def q40_prefix_buckets(spark, folder):
    key = F.regexp_extract("message", r"key=(/\S+)", 1)
    return candidate_lines(spark, folder).select(key.alias("key")).where("key <> ''").groupBy(incidents.key_bucket(F.concat(F.lit("/registry"), F.col("key"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("""with p as (select distinct source_relpath, array_to_string(string_split(source_relpath, '/')[3:], '/') as rel from event_candidates)
  select source_relpath, case when rel like 'var/log/docker%' then 0 when rel like 'var/log/containerd%' then 1 when rel like 'var/log/messages%' then 2 when rel like 'var/log/syslog%' then 3 when rel like 'sos_commands/logs/journalctl%' then 6 else 10 end as glob from p
  where rel like 'var/log/docker%' or rel like 'var/log/containerd%' or rel like 'var/log/messages%' or rel like 'var/log/syslog%' or rel like 'sos_commands/logs/journalctl%' or rel like 'sos_strings/logs/journalctl%.tailed'""")
def q41_glob_discovery(spark, folder):
    paths = table(spark, folder, "event_candidates").select("source_relpath").distinct()
    rel = F.array_join(F.slice(F.split("source_relpath", "/"), 3, 1000), "/")
    return filters.discover(paths, rel, packs.INCLUDE, packs.EXCLUDE).select("source_relpath", "glob")


@query(f"with {BL}, s as (select *, coalesce(sum(strlen(line)) over (order by file_ord, source_relpath, line_number rows between unbounded preceding and 1 preceding), 0) as before from bl) select source_relpath, line_number from s where before < 200000")
def q42_running_byte_budget(spark, folder):
    lines = bundle_lines(spark, folder).withColumn("file", F.struct("file_ord", "source_relpath"))
    return timeline.byte_budget(lines, ["file", "line_number"], F.octet_length("line"), 200_000, "file").select("source_relpath", "line_number")


@query(f"""with {TE}, u as (select *, last_value(case when event_type = 'raft_peer_connect_error' then us end ignore nulls) over w as after_us from te where us is not null and event_type in ('raft_peer_connect_error', 'raft_election') window w as (partition by bundle_id order by us, cast(event_type = 'raft_election' as integer), event_id rows unbounded preceding))
  select event_id, us - after_us as lag_us from u where event_type = 'raft_election' and us - after_us <= {HOUR}""")
def q43_related_within(spark, folder):
    found = findings.related_within(timeline_events(spark, folder), ["bundle_id"], "event_type", "us", "event_id", "raft_peer_connect_error", "raft_election", HOUR)
    return found.select("event_id", "lag_us")


@query(f"""with {TE}, e as (select bundle_id, event_type, us from te where us is not null and event_type in ('raft_heartbeat_miss', 'raft_election', 'docker_restart')),
  c as (select bundle_id, us, sum(cast(event_type = 'raft_heartbeat_miss' as integer)) over f as h, sum(cast(event_type = 'raft_election' as integer)) over f as e, sum(cast(event_type = 'docker_restart' as integer)) over f as d from e window f as (partition by bundle_id order by us range between current row and {HOUR} following))
  select distinct bundle_id, 'heartbeats_then_election' as rule, us from c where h > 0 and e > 0 and d = 0""")
def q44_compound_rules(spark, folder):
    rule = packs.Compound("heartbeats_then_election", "high", 3600, ("raft_heartbeat_miss",), ("raft_election",), ("docker_restart",))
    return findings.compound_times(timeline_events(spark, folder), ["bundle_id"], "event_type", "us", rule)


@query(f"""with {EC}, k as (select bundle_id, event_id, line_number, {_JSQL} as kind from ec), n as (select *, row_number() over (partition by bundle_id, kind order by line_number, event_id) as rn, count(*) over (partition by bundle_id, kind) as c from k where kind is not null)
  select bundle_id, kind, event_id, cast(greatest(0, c - 4) as bigint) as suppressed from n where rn <= 2 or rn > c - 2""")
def q45_journal_samples(spark, folder):
    rows = candidate_lines(spark, folder).withColumn("kind", matching.first_match(F.col("message"), packs.JOURNAL)).where("kind is not null")
    return journal.samples(rows, ["bundle_id", "kind"], "line_number", "event_id").select("bundle_id", "kind", "event_id", "suppressed")


_USED = ", ".join(f"('{k}')" for h in packs.HOST.heuristics for k in [*(k for k, _ in h.thresholds), *h.supports, "never_defined"])
_DEFINED = ", ".join(f"('{x.event_type}')" for x in packs.HOST.signatures)


@query(f"select distinct event_type from (values {_USED}) u(event_type) where event_type not in (select t from (values {_DEFINED}) d(t))")
def q46_lint_cross_reference(spark, folder):
    defined = spark.createDataFrame([(s.event_type,) for s in packs.HOST.signatures], "event_type string")
    used = spark.createDataFrame([(k,) for h in packs.HOST.heuristics for k, _ in h.thresholds] + [(s,) for h in packs.HOST.heuristics for s in h.supports] + [("never_defined",)], "event_type string")
    return used.join(defined, "event_type", "left_anti").distinct()


_HOSTS = """h as (select distinct lower(hostname) as original from nodes where trim(hostname) <> ''),
  hm as (select original, 'host-' || lpad(cast(row_number() over (order by original) as varchar), 3, '0') || '.example.invalid' as replacement from h)"""


@query(f"with {BL}, {_HOSTS}, {_rewritten('bl', 'source_relpath, line_number', 'line', redact.HOST, 'hm')}")
def q47_redact_hosts(spark, folder):
    hosts = redact.mapping(redact.seeds(table(spark, folder, "nodes"), "hostname", "address", "cluster_id", "node_id").where("entity = 'host'"))
    return redact.rewrite(bundle_lines(spark, folder), ["source_relpath", "line_number"], "line", hosts, ("host",))


_FACTS = {"first_peer": r"failed to reach peer ([0-9.]+)", "first_timeout": r"handshake with ([0-9.]+:[0-9]+) timed out", "first_count": r"error count ([0-9]+)"}


@query(f"with {BL} select source_relpath, {', '.join(f"arg_min(nullif(regexp_extract(line, '{p}', 1), ''), line_number) filter (regexp_matches(line, '{p}')) as {n}" for n, p in _FACTS.items())} from bl group by 1")
def q48_first_facts(spark, folder):
    return inventory.facts(bundle_lines(spark, folder), ["source_relpath"], "line_number", "line", _FACTS)


@query(f"with {EC}, p as (select unnest([{', '.join("'" + _q(p) + "'" for p in packs.PATTERNS)}]) as pattern), c as (select pattern, count(ec.message) as n from p left join ec on regexp_matches(ec.message, pattern) group by 1), b as (select case when lower(pattern) like '%etcd%' then 'store' when lower(pattern) like '%leader%' then 'leadership' when lower(pattern) like '%election%' then 'election' when regexp_matches(lower(pattern), 'clock|systime|time sync') then 'clock' end as bucket, n from c) select bucket, count(*) as n_patterns, cast(sum(n) as bigint) as n from b where bucket is not null group by 1")
def q49_keyword_buckets(spark, folder):
    counted = matching.with_zeros(matching.count_patterns(candidate_lines(spark, folder), "source_relpath", "line_number", "message", packs.PATTERNS), packs.PATTERNS)
    return counted.withColumn("bucket", inventory.keyword_bucket(F.col("pattern"))).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n_patterns"), F.sum("n").cast("bigint").alias("n"))


@query(f"with {TE}, a as (select address, min(hostname) as hostname from nodes where address is not null group by 1) select peer, hostname, count(*) as n from te left join a on a.address = te.peer where peer is not null group by 1, 2")
def q50_endpoint_hosts(spark, folder):
    peers = timeline_events(spark, folder).where("peer is not null").groupBy("peer").agg(F.count("*").alias("n"))
    return inventory.endpoint_hosts(peers, "peer", table(spark, folder, "nodes"), "address", "hostname").select("peer", "hostname", "n")


@query("select lower(hostname) as original, 'host-' || lpad(cast(row_number() over (order by lower(hostname)) as varchar), 3, '0') || '.example.invalid' as hostname, 'node-' || lpad(cast(row_number() over (order by lower(node_id)) as varchar), 3, '0') as node_id from nodes")
def q51_redact_columns(spark, folder):
    nodes = table(spark, folder, "nodes")
    mapped = redact.mapping(redact.seeds(nodes, "hostname", "address", "cluster_id", "node_id"))
    return redact.rewrite_columns(nodes.select(F.lower("hostname").alias("original"), "hostname", "node_id"), {"hostname": "host", "node_id": "node"}, mapped)


# Status files are written from the nodes' table and read again, so that the queries pass through the parsers.

def _status_files(spark, folder):
    n = table(spark, folder, "nodes").where("address is not null")
    endpoint = F.concat(F.lit("https://"), "address", F.lit(":2379"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    health = F.concat(F.lit("| "), endpoint, F.lit(" | true | "), F.when(F.col("cpus").isNotNull(), F.concat((F.col("cpus") * 7).cast("string"), F.lit(".5ms"))).otherwise(""), F.lit(" |  |"))
    leads, learns = (F.col("node_type") == "manager") & (F.col("availability") == "active"), F.col("state").isNull()
    status = F.concat(F.lit("| "), endpoint, F.lit(" | "), F.when(leads, "true").otherwise("false"), F.lit(" | "), F.when(learns, "true").otherwise("false"), F.lit(" | "), text(F.col("cpus") % 5), F.lit(" | "), text(F.col("cpus") * 10), F.lit(" | "), text(F.col("cpus") * 9), F.lit(" |"))
    rows = n.groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_list(health)), "\n").alias("h"), F.array_join(F.sort_array(F.collect_list(status)), "\n").alias("s"))
    head = lambda *names: F.lit("+----+\n| " + " | ".join(names) + " |\n+----+\n")
    text_ = F.concat(head("ENDPOINT", "HEALTH", "TOOK", "ERROR"), "h", F.lit("\n+----+\n\n"), head("ENDPOINT", "IS LEADER", "IS LEARNER", "RAFT TERM", "RAFT INDEX", "RAFT APPLIED INDEX"), "s", F.lit("\n+----+\n"))
    return snapshot.status_tables(rows.select("cluster_id", text_.alias("text")), ["cluster_id"], "text")


_NODES = """hn as (select cluster_id, 'https://' || address || ':2379' as endpoint, cast(cpus * 7 as double) + 0.5 as ms from nodes where address is not null),
  sn as (select cluster_id, 'https://' || address || ':2379' as endpoint, coalesce(node_type = 'manager' and availability = 'active', false) as leads, state is null as learns, cpus % 5 as term, cast(cpus * 10 as bigint) as idx, cast(cpus * 9 as bigint) as applied from nodes where address is not null)"""
_HEALTH = "select cluster_id, min(ms) as min_ms, max(ms) as max_ms, round(max(ms) - min(ms), 6) as skew_ms, round(max(ms) / nullif(min(ms), 0), 6) as ratio, arg_min(endpoint, (ms, endpoint)) filter (ms is not null) as fastest, arg_max(endpoint, (ms, endpoint)) filter (ms is not null) as slowest, count(*) filter (ms > 110) as n_slow from hn group by 1"
_RAFT = "select cluster_id, count(distinct term) as n_terms, max(idx) - min(idx) as index_drift, max(applied) - min(applied) as applied_drift, count(*) as n_members, count(*) filter (learns) as n_learners, max(idx) - min(idx) >= 100 as concerning from sn group by 1"
_VOTE = "select cluster_id, arg_min(leader, (-n, leader)) as leader, max(n) as n_votes, count(*) = 1 as stable from (select cluster_id, case when leads then endpoint else 'unknown' end as leader, count(*) as n from sn group by 1, 2) group by 1"


@query(f"with {_NODES} {_HEALTH}")
def q52_status_health(spark, folder):
    return snapshot.health_metrics(_status_files(spark, folder)[0], ["cluster_id"], "endpoint", "took_ms")


@query(f"with {_NODES} {_RAFT}")
def q53_status_raft(spark, folder):
    return snapshot.raft_metrics(_status_files(spark, folder)[1], ["cluster_id"], "term", "raft_index", "applied_index", F.col("is_learner"))


@query(f"""with {_NODES}, r as ({_RAFT}), v as ({_VOTE}), h as ({_HEALTH}), e as (select cluster_id, count(distinct endpoint) as k from sn group by 1)
  select r.cluster_id, n_terms, index_drift, applied_drift, n_members, n_learners, concerning, leader, n_votes, stable, min_ms, max_ms, n_slow, k as n_hosts, k as n_endpoints, case when k < 3 then 'no failure tolerated' when k % 2 = 0 then 'even number of voters' else 'ok' end as risk
  from r join v using (cluster_id) left join h using (cluster_id) join e using (cluster_id)""")
def q54_cluster_synthesis(spark, folder):
    health, status, _ = _status_files(spark, folder)
    scoped = status.withColumn("host", F.col("endpoint")).withColumn("leader", F.when(F.col("is_leader"), F.col("endpoint")))
    return snapshot.synthesis(scoped, health, ["cluster_id"]).drop("slow_endpoints", "skew_ms", "ratio", "fastest", "slowest")


@query(f"""with {_NODES}, p as (select cluster_id, endpoint, count(*) as n_seen, count(*) filter (ms > 110) as n_slow, min(ms) as min_ms, max(ms) as max_ms from hn group by 1, 2 having count(*) filter (ms > 110) > 0),
  k as (select *, n_slow * 3 >= n_seen as significant, case when n_slow < n_seen then 'intermittent' else 'sustained' end as pattern, cast(row_number() over (partition by cluster_id order by max_ms desc, endpoint) as integer) as place from p) select * from k where place <= 3""")
def q55_slowest_endpoints(spark, folder):
    return snapshot.slowest_endpoints(_status_files(spark, folder)[0], ["cluster_id"], "endpoint", "took_ms", 3)


_MTPL = _TPL.replace("regexp_replace(line,", "regexp_replace(message,")
_GROUPS = f"""{EC}, k as (select bundle_id, {_JSQL} as kind, message, line_number from ec), t as (select *, {_MTPL} as s from k where kind is not null), u as (select *, case when length(s) > 180 then substr(s, 1, 177) || '...' else s end as template from t),
  g as (select bundle_id, kind, template, count(*) as n, min(line_number) as first_us, max(line_number) as last_us, coalesce(string_agg(distinct nullif(regexp_extract(message, 'retrying in ([0-9]+[A-Za-z])', 1), ''), ',' order by nullif(regexp_extract(message, 'retrying in ([0-9]+[A-Za-z])', 1), '')), '') as retry_intervals,
    case when contains(lower(template), 'pxd.sock') then 'docker_plugin_pxd_sock_refused' when contains(lower(template), '/run/docker/plugins') and contains(lower(template), 'plugin.activate') and contains(lower(template), 'refused') then 'docker_plugin_activate_refused' else kind end as label from u group by 1, 2, 3)"""


def _groups(spark, folder):
    rows = candidate_lines(spark, folder).withColumn("kind", matching.first_match(F.col("message"), packs.JOURNAL)).where("kind is not null")
    return journal.signature_groups(rows, ["bundle_id"], "kind", "message", "line_number")


@query(f"with {_GROUPS} select * from g")
def q56_journal_groups(spark, folder):
    return _groups(spark, folder)


@query(f"with {_GROUPS}, p as (select *, cast(row_number() over (partition by bundle_id order by n desc, label, template) as integer) as place from g where n >= 3) select * from p where place <= 5")
def q57_repeating_signatures(spark, folder):
    return journal.repeating(_groups(spark, folder), ["bundle_id"])


_DAYS = filters.days_around("2024-03-10", 4)


@query(f"""with {BL}, p as (select unnest([{', '.join(repr(p) for p in _WORDS)}]) as pattern), d as (select unnest([{', '.join(repr(x) for x in _DAYS)}]) as day), c as (select pattern, regexp_extract(line, '({'|'.join(_DAYS)})', 1) as day, count(*) as n from bl join p on regexp_matches(line, pattern) group by 1, 2)
  select p.pattern, d.day, coalesce(n, 0) as n from p cross join d left join c on c.pattern = p.pattern and c.day = d.day""")
def q58_pattern_days(spark, folder):
    day = filters.day_key(F.col("line"), "2024-03-10", 4)
    rows = bundle_lines(spark, folder).where(day.isNotNull())
    return matching.with_day_zeros(matching.count_patterns(rows, "source_relpath", "line_number", "line", _WORDS, day), _WORDS, _DAYS)


@query("""select cluster_id, node_id as id, hostname as name, case when node_type is not null then 'http://' || address || ':2380,http://x:2380' end as peer_urls, case when node_type = 'manager' then true end as is_leader
  from nodes where hostname is not null and node_id is not null and address is not null and node_type is not null""")
def q59_member_lines(spark, folder):
    n = table(spark, folder, "nodes").where("hostname is not null and node_id is not null and address is not null and node_type is not null")
    rest = F.concat(F.lit("name="), "hostname", F.lit(" peerURLs=http://"), "address", F.lit(":2380,http://x:2380"))
    line = F.when(F.col("node_type") == "manager", F.concat("node_id", F.lit(": "), rest, F.lit(" isLeader=true"))).otherwise(F.concat(F.lit("member "), "node_id", F.lit(" "), rest))
    m = n.select("cluster_id", snapshot.member_line(line).alias("m")).where("m is not null")
    return m.select("cluster_id", "m.id", "m.name", F.array_join("m.peer_urls", ",").alias("peer_urls"), "m.is_leader")


@query("select lower(hostname) as host, address as told_address, '24' as mask, os as system, engine_version as kernel from nodes where hostname is not null and address is not null and os is not null and engine_version is not null")
def q60_node_facts(spark, folder):
    n = table(spark, folder, "nodes").where("hostname is not null and address is not null and os is not null and engine_version is not null")
    told = (F.concat(F.lit("Hostname: "), "hostname"), F.concat(F.lit("Operating System: "), "os"), F.concat(F.lit(" Kernel Version: "), "engine_version"), F.concat(F.lit("    inet "), "address", F.lit("/24 brd")), F.lit("Hostname: later"))
    lines = n.select("node_id", F.posexplode(F.array(*told)).alias("n", "line"))
    found = inventory.facts(lines, ["node_id"], "n", "line", inventory.DSINFO)
    return found.select(spelling.host_key(F.col("told_host")).alias("host"), "told_address", "mask", "system", "kernel")


@query(f"with {BL}, r as (select substr(line, instr(line, '{{')) as rest from bl where contains(line, '{{')), j as (select case when json_valid(rest) then json_extract_string(rest, '$.level') end as level, case when json_valid(rest) then json_extract_string(rest, '$.msg') end as msg from r) select level, count(*) as n, count(distinct msg) as n_messages from j where level is not null group by 1")
def q61_payload_values(spark, folder):
    rows = bundle_lines(spark, folder).where(F.contains("line", F.lit("{"))).select(payload.payload_value(F.col("line"), "level").alias("level"), payload.payload_value(F.col("line"), "msg").alias("msg"))
    return rows.where("level is not null").groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("msg").alias("n_messages"))


@query(f"""with {TE} select event_id, case when length(message) > 60 then substr(message, 1, 59) || '…' else message end as short, case when port = 2377 or contains(event_type, 'raft') then 'manager quorum traffic (2377) is failing' when port = 7946 or contains(event_type, 'memberlist') then 'gossip traffic (7946) is failing' else 'repeated events' end as implication,
  concat_ws(' ', cast(us as varchar), rpad(upper(severity), 8, ' '), event_type, 'peer=' || peer, 'reason=' || reason, '(' || source_relpath || ')') as row_text from te""")
def q62_event_rows(spark, folder):
    e = timeline_events(spark, folder)
    row = T.event_row(F.col("us").cast("string"), F.col("severity"), F.col("event_type"), F.col("peer"), F.col("reason"), F.col("source_relpath"))
    return e.select("event_id", T.shorten(F.col("message"), 60).alias("short"), T.implication(F.col("port"), F.col("event_type")).alias("implication"), row.alias("row_text"))


_BTOK = _TOK.replace("message", "line").replace("from ec", "from bl")
_EVERY = "|".join(f"(?:{x})" for x in (*_RX.values(), redact.HOST))


@query(f"with {BL}, tok as ({_BTOK} union select 'host', lower(trim(hostname)) from nodes where trim(hostname) <> '' union select 'ip', lower(trim(address)) from nodes where trim(address) <> '' union select 'cluster', lower(trim(cluster_id)) from nodes where trim(cluster_id) <> '' union select 'node', lower(trim(node_id)) from nodes where trim(node_id) <> ''), {_NAMED}, {_rewritten('bl', 'source_relpath, line_number', 'line', _EVERY, 'map')}")
def q63_redact_seeded(spark, folder):
    lines = bundle_lines(spark, folder)
    entities = redact.tokens(lines, "line").unionByName(redact.seeds(table(spark, folder, "nodes"), "hostname", "address", "cluster_id", "node_id")).distinct()
    return redact.rewrite(lines, ["source_relpath", "line_number"], "line", redact.mapping(entities), (*redact.CLASSES, "host"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return q12_incident_windows(spark, folder)
