"""Operators of the core against plain models and on odd input."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logfathom import session
from logfathom.functions import loglex, spelling, times
from logfathom.operators import bursts, findings, frames, incidents, loglines, redact, sessions, timeline, timestamps
from logfathom.rules.model import Heuristic

GAP = 1_800_000_000


# sessions

def session_model(rows, gap):
    by = defaultdict(set)
    for key, us, kind, event in rows:
        if key is not None and us is not None:
            by[key].add((us, event, kind))
    out = []
    for key, events in by.items():
        cur = None
        for us, event, kind in sorted(events, key=lambda e: e[0]):
            if cur and us - cur[2] <= gap:
                cur[2], cur[3] = us, cur[3] + 1
                cur[4].add(kind)
            else:
                cur = [key, us, us, 1, {kind}]
                out.append(cur)
    return Counter((k, a, z, n, len(t - {None})) for k, a, z, n, t in out)


def run_sessions(spark, rows, gap=GAP):
    df = spark.createDataFrame(rows, "k string, us bigint, kind string, event string").withColumn("start_us", F.lit("clash")).withColumn("slot", F.lit(1))
    out = sessions.merge_sessions(df, F.col("k"), F.col("us"), F.col("kind"), [F.col("event")], gap)
    return Counter((r["key"], r["start_us"], r["end_us"], r["n_events"], r["n_types"]) for r in out.collect())


def test_sessions_at_the_gap(spark):
    rows = [("a", 0, "x", "1"), ("a", GAP, "y", "2"), ("a", 2 * GAP + 1, "x", "3"), ("a", 0, "x", "1"), ("a", 0, None, "4"), (None, 5, "x", "5"), ("b", None, "x", "6"), ("c", -GAP, "x", "7"), ("c", -1, "x", "8"), ("c", 1, "x", "9")]
    assert run_sessions(spark, rows) == session_model(rows, GAP)
    assert ("a", 0, GAP, 3, 2) in run_sessions(spark, rows)


@pytest.mark.parametrize("seed", range(3))
def test_sessions_like_model(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("aab"), r.randrange(-200, 2000), r.choice(["x", "y", None]), str(r.randrange(300))) for _ in range(400)]
    assert run_sessions(spark, rows, 7) == session_model(rows, 7)


def test_sessions_of_nothing(spark):
    assert not run_sessions(spark, [])


def test_streamed_sessions(spark, tmp_path):
    from logfathom.streaming.sessions import stream_sessions

    src = tmp_path / "in"
    spark.sql("select 'a' k, timestamp_micros(86400000000L + id * 60000000L) ts, 'x' kind, cast(id as string) event from range(5) union all select 'a', timestamp_micros(176400000000L), 'y', 'z' union all select 'a', timestamp_micros(86460000000L), 'x', '1'").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("k string, ts timestamp, kind string, event string").parquet(str(src))
    q = stream_sessions(stream, F.col("k"), F.col("ts"), F.col("kind"), F.col("event")).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert [tuple(r) for r in spark.sql("select key, start_us, end_us, n_events, n_types from streamed").collect()] == [("a", 86_400_000_000, 86_640_000_000, 5, 1)]
    finally:
        q.stop()


# timestamps

COLLECTED = 1_710_500_000_000_000  # 2024-03-15T10:53:20Z


def normal(spark, rows):
    df = spark.createDataFrame(rows, "id int, txt string, src string, tz string, end bigint").withColumn("time_us", F.lit("clash"))
    return {r["id"]: (r["time_status"], r["time_us"]) for r in timestamps.normalise_times(df, "txt", "src", "tz", "end").collect()}


def one(spark, text, tz="UTC", end=COLLECTED):
    return normal(spark, [(1, text, "s", tz, end)])[1]


def test_times_of_many_forms(spark):
    want = 1_709_632_799_500_000  # 2024-03-05T09:59:59.5Z
    texts = ["2024-03-05T09:59:59.5Z", "2024-03-05 09:59:59.500000999Z", 'time="2024-03-05T09:59:59.5Z"', " 2024-03-05t09:59:59.5z\t", "2024-03-05T10:59:59.5+01:00", "2024-03-05T04:59:59.5-0500", "2024-03-05T11:59:59,5+02", "2024-03-05 09:59:59.5 +0000 UTC m=+12.5", "1709632799.5", "1709632799500", "1709632799500000", "1709632799500000123", "I0305 09:59:59.5", "2024/03/05 09:59:59.5", "20240305T095959.5"]
    got = normal(spark, [(k, t, str(k), "UTC", COLLECTED) for k, t in enumerate(texts)])
    assert {t: got[k] for k, t in enumerate(texts)} == {t: ("ok", want) for t in texts}
    whole = ["Tue, 05 Mar 2024 09:59:59 GMT", "[Tue Mar  5 09:59:59 2024]", "Tue Mar 5 09:59:59 UTC 2024", "05/Mar/2024:09:59:59 +0000", "5 Mar 2024 9:59:59 AM", "Mar  5 09:59:59", "Tue 2024-03-05 09:59:59 UTC"]
    got = normal(spark, [(k, t, str(k), "UTC", COLLECTED) for k, t in enumerate(whole)])
    assert {t: got[k] for k, t in enumerate(whole)} == {t: ("ok", want - 500_000) for t in whole}


def test_times_without_an_instant(spark):
    rows = [None, "", " ", "-", "n/a", "yesterday 14:02", "2025-02-30T10:11:12Z", "2025-13-04 07:08:09", "0000-00-00 00:00:00", "T12:30:05Z", "[102829.371978]", "2024-01-01T24:00:00Z", "x" * 100_000]
    got = normal(spark, [(k, t, "s", "UTC", COLLECTED) for k, t in enumerate(rows)])
    assert {k: v[0] for k, v in got.items()} == {k: "missing" if k < 3 else "unreadable" for k in range(len(rows))}
    assert all(v[1] is None for v in got.values())


def test_clock_changes(spark):
    ny = "America/New_York"
    assert one(spark, "2024-03-10 02:30:00", ny)[0] == "skipped"
    assert one(spark, "2023-11-05 01:30:00", ny)[0] == "repeated"
    assert one(spark, "2023-11-05 01:30:00 EST", ny) == ("ok", 1_699_165_800_000_000)
    assert one(spark, "2023-11-05 01:30:00 EDT", ny) == ("ok", 1_699_162_200_000_000)
    assert one(spark, "2024-03-10 03:30:00", ny) == ("ok", 1_710_055_800_000_000)
    assert one(spark, "2024-03-10 03:30:00", None)[0] == "no_zone"
    assert one(spark, "2024-03-10 03:30:00", "No/Where")[0] == "no_zone"
    assert one(spark, "2024-03-10 03:30:00 QQT", ny)[0] == "no_zone"
    assert one(spark, "2024-03-10 03:30:00 IST", "Asia/Kolkata") == ("ok", 1_710_021_600_000_000)


def test_years(spark):
    assert one(spark, "Mar 15 10:53:20") == ("ok", COLLECTED)
    assert one(spark, "Mar 15 10:53:21") == ("ok", COLLECTED + 1_000_000 - 366 * 86_400_000_000)
    assert one(spark, "Feb 29 00:00:00", end=COLLECTED - 40 * 86_400_000_000) == ("ok", 1_582_934_400_000_000)
    assert one(spark, "Mar 15 10:53:20", end=None)[0] == "no_year"


def test_mixture_settles_day_and_month(spark):
    sure = [(k, f"{d}/02/2024 10:00:00", "eu", "UTC", COLLECTED) for k, d in enumerate((13, 21, 28))]
    got = normal(spark, [*sure, (10, "03/02/2024 10:00:00", "eu", "UTC", COLLECTED), (11, "03/02/2024 10:00:00", "alone", "UTC", COLLECTED), (12, "03/03/2024 10:00:00", "alone", "UTC", COLLECTED)])
    assert got[10] == ("ok", 1_706_954_400_000_000)
    assert got[11] == ("ambiguous", None)
    assert got[12] == ("ok", 1_709_460_000_000_000)


def test_times_of_nothing(spark):
    assert normal(spark, []) == {}


# log entries

def entries(spark, rows, end=COLLECTED):
    df = spark.createDataFrame(rows, "p string, n bigint, l string").withColumn("message", F.lit(0)).withColumn("path", F.lit(0))
    out = loglines.log_entries(df, F.col("p"), F.col("n"), F.col("l"), F.lit(end))
    return {(r["path"], r["line_number"]): (r["n_lines"], r["ts_us"], r["log_level"], r["component"], r["message"]) for r in out.collect()}


T0 = 1_709_632_799_000_000


def test_layouts(spark):
    lines = [
        ("2024-03-05T09:59:59.000000000 12.5s warn: info block rewritten", "warning", "none", "info block rewritten"),
        ("2024/03/05 09:59:59 [crit] 12#12: a: b", "critical", "none", "a: b"),
        ('time="2024-03-05T09:59:59Z" level=error msg="say \\"hi\\"" module=wal x=1', "error", "wal", 'say "hi"'),
        ('Mar  5 09:59:59 n1 dockerd[7]: time="2024-03-05T09:59:59Z" level=fatal msg="m" module=raft', "critical", "raft", "m"),
        ("Mar  5 09:59:59 n1 kernel: [12.5] warning x", "none", "kernel", "[12.5] warning x"),
        ('{"level":"info","ts":"2024-03-05T09:59:59Z","caller":"raft/bond.go:181","logger":"x","msg":"m\\u00e4"}', "info", "raft/bond.go", "mä"),
        ("2024-03-05T09:59:59.000Z\t\x1b[31mDEBUG\x1b[0m\tmvcc\tm\tt", "debug", "mvcc", "m\tt"),
        ("E0305 09:59:59.000000   12 arp_x.go:84] m", "error", "arp_x.go", "m"),
        ("2024-03-05 09:59:59,000 WARNING  ucp.a.b [MainThread] - m - k", "warning", "ucp.a.b", "m - k"),
        ("[2024-03-05T09:59:59,000][INFO ][o.x.Service] m", "info", "o.x.Service", "m"),
        ('<11>1 2024-03-05T10:59:59.000+01:00 n1 app 3 - [a@1 q="x"] m', "error", "app", "m"),
        ("<13>1 2024-03-05T09:59:59Z n1 - 3 - - m", "info", "none", "m"),
    ]
    got = entries(spark, [("f", k + 1, line + "\r") for k, (line, *_) in enumerate(lines)])
    assert got == {("f", k + 1): (1, T0, level, comp, msg) for k, (_, level, comp, msg) in enumerate(lines)}


def test_entries_over_lines(spark):
    h = "2024-03-05 09:59:59,000 INFO x - m"
    rows = [("f", 1, "before"), ("f", 2, h), ("f", 3, "\tat a\r"), ("f", 4, None), ("f", 5, "2024-03-05 is a date"), ("f", 5, "2024-03-05 is a date"), ("f", 6, h), ("g", 1, ""), ("g", 2, "no header"), (None, 1, h), ("h", None, h), ("f", 7, "y" * 200_000)]
    got = entries(spark, rows)
    assert got == {("f", 2): (4, T0, "info", "x", "m\n\tat a\n\n2024-03-05 is a date"), ("f", 6): (2, T0, "info", "x", "m\n" + "y" * 200_000)}


def test_long_entry_over_partitions(spark):
    h = "2024-03-05 09:59:59,000 INFO x - m"
    rows = [("f", 1, h)] + [("f", k, f"more {k}") for k in range(2, 4000)] + [("f", 4000, h)]
    got = entries(spark, rows)
    assert got[("f", 1)][0] == 3999 and got[("f", 1)][4] == "m\n" + "\n".join(f"more {k}" for k in range(2, 4000))
    assert got[("f", 4000)][0] == 1 and len(got) == 2


def test_entries_with_joined_templates(spark, monkeypatch):
    rows = [("f", k, f"2024-03-05 09:59:{k:02},000 INFO x.{k % 3} - took {k}") for k in range(40)] + [("f", 40, "more")]
    want = entries(spark, rows)
    monkeypatch.setattr(loglines, "PLANS", 0)
    assert entries(spark, rows) == want and len(want) == 40 and want[("f", 39)][0] == 2


def test_entries_of_nothing(spark):
    assert entries(spark, []) == {}
    assert entries(spark, [("f", 1, "x")]) == {}


def leaved(spark, lines):
    masks = spark.createDataFrame([(k, m, 1) for k, m in enumerate(dict.fromkeys(map(loglex.mask, lines)))], "pattern bigint, mask string, n bigint")
    return loglines.leaves(masks.mapInArrow(loglines.in_slots, loglines.SLOTS_DDL))


def test_templates_keep_constants_and_slots(spark):
    df = leaved(spark, [f"2024-03-05 09:59:59,000 INFO x.{a} - took {b} ms {c}" for a in "abcd" for b in "efgh" for c in "pq"])
    assert sorted(r["template"] for r in loglines.templates(df).collect()) == [["\x01", "INFO", "<*>", "-", "took", "<*>", "ms", c] for c in "pq"]


def test_headers_that_no_list_names(spark):
    cases = [
        ("2024-03-05T09:59:59Z [main] ERROR c.x.Y - hi", ("error", "c.x.Y", "hi")),
        ('1.2.3.4 - - [05/Mar/2024:10:59:59 +0100] "GET /" 200', ("none", "none", '"GET /" 200')),
        ("2024-03-05 09:59:59.000  WARN 1 --- [main] c.x.Y : hi", ("warning", "c.x.Y", "hi")),
        ("2024-03-05 09:59:59,000 - a.b - INFO - m - n", ("info", "a.b", "m - n")),
        ("2024-03-05 09:59:59.000 | INFO     | app.mod:go:12 - hello", ("info", "app.mod:go:12", "hello")),
        ("Tue Mar  5 09:59:59 2024 [notice] 12#12: *3 m", ("info", "none", "m")),
        ("web_1  | 2024-03-05 09:59:59 CRITICAL down", ("critical", "none", "down")),
        ("2024-03-05 09:59:59 w1 x2 x3 x4 x5 x6 x7", ("none", "none", "w1 x2 x3 x4 x5 x6 x7")),
        ("10.0.0.1 7 [a] [b] [c] 2024-03-05 09:59:59 DEBUG [cron] m", ("debug", "cron", "m")),
    ]
    got = entries(spark, [(f"f{k}", 1, line) for k, (line, _) in enumerate(cases)])
    assert got == {(f"f{k}", 1): (1, T0, *want) for k, (_, want) in enumerate(cases)}


def test_templates_decide_what_a_word_is(spark):
    """A level word at the start of a message is a level only if the templates of the shape have levels there."""
    first = lambda rows: entries(spark, rows)[("f", 1)][2:]
    line = "2024-03-05 09:59:59 error reading block"
    assert first([("f", 1, line)]) == ("error", "none", "reading block")
    others = [("f", k, f"2024-03-05 09:59:59 {w} reading block") for k, w in enumerate(("new", "slow", "late"), 2)]
    assert first([("f", 1, line), *others]) == ("none", "none", "error reading block")
    levels = [("f", k, f"2024-03-05 09:59:59 {w} reading block") for k, w in enumerate(("INFO", "WARN", "debug"), 5)]
    assert first([("f", 1, line), *others, *levels])[0] == "error"


def test_words_before_a_time_begin_no_entry(spark):
    rows = [("f", 1, "2024-03-05 09:59:59 INFO x: m"), ("f", 2, "-- Logs begin at Sat 2024-01-06 00:36:25 UTC. --"), ("f", 3, "see 2024-01-06 00:36:25"), ("f", 4, '{"a": "2024-01-06 00:36:25"}'), ("f", 5, "a=1 b=2")]
    assert [v[0] for v in entries(spark, rows).values()] == [5]


# storms, windows, bursts, findings

def test_storms_like_two_pointers(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randrange(300), k) for k in range(300)]
    want = Counter()
    for kind in "ab":
        own = sorted((us, k) for x, us, k in rows if x == kind)
        j = 0
        for i, (us, k) in enumerate(own):
            while us - own[j][0] > 10:
                j += 1
            if i - j + 1 == 6:
                want[(k, own[j][0])] += 1
    df = spark.createDataFrame(rows, "kind string, us bigint, id int")
    got = Counter((x["id"], x["window_start_us"]) for x in frames.storms(df, ["kind"], "us", "id", 10, 6).collect())
    assert got == want and want


def test_bursts_like_greedy(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", None]), r.randrange(500), k) for k in range(200)]
    want = Counter()
    for key in ("a", None):
        start = last = None
        size = 0
        for us in sorted(us for x, us, _ in rows if x == key):
            if start is None or us - last > 5 or us - start > 20:
                if size >= 3:
                    want[(key, start, size)] += 1
                start, size = us, 0
            size, last = size + 1, us
        if size >= 3:
            want[(key, start, size)] += 1
    df = spark.createDataFrame(rows, "k string, us bigint, id int")
    got = bursts.burst_clusters(bursts.burst_members(df, ["k"], "us", 5, 20), ["k"], "us", 3)
    assert Counter((x["k"], x["start_us"], x["n"]) for x in got.collect()) == want


def test_findings_like_scan(spark):
    r = random.Random(3)
    s = 1_000_000
    rows = [(r.choice("ab"), r.choice("xyz"), r.randrange(400) * s) for _ in range(150)]
    h = Heuristic("h", (("x", 2), ("y", 1)), 20, 0.9, supports=("z",))
    want = Counter()
    for scope in "ab":
        own = [(k, us) for c, k, us in rows if c == scope]
        last, n = None, 0
        for t in sorted({us for k, us in own if k in "xy"}):
            inside = [k for k, us in own if t <= us <= t + 20 * s]
            if n < 5 and (last is None or t > last + 20 * s) and inside.count("x") >= 2 and inside.count("y") >= 1:
                want[(scope, t, inside.count("x") + inside.count("y"), round(min(0.99, 0.9 + 0.05 * ("z" in inside)), 3))] += 1
                last, n = t, n + 1
    df = spark.createDataFrame(rows, "c string, kind string, us bigint")
    got = findings.findings(df, ["c"], "kind", "us", (h,)).collect()
    assert Counter((x["c"], x["start_us"], x["n_threshold"], x["confidence"]) for x in got) == want and want


def test_timeline_keeps_what_matters(spark):
    rows = [("s", "e1", 1, "noisy", "high"), ("s", "e2", 2, "noisy", "critical"), ("s", "e3", 3, "noisy", "low"), ("s", "e4", 4, "calm", "low"), ("s", "e5", 5, "calm", "low"), ("s", "e6", 11, "calm", "low"), ("s", "e7", 12, "calm", "low"), ("s", "e8", None, "calm", "low"), ("s", "e9", 13, "noisy", "low")]
    events = spark.createDataFrame(rows, "c string, id string, us bigint, kind string, sev string")
    clusters = spark.createDataFrame([("s", "noisy", "k1", 1)], "c string, event_type string, cluster_id string, start_us bigint")
    refs = spark.createDataFrame([("s", "e9")], "c string, id string")
    got = timeline.timeline(events, clusters, ["c"], "us", "kind", "sev", "id", ("noisy",), refs, 10, 40).orderBy("place")
    assert [(r["kind"], r["id"]) for r in got.collect()] == [("cluster", "k1"), ("event", "e2"), ("event", "e4"), ("event", "e6"), ("event", "e9")]
    assert [r["id"] for r in timeline.timeline(events, clusters, ["c"], "us", "kind", "sev", "id", (), refs, 10, 3).orderBy("place").collect()] == ["k1", "e1", "e2"]


def test_windows_join_at_the_gap(spark):
    df = spark.createDataFrame([("a", 0), ("a", 120), ("a", 241), (None, 5), ("a", None)], "k string, us bigint")
    got = Counter((r["k"], r["us"], r["window"]) for r in incidents.with_windows(df, ["k"], "us", 120).collect())
    assert got == Counter([("a", 0, 1), ("a", 120, 1), ("a", 241, 2), (None, 5, 1)])


def test_byte_budget_stops_behind_the_line_that_goes_over(spark):
    df = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (2, 1, "cccc"), (2, 2, "dddd")], "f int, n int, l string")
    got = timeline.byte_budget(df, ["f", "n"], F.octet_length("l"), 9, "f")
    assert sorted((r["f"], r["n"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]


# redaction

def test_redaction_is_consistent_and_final(spark):
    texts = [(1, "from 10.0.0.9 to 10.1.2.3 by Ann@Example.com"), (2, "10.1.2.3, ann@example.com; mac 02:42:ac:11:00:02"), (3, None), (4, ""), (5, "nothing")]
    df = spark.createDataFrame(texts, "id int, t string")
    mapped = redact.mapping(redact.tokens(df, "t"))
    got = {r["id"]: (r["redacted"], r["n_replaced"]) for r in redact.rewrite(df, ["id"], "t", mapped).collect()}
    assert got[1] == ("from 10.0.1.1 to 10.0.1.2 by user001@example.invalid", 3)
    assert got[2] == ("10.0.1.2, user001@example.invalid; mac mac-001", 3)
    assert got[3][0] is None and got[4] == ("", 0) and got[5] == ("nothing", 0)


def test_spellings(spark):
    df = spark.createDataFrame([("[::ffff:10.0.0.1]:7946",), ("tcp://10.0.0.1:2377",), (" 10.0.0.1",), ("-",), ("",), (None,), ("Host-A ",)], "p string")
    got = [tuple(r) for r in df.select(spelling.peer_ipv4(F.col("p")), spelling.peer_port(F.col("p")), spelling.peer_name(F.col("p"))).collect()]
    assert got == [("10.0.0.1", 7946, "10.0.0.1"), ("10.0.0.1", 2377, "10.0.0.1"), ("10.0.0.1", None, "10.0.0.1"), (None, None, None), (None, None, None), (None, None, None), (None, None, "host-a")]


def test_zone_instants():
    z = times.zone("Europe/Berlin")
    assert z.instants(1_711_852_200_000_000)[0] == []  # 2024-03-31 02:30
    assert len(z.instants(1_729_996_200_000_000)[0]) == 2  # 2024-10-27 02:30


def test_plain_times_agree_with_the_readings():
    texts = ["2024-03-05T09:59:59.5Z", "2024/02/29 23:59:59,123456789", "2023-02-29 00:00:00", "2024-03-05T24:00:00Z", "2024-03-05T09:59:59", "2024-03/05 09:59:59", "x", "0000-01-01 00:00:00"]
    for t in texts:
        r = next(times.readings(t), None)
        assert times.plain_utc(t) == (times.resolve(r, times.zone("UTC"), None).us if r else None), t


def test_few_rows_join_many_with_and_without_salt(spark, monkeypatch):
    many = spark.createDataFrame([(k % 3, k) for k in range(100)], "key int, x int")
    few = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "key int, v string")
    want = sorted(map(tuple, many.join(few, "key").collect()))
    assert sorted(map(tuple, session.join_few(many, few, ["key"], "x").collect())) == want
    monkeypatch.setattr(session, "small", lambda df: df)
    assert sorted(map(tuple, session.join_few(many, few, ["key"], "x").collect())) == want


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(Session())
