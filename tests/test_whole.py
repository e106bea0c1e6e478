"""Results that have to be whole: nothing cut, sampled or skipped before its detector has seen it."""

from __future__ import annotations

from collections import defaultdict

from logfathom import cli
from logfathom.operators import findings
from logfathom.plans import pipelines
from logfathom.rules import packs
from logfathom.rules.model import Heuristic
from logfathom.sources import files


def test_evidence_of_supporting_types(spark):
    h = Heuristic("h", (("x", 3), ("y", 1)), 100, 0.9, supports=("s", "r", "none", "q", "p", "o"))
    rows = [("a", k, us, f"{k}{us:03}") for k, n in {"x": 4, "y": 1, "s": 5, "r": 1, "q": 2, "p": 9, "o": 2}.items() for us in range(0, n * 3, 3)]
    rows += [("a", "s", 101_000_000, "late"), ("b", "s", 1, "other")]
    events = spark.createDataFrame(rows, "c string, kind string, us bigint, id string")
    found = spark.createDataFrame([("a", "h", 1, 0, 100_000_000)], "c string, heuristic_id string, place int, start_us bigint, end_us bigint")
    got = defaultdict(list)
    for r in findings.evidence(found, events, ["c"], "kind", "us", "id", (h,)).orderBy("us", "event_id").collect():
        got[r["event_type"]].append(r["event_id"])
    # 3 + 1 of the thresholds, then 2 + 1 + 2 + 2 of the supports, and the last type has one row left of twelve
    assert got == {"x": ["x000", "x006", "x009"], "y": ["y000"], "s": ["s000", "s012"], "r": ["r000"], "q": ["q000", "q003"], "p": ["p000", "p024"], "o": ["o000"]}


def test_evidence_of_thresholds_is_never_cut(spark):
    h = Heuristic("h", tuple((k, 1) for k in "abcde"), 100, 0.9, supports=("s",))
    events = spark.createDataFrame([("c", k, us, f"{k}{us}") for k in "abcdes" for us in range(3)], "c string, kind string, us bigint, id string")
    found = spark.createDataFrame([("c", "h", 1, 0, 100)], "c string, heuristic_id string, place int, start_us bigint, end_us bigint")
    got = findings.evidence(found, events, ["c"], "kind", "us", "id", (h,)).collect()
    assert len(got) == 15 and "s" not in {r["event_type"] for r in got}


def test_all_store_logs_are_read(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(packs, "MOST_FILES", 1)
    for host in ("n1", "n2", "n3"):
        log = tmp_path / "in" / host / "ucp-kv.log"
        log.parent.mkdir(parents=True)
        minutes = range(0, 300, 3) if host == "n3" else range(0, 180, 3)
        log.write_text("\n".join(f'{{"ts":"2024-03-05T{m // 60:02}:{m % 60:02}:00Z","msg":"slow fdatasync","took":"2.5s","expected-duration":"100ms"}}' for m in minutes), encoding="utf-8")
    found = pipelines.store_incidents(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    want = {"n1/ucp-kv.log": 60, "n2/ucp-kv.log": 60, "n3/ucp-kv.log": 100}
    assert {r["source_relpath"]: r["count"] for r in found.groupBy("source_relpath").count().collect()} == want
    monkeypatch.setattr(cli.SparkSession.builder, "getOrCreate", lambda: spark)
    assert cli.main(["incidents", str(tmp_path / "in"), "--out", str(tmp_path / "again")]) == 0
    assert capsys.readouterr().out.count("ucp-kv.log") == 220


def test_report_has_the_most_frequent_targets(spark, tmp_path):
    logs = tmp_path / "host/var/log"
    logs.mkdir(parents=True)
    peers = [1, 2, 3, 4, 9, 9, 9, 8, 8]
    rows = [f'time="2024-03-05T10:00:{k:02}Z" msg="dial tcp 10.0.0.{p}:2377: connection refused"' for k, p in enumerate(peers)]
    (logs / "docker.log").write_text("\n".join(rows) + "\n", encoding="utf-8")
    out = tmp_path / "out"
    out.mkdir()
    pipelines.triage(spark, str(tmp_path / "host"), str(out))
    assert "10.0.0.9:2377, 10.0.0.8:2377, 10.0.0.1:2377" in (out / "report.md").read_text(encoding="utf-8")


def test_targets_without_peer_or_port(spark):
    events = spark.createDataFrame([("a", None, None), ("a", "p", None), ("a", None, "1"), ("a", None, "1"), ("b", None, None)], "event_type string, peer string, port string")
    assert [tuple(r) for r in pipelines.top_targets(events).collect()] == [("a", ":1, p:")]


def test_small_files_after_many_too_large_ones(spark):
    rows = [(f"/b/var/log/messages{k}", f"var/log/messages{k}", 90 if k < 5 else 20) for k in range(7)]
    listed = spark.createDataFrame(rows, "path string, relpath string, size bigint")
    chosen, stats = files.discover(listed, include=("var/log/*",), exclude=(), most_file_bytes=100, most_bytes=110, most_files=2)
    assert chosen == ["/b/var/log/messages0", "/b/var/log/messages5"] and stats["over_total"] == 4
