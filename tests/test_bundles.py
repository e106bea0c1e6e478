"""Whole runs over small bundles made here."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from hashlib import sha1

import pytest
from pyspark.sql import functions as F

from logfathom import cli
from logfathom.functions import durations, payload, severity, spelling
from logfathom.functions import text as T
from logfathom.operators import filters, inventory, journal, matching, redact, snapshot, timeline
from logfathom.plans import cluster, pipelines
from logfathom.rules import lint, loader, packs
from logfathom.sinks import tables
from logfathom.sources import archive, files, lines


@pytest.fixture
def bundle(tmp_path):
    root = tmp_path / "host"
    logs = root / "var/log"
    logs.mkdir(parents=True)
    rows = [f'time="2024-03-05T10:00:{k:02}Z" msg="memberlist: Suspect probe of 10.0.0.{k % 3}:7946, no acks received after 9ms"' for k in range(12)]
    rows += [f'time="2024-03-05T10:01:{k:02}Z" msg="dial tcp 10.0.0.9:2377: connection refused"' for k in range(4)]
    rows += ['time="2024-03-05T10:02:00Z" msg="raft: lost leader"', "no time: Killed process 7", "Ann ann@corp.example on 10.0.0.1"]
    (logs / "docker.log").write_text("\n".join(rows) + "\n", encoding="utf-8")
    (logs / "messages.gz").write_bytes(b"\x00\x01")
    (root / "other.txt").write_text("nothing", encoding="utf-8")
    return root


def test_triage(spark, bundle, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    ledger = pipelines.triage(spark, str(bundle), str(out))
    assert ledger["events"] > 0 and ledger["scan"]["scanned"] == 1
    events = spark.read.json(str(out / "events"))
    assert events.where("signature_id = 'memberlist_timeout'").count() == 12
    assert {r["event_type"] for r in spark.read.json(str(out / "clusters")).collect()} == {"memberlist_timeout", "raft_peer_connect_error"}
    grouped = sorted((r["cluster_id"], r["event_type"], r["peer"], r["n"], [x["source_relpath"] for x in r["top_source_relpaths"]]) for r in spark.read.json(str(out / "clusters")).collect())
    assert [g[0] for g in grouped] == [f"clu_{k + 1:06}" for k in range(len(grouped))] and [g[1:3] for g in grouped] == sorted(g[1:3] for g in grouped)
    assert all(g[4] == ["var/log/docker.log"] for g in grouped)
    assert spark.read.json(str(out / "cluster_members")).count() >= sum(g[3] for g in grouped)
    found = {r["heuristic_id"] for r in spark.read.json(str(out / "findings")).collect()}
    assert found == {"swarm_gossip_instability", "leadership_loss_present"}
    report = (out / "report.md").read_text(encoding="utf-8")
    assert "memberlist_timeout" in report and "leadership_loss_present" in report
    assert json.loads((out / "meta.json").read_text())["schema_version"] == "meta-v1"
    with pytest.raises(Exception, match="(?i)exist"):
        pipelines.triage(spark, str(bundle), str(out))
    assert "error" in json.loads((out / "meta.json").read_text())


def test_store_incidents(spark, tmp_path):
    log = tmp_path / "n1/ucp-kv.log"
    log.parent.mkdir()
    row = '{{"ts":"2024-03-05T10:{m:02}:{s:02}Z","msg":"{msg}","took":"{took}","expected-duration":"100ms"}}'
    rows = [row.format(m=0, s=k, msg="slow fdatasync", took="2.5s") for k in range(3)] + [row.format(m=9, s=0, msg="apply request took too long", took="120ms"), "no event"]
    log.write_text("\n".join(rows), encoding="utf-8")
    got = sorted((r["window"], r["n_events"], r["max_severity"]) for r in pipelines.store_incidents(spark, str(tmp_path), str(tmp_path / "out")).collect())
    assert got == [(1, 4, "critical"), (2, 1, "medium")]
    with pytest.raises(files.ScanError):
        pipelines.scan_patterns(spark, _empty(tmp_path))


def _empty(tmp_path):
    d = tmp_path / "empty"
    d.mkdir()
    (d / "x.bin").write_bytes(b"\x00")
    return str(d)


def test_scan_and_redact(spark, bundle, tmp_path):
    hits = {r["pattern"]: r["n"] for r in pipelines.scan_patterns(spark, str(bundle), ("onnection refused", "never")).collect()}
    assert hits == {"onnection refused": 4, "never": 0}
    assert {r["n"] for r in pipelines.scan_patterns(spark, str(bundle), ("onnection refused",), "2024-03-06", 0).collect()} == {0}
    counts = {r["entity"]: r["n"] for r in pipelines.redact_tree(spark, str(bundle), str(tmp_path / "red")).collect()}
    assert counts == {"email": 1, "ip": 17}
    text = (tmp_path / "red/tree/var/log/docker.log").read_text(encoding="utf-8")
    assert "ann@corp.example" not in text and "user001@example.invalid" in text and len(text.splitlines()) == 19
    assert (tmp_path / "red/tree/var/log/messages.gz").read_bytes() == b"\x00\x01"
    assert json.loads((tmp_path / "red/report.json").read_text())["files"] == {"changed": 1, "copied": 1, "unchanged": 1}


def test_redaction_end_to_end(spark, tmp_path):
    """No seeded or found name is left anywhere in the tree: not in texts, not in paths."""
    root = tmp_path / "in"
    node, cluster, full, short = "k3v9q1x7z5m2n8b4c6d0f1g2h", "cl9q1x7z5m2n8b4c6d0f1g2hq", "ab" * 32, "0123456789ab"
    (root / "Host-A.corp.example/logs").mkdir(parents=True)
    (root / "Host-A.corp.example/logs/host-b.toml").write_text(f'url = "https://u@host-a.corp.example:2377/x?y=HOST-B"\nid = "{node}"\n', encoding="utf-8")
    (root / "a.log").write_text(f'DNS:host-a.corp.example, CN=host-b\n"Id": "{full}"\nhostname: {short} {short}\nplain {full} {cluster}\naa:bb:cc:dd:ee:ff 10.9.8.7 Z@corp.example\nbe host-c, not myhost-b', encoding="utf-8")
    (root / f"{full}.bin").write_bytes(b"\xff\x00")
    (root / "ucp-nodes.txt").write_text(json.dumps([{"ID": "nodeid2", "Description": {"Hostname": "host-c"}, "Status": {"Addr": "10.1.1.1"}}]), encoding="utf-8")
    (tmp_path / "nodes.csv").write_text(f"HOSTNAME;IP/MASK;CLUSTER-ID;NODE-ID;X\nhost-a.corp.example;10.9.8.7/24;{cluster};{node};1\nhost-b;;;;2\n", encoding="utf-8")
    pipelines.redact_tree(spark, str(root), str(tmp_path / "out"), str(tmp_path / "nodes.csv"))
    tree = tmp_path / "out/tree"
    got = {str(p.relative_to(tree)): p.read_bytes() for p in tree.rglob("*") if p.is_file()}
    assert len(got) == 4
    for name, body in got.items():
        for secret in ("host-a", "host-b", "host-c,", "host-c\"", node, cluster, full, short, "aa:bb", "10.9.8.7", "z@corp", "nodeid2"):
            text = f"{name}\n{body.decode('utf-8', 'replace')}".lower()
            assert secret not in text.replace("myhost-b", "")
    assert b"myhost-b" in got["a.log"]
    report = json.loads((tmp_path / "out/report.json").read_text())
    assert report["files"] == {"changed": 3, "copied": 1} and report["renamed_paths"] == 2
    rows = lines.read_semicolon_csv(spark, str(tmp_path / "out/nodes")).collect()
    assert {r["NODE-ID"] for r in rows} == {"node-001", None} and all("example.invalid" in r["HOSTNAME"] for r in rows)
    changed = {r["path"]: r["total_replacements"] for r in spark.read.json(str(tmp_path / "out/changed_files")).collect()}
    assert len(changed) == 3 and changed["a.log"] == 11
    texts = spark.createDataFrame([(1, "see host-b.log on host-a.corp.example"), (2, None), (3, "none"), (None, "host-b host-b")], "k int, t string")
    mapped = spark.read.json(str(tmp_path / "out/mapping"))
    every = [sorted(map(tuple, redact.rewrite(texts, ["k"], "t", mapped, (*redact.CLASSES, "host"), most, True, True).withColumn("replaced", F.to_json("replaced")).collect()), key=str) for most in (0, 1000)]
    assert every[0] == every[1] and every[0][0][1] == "see host-002.example.invalid.log on host-001.example.invalid"
    (root / "A.LOG").write_text("x", encoding="utf-8")
    with pytest.raises(files.ScanError):
        pipelines.redact_tree(spark, str(root), str(tmp_path / "out2"))


def test_pattern_report(spark, bundle, tmp_path):
    pipelines.scan_report(spark, str(bundle), str(tmp_path / "r"), ("onnection refused", "never"), "2024-03-05", 1)
    got = {r["pattern"]: (r["n"], r["date_breakdown"].asDict()) for r in spark.read.json(str(tmp_path / "r/patterns")).collect()}
    assert got == {"onnection refused": (4, {"2024-03-04": 0, "2024-03-05": 4, "2024-03-06": 0}), "never": (0, {"2024-03-04": 0, "2024-03-05": 0, "2024-03-06": 0})}
    row = spark.read.json(str(tmp_path / "r/files")).first()
    assert "10:01:00Z" in row["first_line"] and "10:01:03Z" in row["last_line"]
    assert "2024-03-05" in (tmp_path / "r/summary.md").read_text(encoding="utf-8")


STATUS = """http://10.0.0.1:2379 is healthy: successfully committed proposal: took = 2.5ms
http://10.0.0.2:2379 is unhealthy: failed to commit proposal: took = 1.2s
+------+
| ENDPOINT | ID | IS LEADER | IS LEARNER | RAFT TERM | RAFT INDEX | RAFT APPLIED INDEX |
+------+
| http://10.0.0.1:2379 | a1 | {leads} | false | 7 | {index} | 90 |
| http://10.0.0.2:2379 | a2 | false | true | 7 | 300 | 95 |
| broken | row |
m1: name=n1 peerURLs=http://10.0.0.1:2380,http://x:2380 clientURLs=http://10.0.0.1:2379 isLeader=true
member a2 name=n2 peerURLs=http://10.0.0.2:2380 isLearner=true
a1b2c3d4e5f60718, started, n3, http://10.0.0.3:2380, http://10.0.0.3:2379, false
not: a member
"""


def test_cluster_run(spark, tmp_path):
    root = tmp_path / "c"
    for k, host in enumerate(("n1", "n2", "n3")):
        (root / host).mkdir(parents=True)
        if host != "n3":
            (root / host / "etcd-status.txt").write_text(STATUS.format(leads="true", index=100 + k), encoding="utf-8")
        (root / host / "journalctl-daemon.log").write_text("\n".join(f'time="2024-03-05T10:00:0{i}Z" dial tcp 10.0.0.{i}:2377: connect: connection refused, retrying in {i}s' for i in range(1, 5)) + "\nx", encoding="utf-8")
    (root / "n2/dsinfo.txt").write_text("Hostname: real-n2\n Kernel Version: 5.4\n    inet 10.0.0.1/24 brd\n", encoding="utf-8")
    (root / "n1/ucp-kv.log").write_text("\n".join(f'{{"ts":"2024-03-05T10:00:0{k}Z","msg":"slow fdatasync","took":"2.5s"}}' for k in range(3)), encoding="utf-8")
    nodes = {r["host"]: r for r in cluster.cluster_incidents(spark, str(root), str(tmp_path / "o")).collect()}
    assert nodes["n3"]["skipped"] == "journal only" and nodes["n1"]["skipped"] is None and nodes["n1"]["n_events"] == 4
    assert (nodes["n2"]["hostname"], nodes["n2"]["ip"], nodes["n2"]["leader"]) == ("real-n2", "10.0.0.1", "http://10.0.0.1:2379")
    read = lambda name: [r.asDict(True) for r in spark.read.json(str(tmp_path / "o" / name)).collect()]
    (one,) = read("synthesis")
    assert (one["leader"], one["n_votes"], one["stable"], one["index_drift"], one["concerning"], one["n_learners"], one["max_ms"]) == ("http://10.0.0.1:2379", 4, True, 200, True, 2, 1200.0)
    assert len(read("members")) == 6 and {m["name"] for m in read("members")} == {"n1", "n2", "n3"}
    (slow,) = read("slow_endpoints")
    assert (slow["endpoint"], slow["n_seen"], slow["pattern"], slow["significant"]) == ("http://10.0.0.2:2379", 2, "sustained", True)
    assert {(g["n"], g["retry_intervals"]) for g in read("journal_groups")} == {(4, "1s,2s,3s,4s")}
    assert len(read("journal_targets")) == 12
    assert {e["kind"] for e in spark.read.option("header", True).csv(str(tmp_path / "o/events")).collect()} == {"slow_fdatasync", "storm_slow_fdatasync"}
    assert len(spark.read.option("header", True).csv(str(tmp_path / "o/events")).columns) == 14
    inc = read("incidents")[0]
    assert inc["event_counts"]["slow_fdatasync"] == 3 and inc["max_duration_ms_by_kind"] == {"slow_fdatasync": 2500.0} and inc["duration_ms"] == 2000
    report = (tmp_path / "o/cluster.md").read_text(encoding="utf-8")
    assert report.index("| n2 |") < report.index("| n1 |") and "4" in report and json.loads((tmp_path / "o/bundle.json").read_text())["counts"]["nodes_skipped"] == 1


def test_many_store_logs_and_large_ids(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"b/h{k}").mkdir(parents=True)
        (tmp_path / f"b/h{k}/ucp-kv.log").write_text('{"ts":"2024-03-05T10:00:00Z","msg":"slow fdatasync","took":"2.5s"}\n', encoding="utf-8")
    assert pipelines.store_incidents(spark, str(tmp_path / "b"), str(tmp_path / "o")).count() == 30
    ids = spark.createDataFrame([(f"evt_{k}",) for k in (1_000_000, 999_999, 999_998)], "event_id string")
    assert [r["event_id"] for r in ids.orderBy(F.length("event_id"), "event_id").limit(2).collect()] == ["evt_999998", "evt_999999"]


def test_great_files_are_read_in_blocks(spark, tmp_path):
    body = "".join(f"line {k}\r\n" for k in range(5000)) + "last"
    (tmp_path / "d e").mkdir()
    (tmp_path / "d e/a+b.log").write_text(body, encoding="utf-8", newline="")
    (tmp_path / "s.log").write_text("x\ny\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = {(r["source_relpath"], r["line_number"]): r["line"] for r in lines.lines_of(files.list_files(spark, str(tmp_path)), 1000).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {("s.log", 1): "x", ("s.log", 2): "y"} | {("d e/a+b.log", k + 1): f"line {k}\r" for k in range(5000)} | {("d e/a+b.log", 5001): "last"}


def test_inventory_run(spark, tmp_path):
    (tmp_path / "nodes.json").write_text(json.dumps([{"ID": "abcdefghijkl", "Description": {"Hostname": "N1", "Resources": {"NanoCPUs": 4_000_000_000, "MemoryBytes": 1 << 33}}, "Spec": {"Role": "worker"}}, {"ID": "b", "Description": {"Hostname": "n2"}, "Spec": {"Role": "manager"}}]), encoding="utf-8")
    (tmp_path / "f/n1").mkdir(parents=True)
    (tmp_path / "f/n1/dsinfo.txt").write_text("Hostname: n1\nOperating System: Ubuntu 22.04\n Kernel Version: 5.15\n 10:00:00 up 3 days, 2 users\n", encoding="utf-8")
    rows = {r["hostname"]: r for r in pipelines.node_inventory(spark, str(tmp_path / "nodes.json"), str(tmp_path / "f"), str(tmp_path / "o")).collect()}
    assert (rows["N1"]["system"], rows["N1"]["kernel"], rows["N1"]["cpus"], rows["N1"]["uptime"]) == ("Ubuntu 22.04", "5.15", 4, "3 days") and rows["n2"]["role"] == "BAD-Manager"
    assert spark.read.json(str(tmp_path / "o/stats")).first()["kernels"] == ["5.15"]
    assert lines.read_semicolon_csv(spark, str(tmp_path / "o/nodes_csv")).count() == 2


def test_archives(tmp_path):
    good, bad, link = tmp_path / "a.tar.gz", tmp_path / "b.zip", tmp_path / "c.tar"
    with tarfile.open(good, "w:gz") as t:
        for name in ("top/var/log/messages", "top/etc/passwd"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"ok"))
    assert [p.rsplit("/", 1)[-1] for p in archive.extract(str(good), str(tmp_path / "x"), "fast")] == ["messages"]
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(archive.ArchiveError):
        archive.extract(str(bad), str(tmp_path / "y"))
    with tarfile.open(link, "w") as t:
        info = tarfile.TarInfo("top/l")
        info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(info)
    with pytest.raises(archive.ArchiveError):
        archive.extract(str(link), str(tmp_path / "z"))
    with pytest.raises(archive.ArchiveError):
        archive.extract(__file__, str(tmp_path / "z"))


def test_lines_of_files(spark, tmp_path):
    p = tmp_path / "a.log"
    p.write_bytes(b"one\r\n\nthree")
    got = sorted((r["line_number"], r["line"]) for r in lines.read_lines(spark, [f"file:{p}"]).collect())
    assert got == [(1, "one\r"), (2, ""), (3, "three")]


def test_rules():
    for pack in (packs.STORE, packs.JOURNAL, packs.HOST):
        assert not [p for p in lint.check(pack) if p.level == "error"]
    assert lint.summary(packs.STORE)["patterns"] == 31 and lint.summary(packs.HOST)["patterns"] == 30 and len(packs.PATTERNS) == 68
    with pytest.raises(loader.RuleError) as e:
        loader.from_dict({"signatures": [{"id": "a", "event_type": "a", "severity": "bad", "patterns": ["("]}], "heuristics": [{"id": "h", "thresholds": {"b": 1}, "window_s": 1, "weight": 1}]})
    assert len(e.value.problems) == 3
    assert lint.java_pattern("x{y}z(?P<n>a{2})") == "x\\{y\\}z(a{2})"


def test_patterns_compile_in_the_engine(spark):
    df = spark.createDataFrame([('FieldPath:"spec.containers{calico-node}"}, Reason:"Unhealthy", Message:"Liveness probe failed: x',)], "line string").selectExpr("'f' path", "1L number", "line")
    got = matching.count_patterns(df, "path", "number", "line", packs.PATTERNS)
    assert got.count() == 1


def test_command_line(capsys):
    assert cli.main(["lint"]) == 0
    assert cli.main(["incidents", "nowhere", "--time", "noon"]) == 2
    assert "store" in capsys.readouterr().out


def test_nodes(spark, tmp_path):
    body = [{"ID": "abcdefghijkl", "Description": {"Hostname": "b", "Resources": {"NanoCPUs": 4_000_000_000, "MemoryBytes": 8 << 30}}, "Spec": {"Role": "manager"}, "ManagerStatus": {"Leader": True}, "UpdatedAt": "2024-03-05T10:00:00.123Z"}, {"ID": "x", "Spec": {"Role": "manager"}}, {"ID": " ", "Spec": {"Role": "worker"}}, {"ID": "y", "Spec": {"Role": "worker"}}]
    p = tmp_path / "nodes.json"
    p.write_text(json.dumps(body), encoding="utf-8")
    got = [(r["node_id"], r["role"], r["cpus"], r["ram_gib"], r["updated"]) for r in pipelines.node_inventory(spark, str(p)).collect()]
    assert got == [("x", "BAD-Manager", None, None, None), ("abcdefghij", "leader", 4, 8.0, "2024-03-05_10:00:00"), ("y", "worker", None, None, None)]


def test_status_tables(spark):
    text = "\n".join(["+---+", "| ENDPOINT | RAFT TERM |", "+---+", "| 10.0.0.1:2379 | 5 |", "| bad |", "| ENDPOINT | HEALTH | TOOK |", "| e1 | true | 9ms |"])
    df = spark.createDataFrame([("n", text)], "host string, t string")
    got = [(r["section"], r["cells"]) for r in snapshot.table_rows(df, ["host"], "t").collect()]
    assert got == [(1, {"endpoint": "10.0.0.1:2379", "raft_term": "5"}), (2, {"endpoint": "e1", "health": "true", "took": "9ms"})]
    one = spark.createDataFrame([("https://10.0.0.1:2379 is healthy: successfully committed proposal: took = 1.5ms",), ("x",)], "l string")
    assert [r[0] and (r[0]["endpoint"], r[0]["healthy"], r[0]["took_ms"]) for r in one.select(snapshot.health_line(F.col("l"))).collect()] == [("https://10.0.0.1:2379", True, 1.5), None]
    member = spark.createDataFrame([("8e9e05c52164694d, started, n1, https://a:2380, https://a:2379, false",), ("x: y",)], "l string")
    assert [r[0] and (r[0]["name"], r[0]["learner"]) for r in member.select(snapshot.member_line(F.col("l"))).collect()] == [("n1", False), None]


def test_text_functions(spark):
    df = spark.createDataFrame([("  a \t b ",)], "s string")
    assert df.select(T.squeeze(F.col("s"))).first()[0] == "a b"
    assert df.select(T.shorten(F.lit("abcdef"), 4)).first()[0] == "abc…"
    assert df.select(T.stable_hash(F.lit("a"), F.lit(None), F.lit(1))).first()[0] == sha1(b"a||1").hexdigest()[:12]
    want = {"1.5s": 1.5, "20ms": 0.02, "30µs": 3e-5, "40ns": 4e-8, "5m": None, "x": None}
    d = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r[0]: r[1] for r in d.select("s", durations.seconds(F.col("s"))).collect()} == want
    assert severity.allowed([2, 1]) == ["critical", "high"]
    with pytest.raises(ValueError):
        severity.allowed([5])


def test_payloads(spark):
    df = spark.createDataFrame([('x {"ts":"a","n":1}',), ("[1]",), ("{bad",), (None,)], "l string")
    assert [r[0] for r in df.select(payload.json_payload(F.col("l"))).collect()] == ['{"ts":"a","n":1}', None, None, None]
    assert [r[0] for r in df.select(payload.payload_value(F.col("l"), "time", "ts")).collect()] == ["a", None, None, None]
    d = spark.createDataFrame([("31/12/2024",), ("31/02/2024",), ("2024-12-31",)], "s string")
    assert [str(r[0]) for r in d.select(payload.day_month_year(F.col("s"))).collect()] == ["2024-12-31", "None", "None"]
    assert d.select(payload.after(F.lit("Kernel: 5.1"), "Kernel:")).first()[0] == "5.1"
    assert d.select(payload.assignment(F.lit('NAME="x y"'), "NAME")).first()[0] == "x y"
    assert d.select(spelling.host_key(F.lit(" Host A "))).first()[0] == "hosta"


def test_synthesis(spark):
    status = spark.createDataFrame([("c", f"h{k}", f"e{k}", 5, 100 + k * 80, 90 + k, False, "e1" if k else None) for k in range(3)], "scope string, host string, endpoint string, term int, raft_index int, applied_index int, is_learner boolean, leader string")
    health = spark.createDataFrame([("c", "e0", 10.0), ("c", "e1", 200.0), ("c", "e1", 20.0), ("c", "e2", None)], "scope string, endpoint string, took_ms double")
    r = snapshot.synthesis(status, health, ["scope"]).first()
    assert (r["n_terms"], r["index_drift"], r["concerning"], r["leader"], r["n_votes"], r["stable"], r["slowest"], r["risk"]) == (1, 160, True, "e1", 2, False, "e1", "ok")
    assert [(s["endpoint"], s["pattern"], s["significant"]) for s in r["slow_endpoints"]] == [("e1", "intermittent", True)]


def test_seeded_redaction(spark):
    nodes = spark.createDataFrame([("WRK-1.corp.example", "10.0.0.1", "c1", "n1"), ("mgr-2", " ", None, "n2")], "h string, a string, c string, i string")
    mapped = redact.with_short_hosts(redact.mapping(redact.seeds(nodes, "h", "a", "c", "i")))
    text = spark.createDataFrame([(1, "https://ops@wrk-1.corp.example:8443/x DNS:MGR-2, wrk-1 wrk-11 10.0.0.1")], "id int, t string")
    got = redact.rewrite(text, ["id"], "t", mapped, ("ip", "host")).first()
    assert got["redacted"] == "https://ops@host-002.example.invalid:8443/x DNS:host-001.example.invalid, host-002 wrk-11 10.0.1.1" and got["n_replaced"] == 4


def test_globs():
    assert filters.days_around("2024-03-01", 1) == ["2024-02-29", "2024-03-01", "2024-03-02"]


def test_discovery(spark):
    df = spark.createDataFrame([("var/log/docker/x/y.log", 5), ("var/log/docker.gz", 5), ("var/log/messages", 500), ("etc/x", 1), ("a/core.1", 1)], "relpath string, size bigint")
    got = {r["relpath"]: r["glob"] for r in filters.discover(df, F.col("relpath"), packs.INCLUDE, packs.EXCLUDE).collect()}
    assert got == {"var/log/docker/x/y.log": 0, "var/log/messages": 2}
    stats = {r["outcome"]: r["n"] for r in filters.discovery_statistics(df, F.col("relpath"), "size", packs.INCLUDE, packs.EXCLUDE, 100).collect()}
    assert stats == {"taken": 1, "excluded": 2, "too_large": 1, "unmatched": 1}


def test_sections(spark):
    rows = ["Name: n1", "Allocated resources:", "  nvidia.com/gpu 0", "", "Name: n2", "nvidia.com/gpu", "Allocated resources:", "", "nvidia.com/gpu"]
    df = spark.createDataFrame([("f", k, r) for k, r in enumerate(rows)], "f string, n int, line string")
    got = {r["section"]: r["found"] for r in inventory.sections(df, ["f"], "n", "line", "Name:", "Allocated resources:", "nvidia.com/gpu").collect()}
    assert got == {"n1": True, "n2": False}


def test_journal_flatten(spark):
    df = spark.createDataFrame([('{"b":"x","a":1,"c":{"d":2}}',)], "m string")
    assert df.select(journal.flatten_message("m")).first()[0] == "x 1"


def test_context_over_slots(spark):
    df = spark.createDataFrame([("f", k, str(k)) for k in range(1, 200)], "p string, n bigint, l string")
    got = {r["n"]: (r["pre"], r["post"]) for r in timeline.context(df, "p", "n", "l", 2, 1).collect()}
    assert got == {k: ([str(j) for j in (k - 2, k - 1) if j > 0], [str(k + 1)] if k < 199 else []) for k in range(1, 200)}


def test_table_text():
    assert list(tables.table_text([(1, None)], ("a", "bb"))) == ["a  bb", "1"]
    assert tables.safe_tag("a b/../c") == "a-b-..-c"
