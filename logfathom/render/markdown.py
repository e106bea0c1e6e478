"""Reports of small results, rendered on the driver."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from ..functions.text import html_escape

#: Rows shown of types, clusters, findings and the timeline.
TYPES, CLUSTERS, FINDINGS, TIMELINE = 20, 50, 10, 40


def instant(us: int | None) -> str:
    return "-" if us is None else datetime.fromtimestamp(us / 1e6, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def table(header: tuple[str, ...], rows: Iterable[tuple]) -> str:
    lines = [f"| {' | '.join(header)} |", f"|{'---|' * len(header)}"]
    lines += [f"| {' | '.join('-' if c is None else str(c).replace('|', chr(92) + '|') for c in r)} |" for r in rows]
    return "\n".join(lines)


def bar(n: int, most: int, width: int = 20) -> str:
    return "█" * (n * width // most if most else 0)


def triage_report(title: str, types: list, clusters: list, found: list, timeline: list) -> str:
    """The report of a triage run from collected, bounded results."""
    most = max((t["n"] for t in types), default=0)
    parts = [f"# {title}", "## Event types", table(("type", "events", "", "first", "last", "peers"), [(t["event_type"], t["n"], bar(t["n"], most), instant(t["first_us"]), instant(t["last_us"]), t["top_targets"]) for t in types[:TYPES]])]
    parts += ["## Findings", table(("finding", "severity", "confidence", "from", "to", "events"), [(f["heuristic_id"], f["severity"], f["confidence"], instant(f["start_us"]), instant(f["end_us"]), f["n_threshold"]) for f in found[:FINDINGS]]) if found else "None."]
    parts += ["## Clusters", table(("type", "peer", "port", "events", "from", "to"), [(c["event_type"], c["peer"], c["port"], c["n"], instant(c["start_us"]), instant(c["end_us"])) for c in clusters[:CLUSTERS]]) if clusters else "None."]
    parts += ["## Timeline", table(("time", "kind", "id"), [(instant(t["us"]), t["kind"], t["id"]) for t in timeline[:TIMELINE]]) if timeline else "None."]
    return "\n\n".join(parts) + "\n"


def incidents_report(title: str, windows: list) -> str:
    rows = [(w["source_relpath"], w["window"], instant(w["start_us"]), instant(w["end_us"]), w["n_events"], w["max_severity"]) for w in windows]
    return f"# {title}\n\n{table(('source', 'window', 'from', 'to', 'events', 'severity'), rows)}\n"


def redaction_html(counts: list) -> str:
    body = "".join(f"<tr><td>{html_escape(str(c['entity']))}</td><td>{c['n']}</td></tr>" for c in counts)
    return f"<!doctype html><meta charset='utf-8'><title>Replacements</title><table><tr><th>class</th><th>replacements</th></tr>{body}</table>"


def pattern_report(totals: list, most: int = 7) -> str:
    top = sorted((t for t in totals if t["n"]), key=lambda t: (-t["n"], t["pattern"]))[:most]
    high = top[0]["n"] if top else 0
    return "\n".join([f"{t['n']:>9} {bar(t['n'], high):<20} {t['pattern']}" for t in top]) + "\n"


def pattern_summary(title: str, totals: list[dict], most: int = 7) -> str:
    """The summary of a pattern scan: the densest patterns and, where dates were asked for, their days."""
    top = sorted((t for t in totals if t["n"]), key=lambda t: (-t["n"], t["pattern"]))[:most]
    high = top[0]["n"] if top else 0
    parts = [f"# {title}", f"{sum(t['n'] for t in totals)} hits of {len(totals)} patterns, {sum(not t['n'] for t in totals)} without a hit.", table(("hits", "", "pattern"), [(t["n"], bar(t["n"], high), t["pattern"]) for t in top]) if top else "None."]
    dated = [t for t in top if t.get("date_breakdown")]
    if dated:
        days = sorted(dated[0]["date_breakdown"])
        parts += ["## Days", table(("pattern", *days), [(t["pattern"], *(t["date_breakdown"][d] for d in days)) for t in dated])]
    return "\n\n".join(parts) + "\n"


def redaction_report(report: dict) -> str:
    parts = ["# Redaction", f"{report['renamed_paths']} paths renamed."]
    for title, key in (("Files", "files"), ("Replacements", "replacements_by_class"), ("Known entities", "seeded")):
        parts += [f"## {title}", table(("class", "n"), sorted(report[key].items())) if report[key] else "None."]
    return "\n\n".join(parts) + "\n"


def cluster_report(title: str, together: dict, nodes: list[dict], endpoints: list[dict], groups: list[dict], counts: dict) -> str:
    """The report of a cluster run, the leader's host first; says how many hosts are not shown."""
    keys = ("leader", "n_votes", "stable", "n_terms", "index_drift", "concerning", "n_members", "n_learners", "min_ms", "max_ms", "risk")
    parts = [f"# {title}", table(("", ""), [(k, together.get(k)) for k in keys]) if together else "No status tables."]
    parts += ["## Hosts", table(("host", "name", "address", "events", "windows"), [(n["host"], n["hostname"], n["ip"], n["n_events"], n["n_windows"]) for n in nodes]), f"{counts['nodes_analyzed'] - len(nodes)} more hosts, {counts['nodes_skipped']} skipped."]
    parts += ["## Slow endpoints", table(("endpoint", "host", "slow", "seen", "greatest ms", "pattern"), [(e["endpoint"], e["hostname"], e["n_slow"], e["n_seen"], e["max_ms"], e["pattern"]) for e in endpoints]) if endpoints else "None."]
    parts += ["## Repeating journal signatures", table(("lines", "label", "retries", "from", "to", "template"), [(g["n"], g["label"], g["retry_intervals"], instant(g["first_us"]), instant(g["last_us"]), g["template"]) for g in groups]) if groups else "None."]
    return "\n\n".join(parts) + "\n"
