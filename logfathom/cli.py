"""Command line: triage, incidents, cluster, scan, redact, inventory, lint."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .render import markdown
from .rules import lint, loader, packs
from .sinks import tables

#: Exit codes: all well; bad rules or arguments; unpacking; reading; anything else; interrupted.
OK, CONFIG, EXTRACT, SCAN, OTHER, INTERRUPTED = 0, 2, 3, 4, 5, 130


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logfathom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("triage", "incidents", "cluster", "scan", "redact", "inventory"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--out", default="out")
        s.add_argument("--output-tag", help="a part added to the name of OUT")
        s.add_argument("--overwrite", action="store_true", help="replace what stands there; else that is an error")
        if name in ("triage", "incidents", "cluster"):
            s.add_argument("--level", default="1,2,3,4", help="1 critical to 4 low")
        if name in ("incidents", "cluster"):
            s.add_argument("--date", help="only this day, YYYY-MM-DD")
            s.add_argument("--days", type=int, default=0, help="and so many days around it")
            s.add_argument("--time", help="only around this instant, YYYY-MM-DDTHH:MM:SSZ")
            s.add_argument("--time-window", type=int, default=15, help="so many minutes before and after it")
        if name == "triage":
            s.add_argument("--max-events", type=int)
            s.add_argument("--no-cluster", action="store_true", help="events only")
        if name in ("triage", "incidents", "cluster", "redact"):
            s.add_argument("--extract-dir", help="unpack the archive at PATH here first, a folder that all executors see")
            s.add_argument("--extract-mode", choices=("fast", "journal", "full"), default="fast" if name == "triage" else "full")
        if name == "scan":
            s.add_argument("--patterns")
            s.add_argument("--date")
            s.add_argument("--date-window-days", type=int, default=0)
        if name == "redact":
            s.add_argument("--nodes", help="inventory of the nodes, a table with ; between cells")
        if name == "inventory":
            s.add_argument("--facts", help="folder with the dsinfo.txt of the nodes")
            s.add_argument("--write", action="store_true", help="write the rows and statistics to OUT")
    s = sub.add_parser("lint")
    s.add_argument("path", nargs="?")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "lint":
        try:
            checked = [loader.load(a.path)] if a.path else [packs.STORE, packs.JOURNAL, packs.HOST]
        except loader.RuleError as e:
            print("\n".join(f"{x.level}: {x.where}: {x.text}" for x in e.problems))
            return CONFIG
        for pack in checked:
            print(pack.name, lint.summary(pack))
            for x in lint.check(pack):
                print(f"{x.level}: {x.where}: {x.text}")
        return OK
    from .functions import times
    from .functions.severity import allowed
    from .plans import cluster, pipelines
    from .sources.archive import ArchiveError, extract, find_root
    from .sources.files import ScanError

    spark = SparkSession.builder.appName("logfathom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        root = a.path
        if getattr(a, "extract_dir", None):
            extract(a.path, a.extract_dir, a.extract_mode)
            root = find_root(a.extract_dir) if a.command == "cluster" else a.extract_dir
        out = f"{a.out}-{tables.safe_tag(a.output_tag)}" if a.output_tag else a.out
        levels = [int(x) for x in a.level.split(",")] if "level" in a else []
        span = days = None
        if getattr(a, "time", None):
            at = times.plain_utc(a.time)
            if at is None:
                raise ValueError(f"no instant: {a.time}")
            span = (at - a.time_window * 60_000_000, at + a.time_window * 60_000_000)
        if a.command in ("incidents", "cluster") and a.date:
            days = (a.date, a.days)
        if a.command == "triage":
            named = tuple(allowed(levels))
            print(pipelines.triage(spark, root, out, (*named, "info") if len(named) == 4 else named, overwrite=a.overwrite, max_events=a.max_events, grouped=not a.no_cluster))
        elif a.command == "incidents":
            print(markdown.incidents_report(root, pipelines.store_incidents(spark, root, out, levels, span, days, a.overwrite).orderBy("source_relpath", "window").toLocalIterator()))
        elif a.command == "cluster":
            nodes = cluster.cluster_incidents(spark, root, out, levels, span, days, overwrite=a.overwrite)
            print("\n".join(tables.table_text([tuple(r) for r in nodes.orderBy("host").collect()], tuple(nodes.columns))))
        elif a.command == "scan":
            patterns = loader.load_patterns(a.patterns, packs.PATTERNS) if a.patterns else packs.PATTERNS
            print(markdown.pattern_report(pipelines.scan_report(spark, root, out, tuple(map(lint.java_pattern, patterns)), a.date, a.date_window_days, a.overwrite).collect()))
        elif a.command == "redact":
            print("\n".join(tables.table_text([tuple(r) for r in pipelines.redact_tree(spark, root, out, a.nodes, a.overwrite).orderBy("entity").collect()], ("class", "replacements"))))
        else:
            nodes = pipelines.node_inventory(spark, root, a.facts, out if a.write else None, a.overwrite)
            print("\n".join(tables.table_text([tuple(r) for r in nodes.collect()], tuple(nodes.columns))))
    except ArchiveError as e:
        print(e, file=sys.stderr)
        return EXTRACT
    except ScanError as e:
        print(e, file=sys.stderr)
        return SCAN
    except ValueError as e:
        print(e, file=sys.stderr)
        return CONFIG
    except KeyboardInterrupt:
        return INTERRUPTED
    return OK


if __name__ == "__main__":
    sys.exit(main())
