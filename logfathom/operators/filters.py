"""Filters by time, day, level and path."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity
from ..session import small

DAY_US = 86_400_000_000


def days_around(center: str, days: int) -> list[str]:
    """The dates from ``days`` before to ``days`` after, as ``YYYY-MM-DD``."""
    if days < 0:
        raise ValueError("days must not be negative")
    middle = date.fromisoformat(center)
    return [str(middle + timedelta(k)) for k in range(-days, days + 1)]


def day_key(line: Column, center: str, days: int) -> Column:
    """The first of the dates around ``center`` that stands in a line, else null."""
    return F.nullif(F.regexp_extract(line, f"({'|'.join(days_around(center, days))})", 1), F.lit(""))


def time_range(events: DataFrame, us: str, start_us: int, end_us: int) -> DataFrame:
    """Events from the start up to, not including, the end."""
    return events.where((F.col(us) >= start_us) & (F.col(us) < end_us))


def date_window(events: DataFrame, us: str, center: str, days: int) -> DataFrame:
    """Events of the calendar days around a date, both ends inclusive."""
    start = (date.fromisoformat(center) - timedelta(days) - date(1970, 1, 1)).days * DAY_US
    return time_range(events, us, start, start + (2 * days + 1) * DAY_US)


def last_days(events: DataFrame, us: str, days: int) -> DataFrame:
    """Events of the last ``days`` days before the newest event, which is looked up first; without a time there is none."""
    newest = events.agg(F.max(us)).first()[0]
    return events.where(F.lit(False)) if newest is None else events.where(F.col(us).between(newest - days * DAY_US, newest))


def by_level(events: DataFrame, level: str, levels: list[int]) -> DataFrame:
    """Events of the levels 1 (critical) to 4 (low); info is never among them."""
    return events.where(F.col(level).isin(*severity.allowed(levels)))


def relevel(windows: DataFrame, keys: list[str], level: str, levels: list[int]) -> DataFrame:
    """Members of windows filtered by level; windows without a member vanish, and none is cut anew."""
    return by_level(windows, level, levels)


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over a whole path; ``*`` also crosses ``/``."""
    out, k = "", 0
    glob = glob[3:] if glob.startswith("**/") else glob
    while k < len(glob):
        c = glob[k]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            body = glob[k + 1 : end]
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            k = end
        else:
            out += c if c.isalnum() or c in "/_" else "\\" + c
        k += 1
    return f"^{'(?:.*/)?' if len(out) and glob != out else ''}{out}$"


def discover(paths: DataFrame, rel: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> DataFrame:
    """The paths that an include glob claims and no exclude glob removes, with the place of the first that does."""
    plain = [("^" + glob_regex(g).removeprefix("^").removeprefix("(?:.*/)?"), k) for k, g in enumerate(include)]
    claim = None
    for pattern, k in plain:
        claim = F.when(rel.rlike(pattern), k) if claim is None else claim.when(rel.rlike(pattern), k)
    out = F.lit(False)
    for g in exclude:
        anywhere = "^(?:.*/)?" if g.startswith("**/") else "^"
        out |= rel.rlike(anywhere + glob_regex(g).removeprefix("^").removeprefix("(?:.*/)?"))
    return paths.withColumn("glob", claim).where(F.col("glob").isNotNull() & ~out)


def discovery_statistics(files: DataFrame, rel: Column, size: str, include: tuple[str, ...], exclude: tuple[str, ...], most_bytes: int) -> DataFrame:
    """(outcome, n, bytes): how many files are taken, excluded, unmatched or too large."""
    matched = F.lit(False)
    for g in include:
        matched |= rel.rlike("^" + glob_regex(g).removeprefix("^").removeprefix("(?:.*/)?"))
    excluded = F.lit(False)
    for g in exclude:
        excluded |= rel.rlike(("^(?:.*/)?" if g.startswith("**/") else "^") + glob_regex(g).removeprefix("^").removeprefix("(?:.*/)?"))
    outcome = F.when(excluded, "excluded").when(~matched, "unmatched").when(F.col(size) > most_bytes, "too_large").otherwise("taken")
    return files.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def expired_certificates(lines: DataFrame, line: str) -> DataFrame:
    """Lines of a certificate dump that end in ``(EXPIRED)``."""
    return lines.where(F.rtrim(line).endswith("(EXPIRED)"))


def rewrite_components(paths: DataFrame, path: str, hosts: DataFrame) -> DataFrame:
    """(path, target): the host directory, second of the path, replaced by its pseudonym where it is known."""
    parts = F.split(path, "/")
    known = small(hosts.select(F.col("original").alias("__host"), "replacement"))
    joined = paths.withColumn("__host", F.lower(F.get(parts, F.lit(1)))).join(known, "__host", "left")
    return joined.select(path, F.concat_ws("/", F.get(parts, F.lit(0)), F.coalesce("replacement", F.get(parts, F.lit(1))), F.array_join(F.slice(parts, 3, 10_000), "/")).alias("target"))
