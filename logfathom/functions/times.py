"""Reading times in the ways programs write them, and zone rules, on plain integers."""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Iterator
from datetime import date, datetime, timezone
from typing import NamedTuple
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

SECOND, DAY = 1_000_000, 86_400_000_000
EPOCH = date(1970, 1, 1).toordinal()
#: English names as programs write them.
MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_DOW = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)"
_MON = rf"(?P<mo>{'|'.join(MONTHS)})[a-z]*\.?"
_HMS = r"(?P<h>\d{1,2}):(?P<mi>\d{2}):(?P<s>\d{2})(?:[.,](?P<f>\d+))?"
_ZONE = r"(?P<z>z|[+-]\d{2}(?::?\d{2})?|[a-z]{2,5})"
_HALF = r"(?P<half>[ap])\.?m\.?"
#: One text may fit several of these; what its source writes elsewhere decides.
FORMATS = [
    (name, re.compile(pattern, re.I | re.A))
    for name, pattern in (
        ("iso", rf"{_DOW}?(?P<y>\d{{4}})(?P<sep>[-/])(?P<mo>\d{{2}})(?P=sep)(?P<d>\d{{2}})(?:t|\s+){_HMS}\s*{_ZONE}?(?:\s+(?:[a-z]{{2,5}}|[+-]\d{{2,4}}))?(?:\s+m=[+-]\d+(?:\.\d+)?)?"),
        ("compact", rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})(?:t|\s)?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?\s*{_ZONE}?"),
        ("clf", rf"(?P<d>\d{{1,2}})/{_MON}/(?P<y>\d{{4}}):{_HMS}\s*{_ZONE}?"),
        ("syslog", rf"{_MON}\s+(?P<d>\d{{1,2}})\s+{_HMS}(?:\s+{_ZONE})?"),
        ("glog", r"[a-z](?P<mo>\d{2})(?P<d>\d{2})\s+(?P<h>\d{2}):(?P<mi>\d{2}):(?P<s>\d{2})(?:\.(?P<f>\d+))?"),
        ("ctime", rf"{_DOW}{_MON}\s+(?P<d>\d{{1,2}})\s+{_HMS}(?:\s+{_ZONE})?\s+(?P<y>\d{{4}})"),
        ("mail", rf"{_DOW}?(?P<d>\d{{1,2}})[\s-]{_MON}[\s-](?P<y>\d{{4}}),?\s+{_HMS}(?:\s*(?!{_HALF}$){_ZONE})?"),
        ("clock12", rf"{_DOW}?(?P<d>\d{{1,2}})\s{_MON}\s(?P<y>\d{{4}}),?\s+{_HMS}\s*{_HALF}"),
        ("dmy", rf"(?P<d>\d{{1,2}})(?P<sep>[/.])(?P<mo>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}),?\s+{_HMS}\s*(?:{_HALF})?"),
        ("mdy", rf"(?P<mo>\d{{1,2}})(?P<sep>[/.])(?P<d>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}),?\s+{_HMS}\s*(?:{_HALF})?"),
        ("dmy2", rf"(?P<d>\d{{2}})(?P<sep>[/.-])(?P<mo>\d{{2}})(?P=sep)(?P<yy>\d{{2}})\s+{_HMS}"),
        ("mdy2", rf"(?P<mo>\d{{2}})(?P<sep>[/.-])(?P<d>\d{{2}})(?P=sep)(?P<yy>\d{{2}})\s+{_HMS}"),
        ("ymd2", rf"(?P<yy>\d{{2}})(?P<sep>[/.-])(?P<mo>\d{{2}})(?P=sep)(?P<d>\d{{2}})\s+{_HMS}"),
        ("s", r"(?P<epoch>\d{9,10})(?:\.(?P<f>\d+))?"),
        ("ms", r"(?P<epoch>\d{9,10})(?P<f>\d{3})"),
        ("us", r"(?P<epoch>\d{9,10})(?P<f>\d{6})"),
        ("ns", r"(?P<epoch>\d{9,10})(?P<f>\d{9})"),
    )
]
_WRAPPED = re.compile(r'(?:\w+=)?(?:"([^"]*)"|\[([^\]\[]*)\]|(.*))', re.S)
_BLANKS = re.compile(r"\s{100,}")


class Reading(NamedTuple):
    """Parts of a written time; year None if it has none; ``instant`` set instead if it counts from the epoch."""

    form: str
    year: int | None
    month: int
    day: int
    day_us: int
    zone: str
    instant: int | None


class Times(NamedTuple):
    status: str
    us: int | None


def readings(text: str) -> Iterator[Reading]:
    """Every reading that the form of the text and the calendar allow, in the order of ``FORMATS``."""
    if len(text) > 100:  # long runs of blanks would be tried in many ways
        text = _BLANKS.sub(" " * 100, text)
    wrapped = _WRAPPED.fullmatch(text.strip())
    inner = wrapped and next(g for g in wrapped.groups() if g is not None).strip()
    if not inner:
        return
    for form, pattern in FORMATS:
        m = pattern.fullmatch(inner)
        if m is None:
            continue
        g = m.groupdict()
        micro = int((g.get("f") or "0")[:6].ljust(6, "0"))
        if "epoch" in g:
            yield Reading(form, None, 0, 0, 0, "", int(g["epoch"]) * SECOND + micro)
            continue
        h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"])
        if g.get("half"):
            if not 1 <= h <= 12:
                continue
            h = h % 12 + 12 * (g["half"].lower() == "p")
        year = int(g["y"]) if g.get("y") else 2000 + int(g["yy"]) if g.get("yy") else None
        month = MONTHS.get(g["mo"].lower()) or int(g["mo"])
        day = int(g["d"])
        if h > 23 or mi > 59 or s > 59 or not 1 <= month <= 12 or year == 0 or not 1 <= day <= monthrange(year or 2000, month)[1]:
            continue
        yield Reading(form, year, month, day, ((h * 60 + mi) * 60 + s) * SECOND + micro, (g.get("z") or "").upper(), None)


_PLAIN = re.compile(r"(\d{4})([-/])(\d\d)\2(\d\d)[T ](\d\d):([0-5]\d):([0-5]\d)(?:[.,](\d+))?Z?", re.A).fullmatch
_days: dict[tuple[str, str, str], int | None] = {}


def plain_utc(text: str) -> int | None:
    """The instant of the most frequent form, ``2024-03-05T09:59:59.5Z`` or the like, read as UTC; null for any other.

    It is what ``readings`` and ``resolve`` give, at a fraction of the cost.
    """
    m = _PLAIN(text)
    if m is None:
        return None
    y, _, mo, d, h, mi, s, f = m.groups()
    key = (y, mo, d)
    if key not in _days:
        if len(_days) > 100_000:
            _days.clear()
        try:
            _days[key] = (date(int(y), int(mo), int(d)).toordinal() - EPOCH) * DAY
        except ValueError:
            _days[key] = None
    day = _days[key]
    if day is None or h > "23":
        return None
    return day + ((int(h) * 60 + int(mi)) * 60 + int(s)) * SECOND + (int(f.ljust(6, "0")[:6]) if f else 0)


class Zone:
    """Offsets of one zone in microseconds, remembered by quarter hour: no zone changes within one."""

    def __init__(self, name: str) -> None:
        self.zone = ZoneInfo(name)
        self.at: dict[int, int] = {}
        seen: dict[str, set[int]] = {}
        for year in range(1990, 2038):
            for month in range(1, 13):
                t = datetime(year, month, 15, tzinfo=timezone.utc).astimezone(self.zone)
                seen.setdefault(t.tzname(), set()).add(int(t.utcoffset().total_seconds()) * SECOND)
        #: An abbreviation with two offsets in one zone settles nothing and is left out.
        self.names = {a: next(iter(o)) for a, o in seen.items() if len(o) == 1}

    def offset(self, us: int) -> int:
        quarter = us // (900 * SECOND)
        o = self.at.get(quarter)
        if o is None:
            o = self.at[quarter] = int(datetime.fromtimestamp(quarter * 900, self.zone).utcoffset().total_seconds()) * SECOND
        return o

    def instants(self, wall: int) -> tuple[list[int], int]:
        """The instants at which the zone's clock shows ``wall``: none if it skips it, two if it passes it twice.

        The offsets a day before and a day after are the only ones that can hold. The second value is the instant by
        the earlier offset.
        """
        early, late = wall - self.offset(wall - DAY), wall - self.offset(wall + DAY)
        return sorted({u for u in (early, late) if u + self.offset(u) == wall}), early


_zones: dict[str, Zone | None] = {}


def zone(name: str | None) -> Zone | None:
    if name is None:
        return None
    if name not in _zones:
        try:
            _zones[name] = Zone(name)
        except (ZoneInfoNotFoundError, ValueError, OSError):
            _zones[name] = None
    return _zones[name]


def written_offset(text: str, own: Zone | None) -> int | None:
    """The offset of ``+05:30``, ``Z``, ``UTC`` or an abbreviation as the own zone uses it."""
    if text[0] in "+-":
        digits = text[1:].replace(":", "").ljust(4, "0")
        h, m = int(digits[:2]), int(digits[2:])
        return (h * 60 + m) * 60 * SECOND * (-1 if text[0] == "-" else 1) if h <= 18 and m < 60 else None
    if text in ("Z", "UTC", "UT"):
        return 0
    if own is not None and text in own.names:
        return own.names[text]
    return 0 if text == "GMT" else None


def resolve(r: Reading, own: Zone | None, latest: int | None) -> Times:
    """The instant of a reading, with wall times in the zone ``own``; without a year, not after ``latest``."""
    if r.instant is not None:
        return Times("ok", r.instant)
    offset = None
    if r.zone:
        offset = written_offset(r.zone, own)
    if offset is None and (r.zone or own is None):
        return Times("no_zone", None)
    if r.year is not None:
        years = [r.year]
    elif latest is None:
        return Times("no_year", None)
    else:
        top = date.fromordinal(EPOCH + latest // DAY).year + 1
        years = [y for y in range(top, top - 13, -1) if r.day <= monthrange(y, r.month)[1]] if r.month == 2 and r.day == 29 else [top, top - 1, top - 2]
    for year in years:
        wall = (date(year, r.month, r.day).toordinal() - EPOCH) * DAY + r.day_us
        found, about = ([wall - offset], wall - offset) if offset is not None else own.instants(wall)
        if r.year is None and about > latest:
            continue
        if len(found) == 1:
            return Times("ok", found[0])
        return Times("repeated" if found else "skipped", None)
    return Times("no_year", None)
