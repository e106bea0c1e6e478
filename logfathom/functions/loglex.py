"""Masks, slots and fields of single log lines, and what a header of slots says."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple

#: Level words, the letters of glog headers and the severities of syslog (RFC 5424).
LEVELS = {
    "trace": "debug", "debug": "debug", "dbg": "debug", "info": "info", "information": "info", "notice": "info", "warn": "warning", "warning": "warning",
    "err": "error", "error": "error", "crit": "critical", "critical": "critical", "fatal": "critical", "alert": "critical", "emerg": "critical", "emergency": "critical", "panic": "critical",
}
LETTERS = {"D": "debug", "I": "info", "N": "info", "W": "warning", "E": "error", "F": "critical", "C": "critical"}
SEVERITIES = ("critical", "critical", "critical", "error", "warning", "info", "info", "debug")
#: Names of the fields of structured lines; components from the least to the most specific.
TIME_KEYS = ("ts", "time", "timestamp", "@timestamp", "t")
LEVEL_KEYS = ("level", "lvl", "severity", "loglevel", "log.level")
MESSAGE_KEYS = ("msg", "message", "log")
COMPONENT_KEYS = ("program", "service", "app", "component", "module", "subsystem", "name", "logger", "caller", "source", "file")


_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_CLOCK = r"\d\d:\d\d:\d\d(?:[.,]\d+)?"
#: How programs write a date with a time.
_TIME = (
    rf"(?:\d{{4}}[-/]\d\d[-/]\d\d[Tt ]{_CLOCK}(?:\s?(?:Z|z|[+-]\d\d:?\d\d|UTC))?|(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? )?{_MONTH} [ \d]\d {_CLOCK}(?: [A-Z]{{3,4}} \d{{4}}| \d{{4}})?"
    rf"|\d{{1,2}}/{_MONTH}/\d{{4}}:{_CLOCK}(?: [+-]\d{{4}})?|\d{{1,2}}[ -]{_MONTH}[ -]\d{{4}} {_CLOCK}|\d\d[./]\d\d[./]\d{{4}} {_CLOCK}|\d{{8}}[Tt ]\d{{6}}Z?)"
)
_GLOG = rf"[A-Z]\d{{4}} {_CLOCK}"
_DATED = re.compile(rf"(?:(?<!\S)|(?<=>))(?:(?P<glog>{_GLOG})(?=\s)|(?P<b>\[?){_TIME}\]?(?=[\s\[|]|$))")
_KEYED = re.compile(r"[A-Za-z_@][\w.@/-]*=\S").match
_KEY = re.compile(r"[A-Za-z_@][\w.@/-]*").fullmatch
_MEMBER = re.compile(r'[{,]\s*("[\w.@/ -]+"\s*:)').findall
_PAIR = re.compile(r'([A-Za-z_@][\w.@/-]*)=(?:"((?:[^"\\]|\\.)*)"|(\S*))(?:\s+|$)')
_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_NUMBERS = re.compile(r"\d[0-9a-f]*").sub
_DIGIT = re.compile(r"\d").search
#: Marks of the time in a mask, and of a mask of keys.
TIME, JSON, PAIRS = "\x01", "\x02", "\x03"


def level_of(text: str | None) -> str | None:
    """The level that a word, letter or number stands for."""
    if text is None:
        return None
    plain = _ANSI.sub("", text).strip().strip("[]:").strip().lower()
    if plain in LEVELS:
        return LEVELS[plain]
    if len(plain) == 1 and plain.upper() in LETTERS:
        return LETTERS[plain.upper()]
    if plain.isascii() and plain.isdigit():
        n = int(plain) if len(plain) < 4 else 99
        return SEVERITIES[n] if n < 8 else "debug" if n < 30 else "info" if n < 40 else "warning" if n < 50 else "error" if n < 60 else "critical"
    return None


def _word(word: str) -> str:
    """A word that is not all letters: numbers masked, other words with digits left as a shape only where it may tell a kind."""
    if not _DIGIT(word):
        return word
    if word.isdigit():
        return "0"
    return _NUMBERS("0", word) if word[-1] in "]s" or word[0] in "<*" or ":" in word or "[" in word else "*"


def mask(line: str) -> str | None:
    """The words of a line with its first time marked and its numbers masked, or the keys of a structured line.

    Null if there is neither: such a line can't begin an entry.
    """
    line = line.rstrip("\r\n")
    if line[:1] == "{" and line[-1] == "}":
        return JSON + "\n".join(_MEMBER(line))
    if _KEYED(line):
        return PAIRS + "\n".join([k for w in line.split() if "=" in w and _KEY(k := w[: w.index("=")])])
    m = _DATED.match(line) or (_DATED.search(line, 1) if ":" in line or "T" in line else None)
    if m is None:
        return None
    a, z = m.span()
    if m["glog"]:
        mark = line[a] + TIME
    else:
        mark = f"[{TIME}]" if m["b"] and line[z - 1] == "]" else TIME
    line = f"{line[:a]}{mark}{line[z:]}"
    if "\t" in line:
        return _NUMBERS("0", line)
    return " ".join([w if w.isalpha() else _word(w) for w in line.split()])


def pairs(text: str) -> dict[str, str] | None:
    """The pairs of a logfmt line, quoted values decoded; null unless the whole line is pairs."""
    out: dict[str, str] = {}
    at = 0
    while at < len(text):
        m = _PAIR.match(text, at)
        if m is None or m.end() == at:
            return None
        quoted = m[2]
        if quoted is None:
            out.setdefault(m[1], m[3])
        else:
            if "\\" in quoted:
                try:
                    quoted = json.loads(f'"{quoted}"')
                except ValueError:
                    quoted = re.sub(r"\\(.)", r"\1", quoted)
            out.setdefault(m[1], quoted)
        at = m.end()
    return out or None


def members(text: str) -> dict | None:
    if not (text.startswith("{") and text.rstrip().endswith("}")):
        return None
    try:
        got = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


# Kinds of slots: T time, T] in brackets, GT of glog with its letter; PRI and PRIV (with a version); L level word, L] in
# brackets, L: with a colon; N number, S seconds, P: process, C connection, R] and R source file with line, G group in
# brackets, D dash or bar, A: program with colon, M word with digits or dots, W other word. A tab after a slot is part of its kind.
_SLOT = re.compile(r"(?P<pri><0>)(?:0(?=\s))?|(?P<time>\[\x01\]|[A-Z]?\x01)|(?P<group>\[[^\]\n]*\])|(?P<word>[^\s\[]+(?:\[[^\]\s]*\]?[^\s\[]*)*)|(?P<other>\S)")
_FORMS = [(kind, re.compile(p).fullmatch) for kind, p in (("P:", r"0#0:"), ("C", r"\*0"), ("N", r"0"), ("S", r"0(?:\.0)?s"), ("D", r"[-–—|:]+"), ("R]", r"[\w.-]+:0\]"), ("R", r"[\w./-]+\.\w+:0"), ("A:", r"[^\s:\[\]]+(?:\[0\])?:"), ("M", r"\S*[0-9*._/-]\S*"))]


def kind_of(token: str) -> str:
    plain = _ANSI.sub("", token.replace("\x1b[0m", "")) if "\x1b" in token else token
    word = plain.lower()
    if word in LEVELS:
        return "L"
    if word[-1:] == ":" and word[:-1] in LEVELS:
        return "L:"
    if word[:1] == "[" and word[-1:] == "]":
        return "L]" if word[1:-1].strip() in LEVELS else "G"
    return next((kind for kind, match in _FORMS if match(plain)), "W")


class Slots(NamedTuple):
    """The tokens of a mask with their kinds."""

    tokens: list[str]
    kinds: list[str]


def slots(text: str) -> Slots:
    """The slots of a mask; those of a structured line are its keys."""
    if text[0] in (JSON, PAIRS):
        keys = [k for k in text[1:].split("\n") if k]
        return Slots([text[0], *keys], ["json" if text[0] == JSON else "pairs", *["K"] * len(keys)])
    tokens, kinds = [], []
    for m in _SLOT.finditer(text):
        token = m[0]
        if m.lastgroup == "time":
            kind = {"[": "T]", TIME: "T"}.get(token[0], "GT")
        elif m.lastgroup == "pri":
            kind = "PRIV" if token[-1] == "0" else "PRI"
        else:
            kind = kind_of(token)
        tokens.append(token)
        kinds.append(kind + "\t" if text[m.end() : m.end() + 1] == "\t" else kind)
    return Slots(tokens, kinds)


#: What may stand before the time of a header, beside a level.
_BEFORE = {"PRI", "PRIV", "N", "D", "G", "A:", "M"}


def roles(kinds: list[str], is_level: Callable[[int], bool]) -> list[str] | None:
    """The role of each slot of the header that a line of these slots begins with; null if it begins with none.

    Roles are time, level, component, group, host, skip, stop (a separator) and pri. ``is_level`` tells whether a bare
    word is a level. The header ends with what closes it (a program with colon, a level with colon, a process, a source
    file, a separator that nothing of a header follows), else with the last level or group.
    """
    bare = [k.rstrip("\t") for k in kinds]
    tab = [k.endswith("\t") for k in kinds]
    n = len(kinds)
    at = next((i for i, k in enumerate(bare) if k in ("T", "T]", "GT")), None)
    if at is None:
        return None
    out: list[str] = []
    have: set[str] = set()

    def level(i: int) -> bool:
        return bare[i] in ("L]", "L:") or bare[i] in ("L", "W") and is_level(i)

    def take(role: str) -> None:
        out.append(role)
        have.add(role)

    for i in range(at):
        if level(i) and "level" not in have:
            take("level")
        elif bare[i] == "A:":
            take("component")
        elif bare[i] in _BEFORE:
            take("pri" if bare[i] in ("PRI", "PRIV") else "skip")
        else:
            return None
    take("time")
    i = at + 1
    if at and bare[at - 1] == "PRIV":  # the standard's five fields
        if n < i + 5 or bare[i + 4] not in ("G", "D"):
            return None
        out += ["host", "component", "skip", "skip", "skip"]
        i += 5
        while i < n and bare[i] == "G" and bare[i - 1] == "G":
            out.append("skip")
            i += 1
        return out
    if tab[at]:
        while i < n - 1 and tab[i]:
            if level(i) and "level" not in have:
                take("level")
            elif bare[i] == "R":
                take("source")
            elif "component" not in have and not have & {"source"} and bare[i] in ("W", "M", "L"):
                take("component")
            else:
                break
            i += 1
        return out
    done = len(out)  # roles up to here are certain

    def separated(i: int, word: bool) -> bool:
        """Whether, from slot i, only slots of a header come before a separator, with one bare word at most."""
        seen = False
        while i < n:
            if bare[i] == "D":
                return seen
            if level(i) or bare[i] in ("N", "G"):
                seen = seen or bare[i] not in ("N",)
            elif word and bare[i] in ("W", "M", "L", "R"):
                word, seen = False, True
            else:
                return False
            i += 1
        return False

    while i < n:
        k = bare[i]
        if level(i) and "level" not in have:
            take("level")
            done = len(out)
            if k == "L:":
                return out
        elif k == "P:":
            take("skip")
            return out + ["skip"] if i + 1 < n and bare[i + 1] == "C" else out
        elif k == "R]":
            take("component")
            return out
        elif k == "A:":
            if have & {"component", "group"}:
                break
            take("component")
            return out
        elif k == "G":
            take("group" if "level" in have else "skip")
            if "level" in have:
                done = len(out)
        elif k in ("N", "S"):
            take("skip")
        elif k == "D":
            take("stop")
            done = len(out)
            if not (separated(i + 1, "component" not in have) and ("component" not in have or "level" not in have)):
                return out
        elif k in ("W", "M", "L", "R") and i == at + 1 and i + 1 < n and bare[i + 1] == "A:":
            take("host")
        elif k in ("W", "M", "L", "R") and "component" not in have and separated(i, True):
            take("component")
        else:
            break
        i += 1
    return out[:done]


def shape(kinds: list[str]) -> str:
    """The kinds of the slots that may be a header, words that may be levels or not as words; empty without a header.

    The slot after the time is kept in any case, as it may be a level; a full stop says that more slots follow.
    """
    got = roles(kinds, lambda i: kinds[i].rstrip("\t") == "L")
    if got is None:
        return ""
    at = max(k for k, r in enumerate(got) if r == "time")
    zone = kinds[: max(len(got), at + 2 if not kinds[at].endswith("\t") else 0)]
    return " ".join(["W" + k[1:] if k.rstrip("\t") == "L" else k for k in zone] + ["."] * (len(zone) < len(kinds)))


#: How a slot is read, by its kind and role.
_ESC = r"(?:\x1b\[[0-9;]*m)*"
_READ = {
    "T": rf"(?P<time>{_TIME})", "T]": rf"\[(?P<time>{_TIME})\]", "GT": rf"(?P<time>(?P<letter>[A-Z])\d{{4}} {_CLOCK})", "PRI": r"<(?P<pri>\d{1,3})>", "PRIV": r"<(?P<pri>\d{1,3})>\d+",
    "L] level": r"\[\s*(?P<level>\w+)\s*\]", "L: level": r"(?P<level>\w+):", "level": rf"{_ESC}(?P<bare>\w+){_ESC}",
    "A: component": r"(?P<component>[^\s:\[]+)(?:\[\d+\])?:", "R] component": r"(?P<component>[^\s:]+):\d+\]", "component": r"(?P<component>\S+)", "source": r"(?P<source>\S+):\d+",
    "group": r"\[(?P<group>[^\]]*?)\s*\]", "G": r"\[[^\]]*\]", "N": r"\d+", "other": r"\S+",
}


def reader(kinds: list[str], names: list[str]) -> str:
    """The pattern that reads a header of these slots in these roles, with the message after it."""
    out, grouped = "", False
    standard = "PRIV" in [k.rstrip("\t") for k in kinds]
    for i, (kind, role) in enumerate(zip(kinds, names)):
        k = kind.rstrip("\t")
        part = _READ.get(f"{k} {role}") or _READ.get(role if role != "skip" else k) or _READ.get(k) or _READ["other"]
        if k in ("T", "T]", "GT", "PRI", "PRIV"):
            part = _READ[k]
        if role == "group" and grouped:
            part = _READ["G"]
        grouped = grouped or role == "group"
        if standard and k == "G":  # a quoted bracket does not end a standard's group
            part = r"\[(?:[^\]\\]|\\.)*\]"
        out += part
        if i + 1 < len(names):
            loose = k in ("PRI", "G", "T]", "L]") or kinds[i + 1][0] in "G[" or kinds[i + 1].rstrip("\t") in ("T]", "L]")
            out += r"\t" if kind.endswith("\t") else r"\s*" if loose else r"\s+"
    return out + r"(?:\s(?P<message>.*))?"


class Header(NamedTuple):
    time: str
    level: str | None
    component: str | None
    message: str


def plan(kinds: list[str], level_share: list[float], keys: list[list[str]]) -> str | None:
    """What the slots of a leaf's header say, as a JSON object; null if they begin no entry.

    ``level_share`` has, for each slot, the share of templates with this shape in which it holds level words only; a
    bare word is a level from one half on. ``keys`` has the known names among the keys that a structured leaf has in
    each slot.
    """
    form = kinds[0]
    if form in ("json", "pairs"):
        held = {re.sub(r'^"|"\s*:$', "", k) for slot in keys for k in slot}
        parts = {role: [k for k in names if k in held] for role, names in (("time", TIME_KEYS), ("level", LEVEL_KEYS), ("message", MESSAGE_KEYS), ("component", COMPONENT_KEYS[::-1]))}
        return json.dumps({"form": form, **parts}) if parts["time"] and parts["message"] else None
    names = roles(kinds, lambda i: kinds[i].rstrip("\t") in ("W", "L") and level_share[i] >= 0.5)
    if names is None:
        return None
    return json.dumps({"form": "text", "read": reader(kinds[: len(names)], names), "wraps": "host" in names or "pri" in names})


class Plan:
    """A plan ready to read lines."""

    def __init__(self, text: str) -> None:
        p = json.loads(text)
        self.form = p["form"]
        self.parts = p
        if self.form == "text":
            self.match = re.compile(p["read"], re.S).fullmatch
            self.wraps = p["wraps"]

    def header(self, line: str) -> Header | None:
        """The fields of a line, null if it has none of the kind.

        A message that is a structured line of its own wraps another program's header, whose fields come first.
        """
        line = line.rstrip("\r\n")
        if self.form != "text":
            got = members(line) if self.form == "json" else pairs(line)
            return _fields(got, self.parts) if got else None
        m = self.match(line)
        if m is None:
            return None
        g = m.groupdict()
        message = g["message"] or ""
        if "bare" in g:
            level = level_of(g["bare"])
            if level is None:  # the word begins the message
                message = line[m.start("bare") :]
                return Header(g["time"], level_of(g.get("letter")), None, message)
        elif "level" in g:
            level = level_of(g["level"])
        elif "pri" in g:
            level = SEVERITIES[int(g["pri"]) % 8]
        else:
            level = level_of(g.get("letter"))
        component = g.get("source") or g.get("component") or g.get("group")
        outer = Header(g["time"], level, None if component in (None, "", "-") else component, message)
        if self.wraps and message and (message[0] == "{" or _KEYED(message)):
            got = members(message) if message[0] == "{" else pairs(message)
            inner = _fields(got, _ALL) if got else None
            if inner:
                return Header(inner.time or outer.time, inner.level or outer.level, inner.component or outer.component, inner.message)
        return outer


_ALL = {"time": list(TIME_KEYS), "level": list(LEVEL_KEYS), "message": list(MESSAGE_KEYS), "component": list(COMPONENT_KEYS[::-1])}


def _fields(got: dict, parts: dict[str, list[str]]) -> Header | None:
    """The fields of a structured line; null unless it has a time and a message."""

    def first(role: str) -> str | None:
        for k in parts[role]:
            v = got.get(k)
            if v is not None:
                return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return None

    if not (any(k in got for k in parts["time"]) and any(k in got for k in parts["message"])):
        return None
    component = first("component")
    return Header(first("time") or "", level_of(first("level")), re.sub(r":\d+$", "", component) if component else None, first("message") or "")
