"""What is wrong with a rule pack."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from ..functions.severity import LABELS
from .model import RulePack

FAMILIES = ("storage_timing", "read_path", "apply_path", "client_network", "raft_election")


class Problem(NamedTuple):
    level: str  # error or warning
    where: str
    text: str


def java_pattern(pattern: str) -> str:
    """A pattern in the form that the engine's regular expressions take: named groups by number, literal braces escaped."""
    out = re.sub(r"\(\?P<\w+>", "(", pattern)
    return re.sub(r"(?<!\\)\{(?!\d+(?:,\d*)?\})([^{}]*)\}", r"\\{\1\\}", out)


def check(pack: RulePack) -> list[Problem]:
    """Errors and warnings: unique ids, severities, patterns, thresholds, references."""
    out: list[Problem] = []
    error = lambda where, text: out.append(Problem("error", where, text))
    for name, n in Counter(s.id for s in pack.signatures).items():
        if n > 1:
            error(name, "the id stands twice")
    for s in pack.signatures:
        if s.severity not in LABELS:
            error(s.id, f"unknown severity {s.severity}")
        if not s.patterns:
            error(s.id, "no patterns")
        if s.family and s.family not in FAMILIES:
            error(s.id, f"unknown family {s.family}")
        if not 0 <= s.weight <= 1:
            error(s.id, "the weight is not between 0 and 1")
        for p in (*s.patterns, *(c for _, c in s.captures), *([s.also] if s.also else [])):
            try:
                groups = re.compile(p).groups
            except re.error as e:
                error(s.id, f"bad pattern {p!r}: {e}")
                continue
            if p in dict(s.captures).values() and groups < 1:
                error(s.id, f"a capture without a group: {p!r}")
    types = {s.event_type for s in pack.signatures}
    for name, t in [*pack.policies.items(), *pack.keyspace_policies]:
        if len(t) != 4 or list(t) != sorted(t):
            error(name, "thresholds must be four and rise")
    for name in pack.policies:
        if name not in types:
            error(name, "a policy for an unknown type")
    if list(pack.ratio_boost) != sorted(pack.ratio_boost):
        error("ratio_boost", "must rise")
    for name, n in Counter(s.event_type for s in pack.storms).items():
        if n > 1:
            error(name, "two storm rules for one type")
    for s in pack.storms:
        if s.event_type not in types:
            error(s.event_type, "a storm of an unknown type")
        if s.window_s <= 0 or s.count <= 0:
            error(s.event_type, "window and count must be positive")
        if s.severity not in LABELS:
            error(s.event_type, f"unknown severity {s.severity}")
    used = set()
    for h in pack.heuristics:
        if not h.thresholds:
            error(h.id, "no thresholds")
        for k in [*(k for k, _ in h.thresholds), *h.supports]:
            used.add(k)
            if k not in types:
                error(h.id, f"unknown type {k}")
    for c in pack.compounds:
        for k in [*c.all_of, *c.any_of, *c.none_of, *(k for k, _ in c.thresholds)]:
            used.add(k)
            if k not in types:
                error(c.id, f"unknown type {k}")
    for k in pack.chatty:
        if k not in types:
            error(k, "a chatty type that is unknown")
    if pack.heuristics or pack.compounds:
        for k in sorted(types - used):
            out.append(Problem("warning", k, "no finding refers to this type"))
    return out


def summary(pack: RulePack) -> dict[str, int]:
    return {"signatures": len(pack.signatures), "patterns": sum(len(s.patterns) for s in pack.signatures), "types": len({s.event_type for s in pack.signatures}), "storms": len(pack.storms), "policies": len(pack.policies), "heuristics": len(pack.heuristics), "compounds": len(pack.compounds)}
