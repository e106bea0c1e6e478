"""Rules as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Signature:
    """Patterns that make a line an event of a type. ``captures`` are patterns whose first group gives a column."""

    id: str
    event_type: str
    severity: str
    patterns: tuple[str, ...]
    group: str = ""
    weight: float = 1.0
    ports: tuple[int, ...] = ()
    captures: tuple[tuple[str, str], ...] = ()
    manager_only: bool = False
    pre: int = 1
    post: int = 2
    also: str | None = None
    family: str | None = None


@dataclass(frozen=True)
class StormRule:
    event_type: str
    window_s: int
    count: int
    severity: str


@dataclass(frozen=True)
class Heuristic:
    """Fires where each of ``thresholds`` is met within ``window_s`` seconds."""

    id: str
    thresholds: tuple[tuple[str, int], ...]
    window_s: int
    weight: float
    severity: str = "high"
    supports: tuple[str, ...] = ()


@dataclass(frozen=True)
class Compound:
    """Fires where all, any and none of some types stand within ``window_s`` seconds."""

    id: str
    severity: str
    window_s: int
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    thresholds: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class RulePack:
    name: str
    signatures: tuple[Signature, ...]
    storms: tuple[StormRule, ...] = ()
    policies: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)
    keyspace_policies: tuple[tuple[str, tuple[float, float, float, float]], ...] = ()
    ratio_boost: tuple[float, float, float] = (3.0, 10.0, 50.0)
    heuristics: tuple[Heuristic, ...] = ()
    compounds: tuple[Compound, ...] = ()
    chatty: tuple[str, ...] = ()
