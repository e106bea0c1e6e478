"""Rule packs from YAML files of our own form."""

from __future__ import annotations

from pathlib import Path

from .lint import Problem, check
from .model import Compound, Heuristic, RulePack, Signature, StormRule

_PAIRS = ("thresholds",)


class RuleError(ValueError):
    """A pack that can't be used, with all that is wrong with it."""

    def __init__(self, problems: list[Problem]) -> None:
        self.problems = problems
        super().__init__("; ".join(f"{p.where}: {p.text}" for p in problems))


def _make(kind, row: dict):
    made = {k: tuple(v) if isinstance(v, list) else v for k, v in row.items()}
    for k in _PAIRS:
        if isinstance(made.get(k), dict):
            made[k] = tuple(made[k].items())
    if isinstance(made.get("captures"), dict):
        made["captures"] = tuple(made["captures"].items())
    try:
        return kind(**made)
    except TypeError as e:
        raise RuleError([Problem("error", str(row.get("id", row)), str(e))]) from e


def from_dict(data: dict, name: str = "pack") -> RulePack:
    """A pack from plain lists and dicts: signatures, storms, policies, heuristics, compounds, chatty."""
    if not isinstance(data, dict) or "signatures" not in data:
        raise RuleError([Problem("error", name, "no signatures")])
    pack = RulePack(
        data.get("name", name),
        tuple(_make(Signature, s) for s in data["signatures"]),
        tuple(_make(StormRule, s) for s in data.get("storms", ())),
        {k: tuple(map(float, v)) for k, v in data.get("policies", {}).items()},
        tuple((k, tuple(map(float, v))) for k, v in data.get("keyspace_policies", {}).items()),
        tuple(map(float, data.get("ratio_boost", (3, 10, 50)))),
        tuple(_make(Heuristic, h) for h in data.get("heuristics", ())),
        tuple(_make(Compound, c) for c in data.get("compounds", ())),
        tuple(data.get("chatty", ())),
    )
    errors = [p for p in check(pack) if p.level == "error"]
    if errors:
        raise RuleError(errors)
    return pack


def load(path: str) -> RulePack:
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("reading rule files needs PyYAML") from e
    return from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")), Path(path).stem)


def load_patterns(path: str, fallback: tuple[str, ...]) -> tuple[str, ...]:
    """One pattern a line, without blank lines and comments; the fallback if there is none. A folder means its ``patterns.txt``."""
    p = Path(path)
    p = p / "patterns.txt" if p.is_dir() else p
    if not p.exists():
        return fallback
    lines = [x.strip() for x in p.read_text(encoding="utf-8").splitlines()]
    return tuple(x for x in lines if x and not x.startswith("#")) or fallback
