"""Ordered severities as ranks and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the least to the most severe.
LABELS = ("info", "low", "medium", "high", "critical")


def rank(label: Column) -> Column:
    """0 (info) to 4 (critical); an unknown or null label counts as info."""
    low = F.lower(F.trim(label))
    out = F.lit(0)
    for k, name in enumerate(LABELS):
        out = F.when(low == name, k).otherwise(out)
    return out


def label(of: Column) -> Column:
    """The label of a rank; ranks outside clamp to the ends."""
    return F.element_at(F.array(*map(F.lit, LABELS)), F.greatest(F.lit(0), F.least(F.lit(len(LABELS) - 1), of)).cast("int") + 1)


def allowed(levels: list[int]) -> list[str]:
    """The labels of levels 1 (critical) to 4 (low), as on the command line."""
    wrong = [n for n in levels if not 1 <= n <= 4]
    if wrong:
        raise ValueError(f"levels are 1 to 4, not {wrong}")
    return [LABELS[5 - n] for n in sorted(set(levels))]
