"""All queries outside the llm subpackage, with the SQL that gives the same rows."""

from __future__ import annotations

from . import p_core, reference

QUERIES = {**p_core.QUERIES, **reference.QUERIES}
SQL = {**p_core.SQL, **reference.SQL}
flagship = reference.flagship
