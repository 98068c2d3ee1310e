"""All queries of the engine and their SQL counterparts, by name."""

from __future__ import annotations

from glossa.plans.oracles import oracle_sql
from glossa.plans.queries import queries

__all__ = ["oracle_sql", "queries"]
