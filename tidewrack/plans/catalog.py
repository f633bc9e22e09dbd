"""All queries of the engine by name, and the SQL that each must agree with."""

from __future__ import annotations

from . import changes, curation, release, stages

_PARTS = (changes, curation, release, stages)


def queries() -> dict:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.ORACLES.items()}
