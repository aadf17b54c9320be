"""The subpackage's queries and SQL, as the entry point adds them."""

from __future__ import annotations

from terrasieve.llm import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.ORACLES)
