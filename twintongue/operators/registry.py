"""All registered queries of the engine."""

from __future__ import annotations

from . import changes, logic, relational, scalar
from .base import sql_query


def queries() -> dict:
    found = {k: sql_query(text) for k, text in relational.SAME.items()}
    found |= {k: sql_query(text) for k, (text, _) in relational.OWN.items()}
    found |= scalar.FUNCTIONS
    return found | {k: f for part in (logic.QUERIES, changes.QUERIES) for k, (f, _) in part.items()}


def oracle_sql() -> dict[str, str]:
    found = dict(relational.SAME) | {k: own or text for k, (text, own) in relational.OWN.items()} | scalar.SQL
    return found | {k: sql for part in (logic.QUERIES, changes.QUERIES) for k, (_, sql) in part.items() if sql}
