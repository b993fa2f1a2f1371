"""The registered queries and their SQL, filled by the modules of this folder."""

from __future__ import annotations

from fieldspark.sources import views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _bag(sql: str) -> str:
    return f"WITH {views.BAG_SQL}, {sql.strip()}"


def _r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0e0"
