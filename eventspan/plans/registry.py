"""Queries by name, each with its SQL twin where there is one."""

from __future__ import annotations

FOUND: dict[str, tuple] = {}
K = ["clip"]


def query(sql: str | None = None):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict:
    return {k: v[0] for k, v in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in FOUND.items() if v[1]}
