"""Registry of runnable queries and their check statements."""
from __future__ import annotations

from quarterdeck.queries import adapter

QUERIES: dict = {}
CHECKS: dict[str, str] = {}
INSTEAD: dict[str, dict[str, str]] = {}
ORACLE: dict[str, str] = dict(adapter.CTES)


def query(name: str, check: str | None = None, instead: dict[str, str] | None = None):
    """Register ``fn(tables)``; ``check`` is the statement another engine must agree with, ``instead`` has parts of it that differ from the common ones."""
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(adapter.Tables(spark, sf_dir))
        if check is not None:
            CHECKS[name] = check
            INSTEAD[name] = instead or {}
        return fn
    return register


def check_sql() -> dict[str, str]:
    return {name: adapter.expand(sql, ORACLE | INSTEAD[name]) for name, sql in CHECKS.items()}
