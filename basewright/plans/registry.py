"""Every registered query and the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalar", "quality", "tokens", "windows", "sampling", "masking", "metrics", "interactions", "catalog", "sources", "streams")

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, sql: str | None = None):
    """Register a query function (spark, sf_dir) with its DuckDB SQL, if it has one."""

    def put(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def load() -> None:
    for m in MODULES:
        import_module(f"basewright.plans.{m}")
