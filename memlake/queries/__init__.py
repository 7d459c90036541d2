"""Registered queries of the core engine, and the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("packed", "scan", "aggregates", "retrieval", "mutations", "pipelines", "more", "gates", "further")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"memlake.queries.{m}"), name)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
