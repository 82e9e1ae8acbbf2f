"""Registered queries and the SQL each is checked against."""

from unitwise.registry.base import ORACLE, QUERIES


def _load() -> None:
    import importlib
    for part in ("core", "sheets", "scoring", "feeds"):
        importlib.import_module(f"unitwise.registry.{part}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracle_sql():
    _load()
    return dict(ORACLE)
