"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("features", "sequences", "evaluation", "splits", "modelling")


def _load():
    for module in MODULES:
        import_module(f"acctrisk.catalog.{module}")
    return import_module("acctrisk.catalog.registry")


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().SQL)
