"""Runnable queries, one or more per operator, each with the SQL that checks it."""

from importlib import import_module

_MODULES = ("tables", "extraction", "decisions", "talk", "streams")


def _load():
    for name in _MODULES:
        import_module(f"packlens.plans.{name}")
    return import_module("packlens.plans.registry")


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
