"""Registered queries of the core: name -> callable(spark, folder), and the SQL that restates them."""

from importlib import import_module

MODULES = ["general_problems", "scalars", "engines", "more", "later"]


def collect(modules: list[str] = MODULES) -> tuple[dict, dict]:
    queries: dict = {}
    oracles: dict = {}
    for name in modules:
        m = import_module(f"linklake.plans.{name}")
        queries |= m.QUERIES
        oracles |= m.ORACLES
    return queries, oracles
