"""Registered queries: each pairs a Spark plan over the given tables with, where SQL can express it, the same query as SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelmill.sources.market import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, directly or through other views."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(VIEWS[name])

    visit(sql)
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in used)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


_MARKETS: dict[str, Market] = {}


def market(spark: SparkSession, root: str) -> Market:
    """One set of lazy views per session and folder: plans are built once, nothing is materialised."""
    known = _MARKETS.get(root)
    if known is None or known.spark is not spark:
        known = _MARKETS[root] = Market(spark, root)
    return known


def forget() -> None:
    """Drop the shared plans and stages, so that the next query builds its own."""
    _MARKETS.clear()


def shared(fn: Callable[[Market], DataFrame]) -> Callable[[Market], DataFrame]:
    """Build the plan of a common sub-query once per market."""
    key = f"{fn.__module__}.{fn.__qualname__}"

    def once(t: Market) -> DataFrame:
        if key not in t.plans:
            t.plans[key] = fn(t)
        return t.plans[key]

    return once


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(market(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of ``rnd``; never yields a negative zero."""
    return f"(round(({expr})::DOUBLE + 1e-{digits + 2}::DOUBLE, {digits}) + 0.0::DOUBLE)"
