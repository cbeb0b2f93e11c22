"""Query registry and the composition of check SQL from named parts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakewarden.plans.medallion import Lake, lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PARTS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a ``Lake`` with its optional check SQL."""

    def register(fn: Callable[[Lake], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(lake(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def part(name: str, sql: str) -> None:
    """A named sub-query other SQL may refer to."""
    PARTS[name] = sql


def compose(body: str) -> str:
    """Prefix ``body`` with the parts it refers to, in dependency order."""
    needed: list[str] = []
    open_parts: set[str] = set()  # a recursive part refers to itself

    def visit(sql: str) -> None:
        for word in re.findall(r"\b[a-z_0-9]+\b", sql):
            if word in PARTS and word not in needed and word not in open_parts:
                open_parts.add(word)
                visit(PARTS[word])
                needed.append(word)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{n} AS ({PARTS[n]})" for n in needed)
    return f"WITH RECURSIVE {parts}\n{body}"
