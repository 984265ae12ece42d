"""Name -> (Spark query, SQL twin or None)."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            # Named steps are computed once, as they are in the Spark plan.
            SQL[name] = re.sub(r"(?m)^(with |, )?(\w+) as \(", r"\1\2 as materialized (", sql)
        return fn

    return add
