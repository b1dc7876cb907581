"""Registry of queries and of the equivalent SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.views import SQL_VIEWS

#: tables that refer to themselves name their columns
RECURS = re.compile(r"\w\([\w, ]+\)( USING KEY \([\w, ]+\))? AS ")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sql(views: str, body: str) -> str:
    """Prefix a statement with the definitions of the views it reads."""
    names: list[str] = []

    def need(n: str) -> None:
        for d in SQL_VIEWS[n][0]:
            need(d)
        if n not in names:
            names.append(n)

    for v in views.split():
        need(v)
    body = body.strip()
    head = ", ".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in names)
    start = "WITH RECURSIVE" if RECURS.search(body) else "WITH"
    if not head:
        return body if body.upper().startswith("SELECT") else f"{start} {body}"
    sep = " " if body.upper().startswith("SELECT") else ", "
    return f"{start} {head}{sep}{body}"


def query(name: str, views: str = "", oracle: str | None = None):
    """Register a query; with `oracle` also the SQL twin over the named views."""

    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = sql(views, oracle)
        return fn

    return wrap
