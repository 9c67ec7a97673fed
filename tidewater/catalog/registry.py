"""Registry of queries and their oracle SQL.

A query is declared with an output spec ``"name:kind ..."``; the spec is applied to the Spark
result and to the oracle SQL alike, so both sides agree on names, types and rounding.
Kinds: none = as is, ``t`` timestamp as text, ``i`` bigint, ``d`` double rounded to 6 digits,
``d2`` rounded to 2 digits and so on.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.views import VIEW_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, spec: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    fields = [tuple((f.split(":") + [""])[:2]) for f in spec.split()]

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: _shape(fn(Tables(spark, folder)), fields)
        if oracle is not None:
            ORACLES[name] = _oracle(oracle, fields)
        return fn

    return register


def _shape(df: DataFrame, fields) -> DataFrame:
    out = []
    for name, kind in fields:
        c = F.col(name)
        if kind.startswith("d"):
            c = c.cast("double")
            c = F.round(F.when(~F.isnan(c), c), int(kind[1:] or 6)) + F.lit(0.0)
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "i":
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def _oracle(body: str, fields) -> str:
    out = []
    for name, kind in fields:
        if kind.startswith("d"):
            out.append(f"round(CAST({name} AS DOUBLE), {kind[1:] or 6}) + 0.0::DOUBLE AS {name}")
        elif kind == "t":
            out.append(f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}")
        elif kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            out.append(name)
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str):
        for view, sql in VIEW_SQL.items():
            if view not in seen and re.search(rf"\b{view}\b", text):
                seen.add(view)
                visit(sql)
                needed.append(view)

    visit(body)
    views = [f"{v} AS ({VIEW_SQL[v]})" for v in needed] + [f"answer AS ({body})"]
    return f"WITH {', '.join(views)} SELECT {', '.join(out)} FROM answer"
