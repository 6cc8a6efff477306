"""How queries are registered: a function or SQL text, and the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.sources.io import TABLES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers the decorated function, under its own name, with the DuckDB SQL of its rows."""

    def keep(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return keep


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the tables that ``text`` names in braces; no view is left behind."""
    used = {name for name in re.findall(r"\{(\w+)\}", text) if name in TABLES}
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in used})


def sql(name: str, text: str, oracle: str | None = "same") -> None:
    """Registers SQL text. ``oracle``: DuckDB's text, "same" if it is the same, None if none."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    if oracle is not None:
        ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", text if oracle == "same" else oracle)
