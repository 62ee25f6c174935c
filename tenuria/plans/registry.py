"""Registry of queries and the SQL that checks each of them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenuria.plans.check_ctes import CTES
from tenuria.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

_NAME = re.compile(r"\b[a-z_0-9]+\b")


@dataclass(frozen=True)
class Check:
    """Check SQL: a SELECT over the tables and the shared CTEs, and its output columns by kind."""

    body: str
    ints: str = ""
    reals: str = ""
    other: str = ""
    extra: tuple[tuple[str, str], ...] = ()

    def sql(self) -> str:
        ctes = {**CTES, **dict(self.extra)}
        needed: set[str] = set()

        def visit(text: str) -> None:
            for name in set(_NAME.findall(text)) & ctes.keys() - needed:
                needed.add(name)
                visit(ctes[name])

        visit(self.body)
        cols = [f"CAST({c} AS BIGINT) AS {c}" for c in self.ints.split()]
        cols += [f"ROUND(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in self.reals.split()]
        cols += self.other.split()
        with_list = [f"{n} AS ({b})" for n, b in ctes.items() if n in needed]
        with_list.append(f"answer AS ({self.body})")
        return "WITH " + ",\n".join(with_list) + "\nSELECT " + ", ".join(cols) + " FROM answer"


def tidy(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, reals as DOUBLE rounded to 6 places, so values compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FractionalType):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(key: str, check: Check | None = None):
    """Register `fn(spark, directory) -> DataFrame` under `key`."""

    def register(fn):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return tidy(fn(tune(spark), directory))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = run
        if check is not None:
            CHECKS[key] = check.sql()
        return fn

    return register
