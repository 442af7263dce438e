"""Queries with their oracle SQL side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    """QUERIES and SQL of a module; ``prelude`` holds the common table expressions of its oracle."""

    def __init__(self, prelude: str = ""):
        self.prelude, self.queries, self.sql = prelude, {}, {}

    def __call__(self, sql: str | None = None) -> Callable:
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = self.prelude + sql
            return f

        return add


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and no -0), since sums depend on the order of rows, and days and times as text."""
    kinds = {"double": lambda c: F.round(c, digits) + F.lit(0.0), "date": lambda c: F.col(c).cast("string"), "timestamp_ntz": lambda c: F.col(c).cast("string")}
    return df.select(*[kinds.get(t, F.col)(c).alias(c) for c, t in df.dtypes])
