"""What a section registers: queries by name, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Section:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and without negative zeros."""
    return df.select(*[(F.round(F.col(n), digits) + 0.0).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])
