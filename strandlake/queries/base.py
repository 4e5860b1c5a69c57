"""How a query is registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.adapters import with_views

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rounded: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        return df.withColumns({c: F.round(c, DIGITS) + 0.0 for c in self.rounded}) if self.rounded else df

    def oracle(self) -> str | None:
        if self.sql is None or not self.rounded:
            return self.sql
        cols = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in self.rounded)
        return f"SELECT * REPLACE ({cols}) FROM (\n{self.sql}\n)"


class Registry(dict):
    def add(self, name: str, views: str = "", sql: str | None = None, rounded: str = ""):
        """Register the decorated function; ``views``: adapters the SQL needs; ``rounded``: columns compared to six digits."""

        def put(build):
            self[name] = Query(name, build, None if sql is None else with_views(views, sql), tuple(rounded.split()))
            return build

        return put
