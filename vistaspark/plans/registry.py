"""Query registry: each bound query is a Spark builder plus, where SQL can state the
answer, a DuckDB twin over the same parquet tables (``oracle_sql``)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .bind import Tables


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The query result; decimal (money) columns leave as DOUBLE, cast after the exact
        decimal arithmetic, so every reader sees plain floating-point numbers."""
        return as_doubles(raw_build(self, spark, sf_dir))

    def oracle(self) -> str | None:
        """The DuckDB twin, with the same decimal columns cast to DOUBLE."""
        from .decimal_outputs import DECIMAL_OUTPUTS

        cols = DECIMAL_OUTPUTS.get(self.key)
        if not self.sql or not cols:
            return self.sql
        repl = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in cols)
        return f"SELECT * REPLACE ({repl}) FROM (\n{self.sql}\n) AS _q"


def raw_build(q: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.build(Tables(spark, sf_dir.rstrip("/")))


def as_doubles(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    if not any(isinstance(f.dataType, T.DecimalType) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


REGISTRY: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key`` with its oracle SQL."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, fn, sql)
        return fn

    return deco
