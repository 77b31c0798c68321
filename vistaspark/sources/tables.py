"""Scans and sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EXT = {"parquet": "parquet", "json": "json", "csv": "csv", "orc": "orc"}


def load_tables(spark: SparkSession, root: str, names: Sequence[str], fmt: str = "parquet",
                schemas: Mapping[str, T.StructType] | None = None,
                options: Mapping[str, str] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """Load a named set of tables; a missing one is reported, not fatal.

    ``fmt="mongodb"`` reads collections through the MongoDB Spark connector (``root`` is the
    database name) when its jar is on the classpath. A declared schema avoids inference; a
    missing table with a declared schema comes back as a typed empty DataFrame.
    """
    schemas = schemas or {}
    tables: dict[str, DataFrame] = {}
    missing: list[str] = []
    for name in names:
        reader = spark.read.format(fmt).options(**(options or {}))
        if name in schemas:
            reader = reader.schema(schemas[name])
        try:
            if fmt == "mongodb":
                df = reader.option("database", root).option("collection", name).load()
            else:
                df = reader.load(f"{root.rstrip('/')}/{name}.{_EXT.get(fmt, fmt)}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # anything else is a fault, not an absent table
                raise
            missing.append(name)
            if name in schemas:
                tables[name] = spark.createDataFrame([], schemas[name])
            continue
        tables[name] = df
    return tables, missing


def recent(df: DataFrame, order_col: str, key: str, n: int | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """Projected, newest-first read; bounded to ``n`` rows when given (whole table otherwise).

    ``orderBy(...).limit(n)`` plans as a distributed TakeOrderedAndProject (top-n per task).
    """
    out = df.select(*(cols or df.columns)).orderBy(F.desc(order_col), F.desc(key))
    return out.limit(n) if n else out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """S3: exactly the declared columns, cast to their types; absent ones as typed nulls."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def ragged_union(dfs: Sequence[DataFrame], empty_strings: bool = True) -> DataFrame:
    """Union of frames with different columns; columns sorted by name; a missing string
    field becomes '' (as in a flat export), other missing fields null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    cols = sorted(out.columns)
    if not empty_strings:
        return out.select(*cols)
    types = dict(out.dtypes)
    return out.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if types[c] == "string" else F.col(c) for c in cols])
