"""Small shared helpers for operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (list, tuple)):
        return list(x)
    return [x]


def money_sum(c) -> Column:
    """Exact money total: decimal(18,2) inputs summed into decimal(38,2)."""
    return F.sum(col_of(c).cast("decimal(18,2)")).cast("decimal(38,2)")


def r6(c) -> Column:
    """Round an aggregated double to 6 places: sums and means of doubles depend on the
    order of addition in their last bits; rounding makes the reported value stable."""
    return F.round(col_of(c).cast("double"), 6)


def rule_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal rule table. Its size is fixed by code, so broadcasting it is bounded."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def dense_index(df: DataFrame, order: Sequence, start: int | Column = 1, value: str | None = None,
                index_name: str = "n", running_name: str = "acumulado",
                partitions: int | None = None) -> DataFrame:
    """Global 1-based row number (and optional running sum of ``value``) in ``order``.

    A window without PARTITION BY would pull every row into one task. Instead the rows are
    range-partitioned on the (total) order and written to the shared folder with their partition
    number: range bounds come from a sample, and two evaluations of one plan may cut differently,
    so both the totals and the rows must read the same written split. Rows are numbered and summed
    inside each partition; each partition's offset comes from a totals table whose size is bounded
    by the partition count (broadcast is safe).
    """
    order_cols = [col_of(o) for o in order]
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = df.repartitionByRange(n_parts, *order_cols).withColumn("_pid", F.spark_partition_id())
    path = f"{checkpoint_dir(spark).rstrip('/')}/dense-index-{uuid.uuid4().hex[:12]}"
    split.write.parquet(path)
    ranged = spark.read.schema(split.schema).parquet(path)
    w = Window.partitionBy("_pid").orderBy(*order_cols)
    local = ranged.withColumn("_rn", F.row_number().over(w))
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    if value is not None:
        local = local.withColumn(
            "_run", F.sum(col_of(value)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        )
        aggs.append(F.sum(col_of(value)).alias("_tot"))
    totals = local.groupBy("_pid").agg(*aggs)
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(wp), F.lit(0)).alias("_off_n"),
        *([F.coalesce(F.sum("_tot").over(wp), F.lit(0)).alias("_off_v")] if value is not None else []),
    )
    out = local.join(F.broadcast(offsets), "_pid")
    start_c = start if isinstance(start, Column) else F.lit(start)
    out = out.withColumn(index_name, (out["_rn"] + out["_off_n"] + start_c - 1).cast("long"))
    if value is not None:
        out = out.withColumn(running_name, out["_run"] + out["_off_v"])
    return out.drop("_pid", "_rn", "_run", "_off_n", "_off_v", "_cnt", "_tot")


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def rsig(c, digits: int = 11) -> Column:
    """Round to ``digits`` significant digits (magnitude buckets 1e-3 .. 1e15).

    Large sums of squares differ between engines in their last bits (order of addition);
    a relative rounding keeps reported values stable where fixed decimals would not."""
    x = col_of(c).cast("double")
    a = F.abs(x)
    out = None
    for e in range(15, -4, -1):
        cond = a >= float(10 ** e) if e >= 0 else a >= 10.0 ** e
        val = F.round(x, digits - 1 - e)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(F.round(x, digits + 3))
