"""Sinks and table snapshots.

Writes are ``mode("overwrite")`` into a folder per run, so a retried job (a lost executor,
a rerun) rewrites the same output instead of appending twice. Nothing is collected to the
driver: every export is a distributed write.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_ts


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir`` (set by the cluster)."""
    from ..session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/vistaspark-out/{name}-{uuid.uuid4().hex[:12]}"


def write_results(df: DataFrame, path: str, run_id: str, section: str, fmt: str = "json") -> None:
    """One result table per analysis phase, partitioned by section. Dynamic partition
    overwrite replaces only this section of this run, so phases can be written one by one and
    a rerun of a phase rewrites it instead of duplicating it."""
    (df.withColumn("run_id", F.lit(run_id)).withColumn("section", F.lit(section))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section")
     .format(fmt).save(f"{path}/run_id={run_id}"))


def write_extract(df: DataFrame, where: Column | str, path: str, fmt: str = "csv") -> None:
    """Filtered extract (alerts) as CSV with header or JSON."""
    w = df.filter(where).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def export_types(df: DataFrame) -> DataFrame:
    """S7 type normalisation: ids (long) -> string, dates/timestamps -> ISO text, decimal -> double."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.LongType) and (f.name.lower().startswith("id") or f.name.lower().endswith("_id")):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def export_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "json") -> dict[str, str]:
    """Snapshot each table with normalised types; one folder per table."""
    out = {}
    for name, df in tables.items():
        target = f"{path}/{name}"
        w = export_types(df).write.mode("overwrite")
        (w.option("header", True).csv(target) if fmt == "csv" else w.format(fmt).save(target))
        out[name] = target
    return out


def restore_tables(spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, T.StructType],
                   fmt: str = "json") -> dict[str, DataFrame]:
    """Read snapshots back and re-type them to the declared schema (dates re-parsed)."""
    out = {}
    for name, p in paths.items():
        schema = schemas[name]
        raw = (spark.read.option("header", True).csv(p) if fmt == "csv"
               else spark.read.format(fmt).load(p))
        cols = []
        have = set(raw.columns)
        for f in schema.fields:
            if f.name not in have:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            elif isinstance(f.dataType, T.DateType):
                cols.append(F.to_date(parse_ts(F.col(f.name))).alias(f.name))
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                cols.append(parse_ts(F.col(f.name)).cast(f.dataType).alias(f.name))
            else:
                cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        out[name] = raw.select(*cols)
    return out


PUBLISHED = "version long, corrida string, tabla string, carpeta string, filas long"


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, run: str) -> int:
    """Several tables as one commit. Each attempt writes the tables to a folder of its own; one small
    manifest file, written last, names them all, so a reader sees all tables of a run or none, and a run
    that is repeated replaces all of them. Returns the manifest's version."""
    known = _manifest(spark, path).agg(F.max("version")).first()[0] or 0
    attempt = uuid.uuid4().hex[:12]
    rows = []
    for name, df in tables.items():
        folder = f"{path}/data/{attempt}/{name}"
        df.write.parquet(folder)
        rows.append((known + 1, run, name, folder, spark.read.schema(df.schema).parquet(folder).count()))
    spark.createDataFrame(rows, PUBLISHED).coalesce(1).write.parquet(f"{path}/manifest/v={known + 1}")
    return known + 1


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    spark.createDataFrame([], PUBLISHED).write.mode("ignore").parquet(f"{path}/manifest/v=0")
    return spark.read.schema(PUBLISHED).parquet(f"{path}/manifest/v=*")


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current manifest rows: of each run the newest version (PUBLISHED)."""
    rows = _manifest(spark, path)
    newest = rows.groupBy("corrida").agg(F.max("version").alias("version"))
    return rows.join(newest, ["corrida", "version"], "left_semi")


def read_published(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of all published runs, with ``corrida``. The manifest has a row for each run and table."""
    out = None
    for r in published(spark, path).where(F.col("tabla") == table).collect():
        one = spark.read.parquet(r.carpeta).withColumn("corrida", F.lit(r.corrida))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"nothing published for {table}")
    return out


def changed_since(df: DataFrame, ts_col: str, watermark: str) -> DataFrame:
    """Rows changed after the watermark (a pushable filter on the timestamp)."""
    return df.filter(F.col(ts_col) > F.lit(watermark).cast("timestamp_ntz"))


def change_summary(tables: Mapping[str, tuple[DataFrame, str]], watermark: str) -> DataFrame:
    """Per table: rows changed since the watermark and the new high-water mark.

    One small aggregate per table, stacked (a union of one-row results).
    """
    out = None
    for name, (df, ts) in tables.items():
        wm = F.lit(watermark).cast("timestamp_ntz")
        one = df.agg(
            F.lit(name).alias("tabla"),
            F.count_if(F.col(ts).cast("timestamp_ntz") > wm).alias("cambios"),
            F.max(F.col(ts).cast("timestamp_ntz")).alias("nueva_marca"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def retain_latest(df: DataFrame, group: str | Sequence[str], ts: str, key: str, n: int = 4) -> DataFrame:
    """Keep the newest ``n`` rows per group (WindowGroupLimit before the shuffle)."""
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*groups).orderBy(F.desc(ts), F.desc(key))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
