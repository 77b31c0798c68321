"""Full, differential and incremental copies of tables in a versioned store.

A store is a folder with

* ``data/version=N/tabla=T``: the rows of copy N of table T, with ``_op``: 'U' (a row as it is now) or
  'D' (a tombstone: only the key is set). A full copy has every row, a delta the rows that changed
  since the copy it is based on.
* ``control/v=N``: one row for each table of copy N (``CONTROL``), written last. A copy without its
  control rows isn't there, so a job that died midway is run again and overwrites what it left.

A differential copy is based on the last full copy, an incremental one on the last copy of any kind;
without such a copy every row is taken. A row counts as changed when its timestamp is later than the
base's high-water mark (a filter that reaches the scan), when it has none, or when the base
did not hold its key; keys that only the base holds become tombstones. Only key columns are shuffled to
find new and deleted keys. Restoring takes the base of a copy's chain, drops the keys that deltas
touch, and adds each one's latest version.

Keys are unique and not null. Copies write when called. The control rows that are read to the driver
are those of one table: one for each copy.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

FULL, DIFFERENTIAL, INCREMENTAL = "completa", "diferencial", "incremental"
CONTROL = ("version int, tipo string, copiada timestamp_ntz, tabla string, llaves string, base int, desde timestamp_ntz, "
           "filas long, bajas long, nueva_marca timestamp_ntz")
UPSERT, DELETE = "U", "D"


@dataclass(frozen=True)
class Source:
    """A table to copy: its rows, key columns and the column that says when a row last changed."""

    rows: DataFrame
    keys: Sequence[str]
    updated: str


@dataclass(frozen=True)
class BackupStore:
    spark: SparkSession
    path: str

    def control(self) -> DataFrame:
        """One row for each copy and table (CONTROL); empty for a new store."""
        self.spark.createDataFrame([], CONTROL).write.mode("ignore").parquet(f"{self.path}/control/v=0")
        return self.spark.read.schema(CONTROL).parquet(f"{self.path}/control/v=*")

    def last(self, kinds: Sequence[str] = (FULL, DIFFERENTIAL, INCREMENTAL)) -> int | None:
        """The newest copy of one of the kinds."""
        return self.control().where(F.col("tipo").isin(*kinds)).agg(F.max("version")).first()[0]

    def entries(self, table: str) -> dict[int, Row]:
        """A table's control rows by version."""
        return {r.version: r for r in self.control().where(F.col("tabla") == table).collect()}

    def chain(self, table: str, version: int, entries: Mapping[int, Row] | None = None) -> list[Row]:
        """The control rows that make up a table's copy, its base first."""
        entries, found = self.entries(table) if entries is None else entries, []
        at: int | None = version
        while at is not None:
            if at not in entries:
                raise ValueError(f"table {table} is not in copy {at}")
            found.insert(0, entries[at])
            at = entries[at].base
        return found

    def _folder(self, table: str, version: int) -> str:
        return f"{self.path}/data/version={version}/tabla={table}"

    def delta_rows(self, table: str, version: int) -> DataFrame:
        """What copy ``version`` holds of the table, with ``_op``."""
        return self.spark.read.parquet(self._folder(table, version))

    def restore(self, table: str, version: int | None = None, entries: Mapping[int, Row] | None = None) -> DataFrame:
        """The table as it was at a copy (the newest one that has it): base plus deltas, deletes applied."""
        entries = self.entries(table) if entries is None else entries
        version = max(entries, default=None) if version is None else version
        if version is None:
            raise ValueError(f"no copy of {table}")
        base, *deltas = self.chain(table, version, entries)
        rows = self.delta_rows(table, base.version).drop("_op")
        deltas = [d for d in deltas if d.filas or d.bajas]
        if not deltas:
            return rows
        keys = base.llaves.split(",")
        stacked = None
        for d in deltas:
            one = self.delta_rows(table, d.version).withColumn("_version", F.lit(d.version))
            stacked = one if stacked is None else stacked.unionByName(one)
        latest = stacked if len(deltas) == 1 else (
            stacked.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stacked.columns if c not in keys]), "_version").alias("_r"))
            .select(*keys, "_r.*"))
        return (rows.join(latest.select(*keys), keys, "left_anti")
                .unionByName(latest.where(F.col("_op") == UPSERT).select(*rows.columns)))

    def copy(self, tables: Mapping[str, Source], kind: str, copied_at: dt.datetime) -> int:
        """Copies the tables and returns the copy's version. A table without changes has a control row
        with zero rows and tombstones, and an empty folder."""
        if kind not in (FULL, DIFFERENTIAL, INCREMENTAL):
            raise ValueError(f"unknown kind of copy: {kind}")
        known: dict[str, dict[int, Row]] = {}
        kinds: dict[int, str] = {}
        for r in self.control().collect():  # a row for each copy and table
            known.setdefault(r.tabla, {})[r.version] = r
            kinds[r.version] = r.tipo
        version = max(kinds, default=0) + 1
        based_on = {FULL: (), DIFFERENTIAL: (FULL,), INCREMENTAL: (FULL, DIFFERENTIAL, INCREMENTAL)}[kind]
        ref = max((v for v, k in kinds.items() if k in based_on), default=None)
        rows = []
        for name, source in tables.items():
            before = known.get(name, {}).get(ref)
            written = self._write(name, source, version, before, known.get(name, {}))
            mark = max((m for m in (written.mark, before and before.nueva_marca) if m is not None), default=None)
            rows.append((version, kind, copied_at, name, ",".join(source.keys), before and before.version,
                         before and before.nueva_marca, written.filas, written.bajas, mark))
        self.spark.createDataFrame(rows, CONTROL).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/control/v={version}")
        return version

    def _write(self, name: str, source: Source, version: int, before: Row | None, entries: Mapping[int, Row]) -> Row:
        if before is None:
            out = source.rows.withColumn("_op", F.lit(UPSERT))
        else:
            out = delta(source, self.restore(name, before.version, entries).select(*source.keys), before.nueva_marca)
        out.write.mode("overwrite").parquet(self._folder(name, version))
        dead = F.col("_op") == DELETE
        return self.spark.read.schema(out.schema).parquet(self._folder(name, version)).agg(
            F.count_if(~dead).alias("filas"), F.count_if(dead).alias("bajas"),
            F.max(F.col(source.updated).cast("timestamp_ntz")).alias("mark")).first()


def delta(source: Source, before_keys: DataFrame, since: dt.datetime | None) -> DataFrame:
    """Rows changed since ``since`` or absent from ``before_keys`` (``_op`` U), and the keys that only
    ``before_keys`` has (``_op`` D, other columns null)."""
    keys = list(source.keys)
    # a side that lacks the key has a null mark
    both = (source.rows.select(*keys, F.lit(True).alias("_now"))
            .join(before_keys.withColumn("_had", F.lit(True)), keys, "full")
            .where(F.col("_now").isNull() | F.col("_had").isNull()))
    stamp = F.col(source.updated)
    late = stamp.isNull() | (stamp > F.lit(since).cast("timestamp_ntz")) if since is not None else F.lit(True)
    changed = source.rows.where(late)
    added = source.rows.where(~late).join(both.where("_had is null").select(*keys), keys, "left_semi")
    gone = both.where("_now is null").select(
        *[F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in source.rows.schema.fields],
        F.lit(DELETE).alias("_op"))
    return changed.unionByName(added).withColumn("_op", F.lit(UPSERT)).unionByName(gone)
