"""Structured Streaming monitors (X1, X2), re-aimed from polled pages.

Both read a file source, aggregate with a watermark in ``update`` mode and hand each
micro-batch to ``foreachBatch``, which appends the updated rows (tagged with the batch id)
to a changelog table in the shared checkpoint folder. The current answer is the latest
version of every key in the changelog (a partial ``max_by`` aggregate), so no state or
result is ever collected on the driver, and a restarted query resumes from its checkpoint
(the changelog write is idempotent per batch id because each batch writes its own folder).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.numbers import pct

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet",
                 schema: T.StructType = EVENT_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over the parquet files of ``folder`` matching ``pattern``."""
    r = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(folder)


def out_of_range(sign: Column, value: Column, ranges: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """True when ``value`` is outside the range of its sign (signs without a range: False)."""
    cond = F.lit(False)
    for name, (lo, hi) in ranges.items():
        side = F.lit(False)
        if lo is not None:
            side = side | (value < lo)
        if hi is not None:
            side = side | (value > hi)
        cond = cond | ((sign == name) & side)
    return F.coalesce(cond, F.lit(False))


def alert_rate_stream(events: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]],
                      ts: str = "ts", sign: str = "event_type", value: str = "value",
                      window: str = "1 hour", delay: str = "30 minutes") -> DataFrame:
    """Alerts / valid readings per sign per tumbling window; rows later than the
    watermark (``delay`` behind the newest event seen) are dropped. Spark checks late rows
    against the watermark of the previous micro-batch, so a row is dropped once the batch
    that moved the watermark past it has been followed by one more.

    Watermarks need an instant (TIMESTAMP); a wall-clock (TIMESTAMP_NTZ) column is cast to
    one in the session zone, and window bounds are cast back for output."""
    return (
        with_event_time(events, ts).withWatermark("_et", delay)
        .groupBy(F.window("_et", window).alias("ventana"), F.col(sign).alias("signo"))
        .agg(F.count_if(out_of_range(F.col(sign), F.col(value), ranges)).alias("alertas"),
             F.count(value).alias("validos"))
    )


def actions_per_user_stream(events: DataFrame, ts: str = "ts", user: str = "user_id", key: str = "event_id",
                            delay: str = "1 hour") -> DataFrame:
    """Actions per user, each event counted once (duplicates within the watermark are
    dropped with ``dropDuplicatesWithinWatermark``)."""
    return (
        with_event_time(events, ts).withWatermark("_et", delay).dropDuplicatesWithinWatermark([key])
        .groupBy(F.col(user).alias("id_usuario")).agg(F.count(F.lit(1)).alias("acciones"), F.max(ts).alias("ultima"))
    )


class PendingRequests(StatefulProcessor):
    """Per request its newest state change, and a change of its type's pending count for each move
    into or out of the pending state.

    Changes of a request are ordered by (time, sequence number), so older and repeated ones that
    arrive later change nothing. A request that isn't pending keeps its state for ``keep_ms`` of event
    time, in which an older change can still come; then a timer drops it. A pending request stays.
    """

    def __init__(self, pending: str, keep_ms: int):
        self.pending, self.keep_ms = pending, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, seq long, tipo string, estado string, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.newest.get()  # None for a request not seen yet
        at, seq, tipo, estado, timer = old or (-(1 << 63), -1, None, None, 0)
        watermark, moves = timerValues.getCurrentWatermarkInMs(), []
        changed = False
        for batch in rows:
            for ms, n, kind, state in batch.sort_values(["at_ms", "seq"])[["at_ms", "seq", "tipo", "estado"]].itertuples(index=False, name=None):
                if (ms, n) <= (at, seq) or (old is None and ms + self.keep_ms <= watermark):
                    continue  # older, repeated, or of a request whose state may have been dropped
                moves += [(tipo, -1)] if estado == self.pending else []
                moves += [(kind, 1)] if state == self.pending else []
                at, seq, tipo, estado, changed = ms, n, kind, state, True
        if changed:
            if timer:
                self.handle.deleteTimer(timer)
            timer = 0 if estado == self.pending else max(at + self.keep_ms, watermark + 1)
            if timer:
                self.handle.registerTimer(timer)
            self.newest.update((int(at), int(seq), tipo, estado, int(timer)))
        if moves:
            yield pd.DataFrame(moves, columns=["tipo", "cambio"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, as arbitrary
    state with timers needs; the caller's session keeps its settings."""
    other = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        other.conf.set(key, spark.conf.get(key))
    other.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return other


def pending_changes_stream(changes: DataFrame, key: str = "id_solicitud", tipo: str = "tipo", estado: str = "estado", ts: str = "ts",
                           seq: str = "secuencia", pending: str = "PENDIENTE", delay: str = "1 hour", keep_ms: int = 3_600_000) -> DataFrame:
    """State changes of requests -> (tipo, cambio): +1 when a request becomes pending, -1 when it
    leaves that state or its type. ``changes`` come from a :func:`stateful_session`. The sum of
    ``cambio`` is the pending count, so a request that is no longer pending lowers it. ``delay``:
    how late a change may come; ``keep_ms`` is at least that long. Changes without a key or a time
    belong to no request and go."""
    rows = changes.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("id"), F.col(tipo).alias("tipo"), F.col(estado).alias("estado"), F.col(seq).cast("long").alias("seq"),
        F.col(ts).cast("timestamp").alias("_et"))
    return (rows.withWatermark("_et", delay).withColumn("at_ms", F.unix_millis("_et")).groupBy("id")
            .transformWithStateInPandas(PendingRequests(pending, keep_ms), "tipo string, cambio long", "Append", "EventTime"))


def run_to_change_log(changes: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Runs (tipo, cambio) over everything available now. Each micro-batch writes the net change of
    each type to ``log/batch=<id>`` (overwritten when a batch is replayed). Returns the ended query."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("tipo").agg(F.sum("cambio").alias("cambio")).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    q = (changes.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def pending_now(spark: SparkSession, log: str) -> DataFrame:
    """Pending requests per type: the sum of a log's changes; types without any are absent."""
    rows = spark.read.schema("tipo string, cambio long").option("basePath", log).parquet(f"{log}/batch=*")
    return rows.groupBy("tipo").agg(F.sum("cambio").alias("pendientes")).where("pendientes <> 0")


def with_event_time(events: DataFrame, ts: str) -> DataFrame:
    """Add ``_et``: the event time as an instant, as watermarks require."""
    return events.withColumn("_et", F.col(ts).cast("timestamp"))


def run_to_changelog(agg: DataFrame, changelog: str, checkpoint: str, output_mode: str = "update") -> None:
    """Run a streaming aggregate over everything available now, appending each micro-batch's
    updated rows (with its batch id) under ``changelog/batch=<id>`` (overwrite per batch, so a
    replayed batch rewrites rather than duplicates)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{changelog}/batch={batch_id}")

    q = (agg.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def current_state(spark: SparkSession, changelog: str, keys: list[str], values: list[str]) -> DataFrame:
    """Latest version of each key in a changelog written by :func:`run_to_changelog`."""
    log = spark.read.option("basePath", changelog).parquet(f"{changelog}/batch=*")
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch_id")).alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def alert_rates_now(spark: SparkSession, changelog: str) -> DataFrame:
    s = current_state(spark, changelog, ["ventana", "signo"], ["alertas", "validos"])
    return s.select(F.col("ventana.start").cast("timestamp_ntz").alias("inicio"), "signo", "alertas", "validos",
                    pct("alertas", "validos").alias("porcentaje"))
