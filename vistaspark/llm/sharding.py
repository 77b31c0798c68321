"""Size-balanced sharding by sampled splitters, in DataFrame functions only.

Records are ordered by the hash of their text (equal texts are neighbours). A sample drawn with
probability in proportion to size gives quantile boundaries, which cut the order into ranges of
about equal bytes; a range that its measured bytes show to be overfull (one text may fill it) is
subdivided by a second hash of the record. Running byte sums inside the ranges and the ranges'
offsets give every record its exact place in the whole order, and the shard follows from it.
A group of equal texts that is small against a shard is not cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import materialise, table, text_or_empty

SAMPLES_PER_RANGE = 32
ROWS_PER_RANGE = 50_000
LEAST_RANGES, MOST_RANGES = 32, 16_384
WHOLE_GROUP = 1000  # groups below 1/1000 of a shard stay whole


def _range_of(key: str, splitters: list[int]) -> str:
    """SQL for the number of splitters at or below ``key``: a binary search in a literal array."""
    steps = len(splitters).bit_length()
    if not splitters:
        return "0"
    array = "array(" + ", ".join(f"{s}L" if s != -2**63 else "-9223372036854775807L" for s in splitters) + ")"
    jumps = "array(" + ", ".join(str(1 << k) for k in reversed(range(steps))) + ")"
    return (f"aggregate({jumps}, 0, (lo, step) -> if(lo + step <= {len(splitters)} and "
            f"get({array}, lo + step - 1) <= {key}, lo + step, lo))")


def splitters(keys: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of (key, tie, size): at most ``ranges`` - 1.
    The expected sample has SAMPLES_PER_RANGE points a range, whatever the table's size."""
    rate = SAMPLES_PER_RANGE * ranges / max(total, 1)
    u = F.expr("cast(shiftrightunsigned(xxhash64(tie, 17), 11) as double) / 9007199254740992")
    points = (keys.select("key", F.floor(F.col("size") * F.lit(rate) + u).alias("weight")).where("weight > 0")
              .groupBy("key").agg(F.sum("weight").alias("weight")))
    upto = F.sum("weight").over(Window.orderBy("key"))  # the sample is bounded, so one task is enough
    cell = F.floor((F.col("upto") - 1) * ranges / F.col("total"))
    found = (points.withColumns({"upto": upto, "total": F.expr("sum(weight) over ()")})
             .select("key", cell.alias("cell")).groupBy("cell").agg(F.min("key").alias("key")).where("cell > 0"))
    return sorted({r["key"] for r in found.collect()})


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, size, text_crc32, shard, slot), one row for each row.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1); the shards' sizes are near equal and the
    slots of a shard run from 0 without gaps. Null texts count as empty (crc32 0). Null or repeated
    doc_ids and equal rows are placed one by one; an empty table gives no rows; other columns are
    ignored.
    """
    keys = materialise(docs.select(
        "doc_id", (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), F.xxhash64(text_or_empty()).alias("key"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("tie")), "shard-keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(LEAST_RANGES, min(MOST_RANGES, rows // ROWS_PER_RANGE))
    placed = keys.withColumn("range", F.expr(_range_of("key", splitters(keys, total, ranges))))

    # overfull ranges: as many pieces as target sizes fit in; a fixed bound of rows, so broadcast
    target = max(total // ranges, 1)
    measured = placed.groupBy("range").agg(F.sum("size").alias("bytes"))
    pieces = F.broadcast(measured.select("range", F.expr(f"greatest(1, bytes div {2 * target})").alias("pieces")))
    placed = placed.join(pieces, "range").withColumn(
        "piece", F.expr("if(pieces = 1, 0, pmod(xxhash64(tie, 29), pieces))")).drop("pieces")
    before = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(placed.groupBy("range", "piece").agg(F.sum("size").alias("bytes"))
                          .select("range", "piece", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset")))

    inside = Window.partitionBy("range", "piece").orderBy("key", "tie")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "piece", "key")
    ordered = (placed.withColumns({"row": F.row_number().over(inside), "start": F.sum("size").over(running) - F.col("size")})
               .withColumns({"group_start": F.min("start").over(group), "group_bytes": F.sum("size").over(group)})
               .join(offsets, ["range", "piece"]))
    whole = F.col("group_bytes") * (shards * WHOLE_GROUP) <= total
    middle = F.when(whole, 2 * F.col("group_start") + F.col("group_bytes")).otherwise(2 * F.col("start") + F.col("size"))
    ordered = materialise(
        ordered.withColumn("middle", middle + 2 * F.col("offset"))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, {shards} * middle div {2 * max(total, 1)}) as int)"))
        .select("doc_id", "size", "text_crc32", "range", "piece", "row", "shard"), "shard-order")

    # rows of a shard before this piece; a piece's rows of one shard are consecutive
    counts = ordered.groupBy("range", "piece", "shard").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.broadcast(counts.select("range", "piece", "shard", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")))
    return (ordered.join(counts, ["range", "piece", "shard"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("row") + F.col("shift")).cast("long").alias("slot")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
