"""Mixing sources to target weights by capped water-filling.

Every source's target is its weight's share of the budget, at most ``max_epochs`` times its size;
what a clamped source can't take is shared again among the others by weight, until no target is
above its cap. The state of that loop is one number, the words per unit of weight ("level"), so a
round is one aggregate over the table of sources and returns one row.

A source's target is then taken as whole repetitions of all its documents and a fractional one:
documents come in a seeded order (a digest of seed, doc_id and text), as many as fill the rest, and
the last of them gives as many words as are still missing. So a source takes its target to the
word, and no document more than ``max_epochs`` times its size. The place where the order is cut is
found without sorting a source: sizes are summed by ranges of the digest (partial sums, at most
``BUCKETS`` rows for each source), the range that holds the cut is divided again in the same way,
and only the documents of that last range, one in ``BUCKETS`` squared, are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators._common import dense_index
from ._io import materialise, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42
HEX = 3  # hex digits of a digest that number its range
BUCKETS = 16 ** HEX
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def weighted_sources(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with weight: sources by code point, null last, weigh ``weights`` in turn.

    Strings compare by their UTF-8 bytes, which is by code point. The numbers come from a range
    split, so many sources are no single task's work."""
    keyed = sizes.withColumn("_absent", F.col("source").isNull().cast("int"))
    turn = (F.col("_n") - 1) % len(weights)
    return (dense_index(keyed, ["_absent", "source"], index_name="_n")
            .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
            .drop("_absent", "_n"))


def water_level(sources: DataFrame, budget: int, max_epochs: int = MAX_EPOCHS) -> float:
    """Words per unit of weight at which the clamped targets add up to ``budget``.

    A level never falls from round to round, and a source once clamped stays so; the loop ends when
    a round clamps nothing new, after as many rounds as sources at most (in practice a few). With
    nothing left to share (an empty table, or all clamped) the level is infinite."""
    cap, level, clamped = F.col("source_size") * max_epochs, 0.0, -1
    while True:
        over = cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).alias("full"), F.count_if(over).alias("n"),
                          F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("weights")).first()
        if row.weights == 0:
            return float("inf")
        if row.n == clamped:
            return level
        level, clamped = (budget - row.full) / row.weights, row.n


def targets(sources: DataFrame, budget: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) -> with target (double)."""
    cap, level = (F.col("source_size") * max_epochs).cast("double"), water_level(sources, budget, max_epochs)
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _cut(docs: DataFrame, need: DataFrame, keys: list[str], bucket: str, rest: str, new_rest: str) -> DataFrame:
    """For each key the range of ``bucket`` in which the running sum of sizes passes ``rest``, and
    what is missing when that range begins. A window holds one row for each range of one key."""
    sums = docs.groupBy(*keys, bucket).agg(F.sum("size").alias("_sum"))
    order = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.withColumn("_upto", F.sum("_sum").over(order)).join(need, keys)
    return (running.where((F.col("_upto") > F.col(rest)) & (F.col("_upto") - F.col("_sum") <= F.col(rest)))
            .select(*keys, bucket, (F.col(rest) - F.col("_upto") + F.col("_sum")).alias(new_rest)))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0,
        seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) -> (doc_id, source, size, source_size, target, taken): one
    row for each row; ``taken`` words of the mix come from it, repetitions counted.

    The budget is ``share`` of all words, and no more than all sources can give. Null texts have size
    0 and take nothing; a null source is a source of its own; null and repeated doc_ids come out as
    they are; rows that agree in doc_id and text are interchangeable, so that which of them is cut
    has no meaning; other columns are ignored; an empty table gives no rows. Equal inputs
    give equal results, whatever the partitioning. Writes a table of (doc_id, source, size, digest)
    and one of the sources to the shared folder when called.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       words(F.col("text")).alias("size"), digest.alias("order"))
    rows = materialise(rows, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialise(weighted_sources(sizes, weights), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    aims = targets(sources, min(round(total * share), total * max_epochs), max_epochs)
    # integers from here on: whole repetitions, and the words of the fractional one
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    # a null source joins itself: keys are made of source and of whether there is one
    aims = aims.select(F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("absent"), "source_size",
                       "target", whole.alias("whole"), (goal - whole * F.col("source_size")).alias("rest"))
    keyed = rows.select("*", F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("absent"),
                        F.substring("order", 1, HEX).alias("b1"), F.substring("order", 1 + HEX, HEX).alias("b2"))
    key = ["key", "absent"]
    cut1 = _cut(keyed, aims.select(*key, "rest"), key, "b1", "rest", "rest1").withColumnRenamed("b1", "cut1")
    inside = keyed.join(cut1.select(*key, F.col("cut1").alias("b1")), [*key, "b1"], "left_semi")
    cut2 = _cut(inside, cut1.select(*key, F.col("cut1").alias("b1"), "rest1"), [*key, "b1"], "b2", "rest1", "rest2")
    cut2 = cut2.withColumnRenamed("b2", "cut2").drop("b1")
    plan = materialise(aims.join(cut1, key, "left").join(cut2, key, "left"), "mix-plan")
    placed = keyed.join(plan, key)
    # no cut: the rest is 0, as it is always less than the source's size
    before = (F.col("rest") > 0) & ((F.col("b1") < F.col("cut1")) | ((F.col("b1") == F.col("cut1")) & (F.col("b2") < F.col("cut2"))))
    at = (F.col("b1") == F.col("cut1")) & (F.col("b2") == F.col("cut2"))
    out = ["doc_id", "source", "size", "source_size", "target"]
    base = F.col("size") * F.col("whole")
    outside = placed.where(~F.coalesce(at, F.lit(False))).select(
        *out, (base + F.when(F.coalesce(before, F.lit(False)), F.col("size")).otherwise(0)).alias("taken"))
    order = Window.partitionBy(*key).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.least(F.greatest(F.col("rest2") - F.coalesce(F.sum("size").over(order), F.lit(0)), F.lit(0)), F.col("size"))
    return outside.unionByName(placed.where(at).select(*out, (base + extra).alias("taken")))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def oracle_sql() -> str:
    """Targets from the order of caps by weight instead of rounds, and one running sum for each source."""
    return rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(concat_ws(':', '{SEED}', doc_id::VARCHAR, md5(coalesce(text, '')))) AS place
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(WEIGHTS)} + 1)::INT]::BIGINT AS weight
  FROM sizes),
filled AS (  -- those whose cap for a unit of weight is least are clamped first
  SELECT *, coalesce(sum({MAX_EPOCHS} * source_size) OVER before, 0)::BIGINT AS full_before,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS weights_left, sum(source_size) OVER ()::BIGINT AS budget,
         count(*) OVER before AS place
  FROM weighted
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, encode(coalesce(source, '')), source IS NULL ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((budget - full_before)::DOUBLE / weights_left::DOUBLE, place) AS level FROM filled
  WHERE (budget - full_before)::DOUBLE / weights_left::DOUBLE * weight <= {MAX_EPOCHS} * source_size),
aims AS (
  SELECT source, source_size, least({MAX_EPOCHS} * source_size::DOUBLE, coalesce(level, 'inf'::DOUBLE) * weight) AS target
  FROM weighted, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole,
         round(target)::BIGINT - CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END * source_size AS rest
  FROM aims)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * p.whole + least(greatest(p.rest - coalesce(sum(d.size) OVER before, 0), 0), d.size))::BIGINT AS taken, d.source
FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
WINDOW before AS (PARTITION BY d.source ORDER BY d.place, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
