"""A training-data pipeline over ``documents``: each stage takes what its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). ``run`` writes the result
of every stage to the shared checkpoint folder and reads it again for the next one.

Documents are long rows, and Spark's default Arrow batch of 10,000 of them fills tens of megabytes in the
JVM and again in each Python worker, which keep them between stages. The stages lower the session's
batch to BATCH_ROWS rows, where it is larger; results don't depend on it.

Null doc_ids and texts, empty texts, repeated rows and extra columns of any name are handled as the
stages' operators say: all stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vistaspark.llm._io import materialise, table
from vistaspark.llm.byte_bpe import digests
from vistaspark.llm.decontaminate import without_contaminated
from vistaspark.llm.ngram_join import one_of_each_group
from vistaspark.llm.quality import keep_good
from vistaspark.llm.toxicity import without_toxic


BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    small_batches(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's adaptive thresholds reject go."""
    return keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    small_batches(spark)
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    small_batches(spark)
    return digests(docs)


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard),
          ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: SQL can't express the trained stage, the components and the merges; tests/llm checks run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
