"""Token counts with a whole-token shortcut.

Offline (once, on the driver) every vocabulary string with a word end is merged by the model; those
that come out as one token are proven: a word that equals one of them counts 1 without merging.
The proven list has at most the vocabulary's size and is broadcast. Only other words are merged.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table, text_or_empty
from ._text import slices
from .word_bpe import byte_letters, load, tokenizer_path, worker_words

TOKEN_LIMIT = 2048


def proven_words(path: str) -> list[str]:
    """The words that the model encodes as one token, by merging each candidate."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    merge, byte_of = load(path).model.tokenize, {c: b for b, c in enumerate(byte_letters())}
    out = []
    for token in vocabulary:
        letters = token.removesuffix("</w>")
        if letters == token or not all(c in byte_of for c in letters):
            continue
        merged = merge(letters)
        if len(merged) == 1 and merged[0].value == token:
            try:
                out.append(bytes(byte_of[c] for c in letters).decode())
            except UnicodeDecodeError:  # part of a character: never a whole word
                continue
    return out


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, n_bytes, n_tokens, n_shortcut, over_limit), one row
    for each row; ``n_shortcut`` counts the tokens that needed no merging (proven words and special
    strings).

    Null and empty texts have no bytes and no tokens; null or repeated doc_ids come out as they
    are; an empty table gives no rows; other columns are ignored. Special strings in texts count as
    one token each, the library's default.
    """
    path = path or tokenizer_path()
    proven = docs.sparkSession.sparkContext.broadcast(proven_words(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a proven or special word is worth 1 + 2^32, a merged one its number of tokens
        words = worker_words("count", path, len, sum, lambda: dict.fromkeys(proven.value, 1 + (1 << 32)))
        words.special = dict.fromkeys(words.special, 1 + (1 << 32))
        for batch in batches:
            for part in slices(batch, "text"):
                totals = [sum(words.values(t)) for t in part.column(1).to_pylist()]
                yield pa.record_batch({"doc_id": part.column(0), "n_bytes": part.column(2),
                                       "n_tokens": pa.array([t & 0xFFFFFFFF for t in totals], pa.int64()),
                                       "n_shortcut": pa.array([t >> 32 for t in totals], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
                       F.octet_length(text_or_empty()).cast("long").alias("n_bytes"))
    return (rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_shortcut long")
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
