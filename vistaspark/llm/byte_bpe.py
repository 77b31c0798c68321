"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Encoding: every task cuts its texts into pre-tokens and gives each pre-token of a chunk of texts
its number in the chunk's own word list (the chunk is the unit that pre-aggregates before the
shuffle, so a word that fills a third of a corpus is sent once for each chunk). The word lists are
shuffled by word; each distinct word is merged once; its ids go back to the chunks that hold it,
where the texts are reassembled by position. Decoding joins the ids with the token-byte table
(its size is the vocabulary's, a bound that does not depend on the data).
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import releasing, shuffle_partitions, table, text_or_empty
from ._text import slices

CHUNK_BYTES = 8 << 20
SEGMENT_BYTES = 1 << 20
BUCKETS_PER_PARTITION = 4
RANKS = "byte_bpe_multi_50k.tiktoken"


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The public split pattern; white space is Unicode's White_Space, as in the tiktoken library."""
    import public_tokenizers

    return public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(
        r"\s", r"\p{White_Space}")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def _merger(path: str):
    """bytes of one pre-token -> its ids. Built for each task: workers don't keep its tables between stages."""
    import tiktoken

    whole = tiktoken.Encoding(path, pat_str=r"(?s).+", mergeable_ranks=load_ranks(path), special_tokens={})
    return whole.encode_ordinary


def _pack(parts: list[np.ndarray | bytes]) -> bytes:
    return pa.compress(b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts), codec="zstd", asbytes=True)


def _unpack(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> np.ndarray:
    """Low, middle and high byte of small numbers one after another: they compress apart."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


#: A row is a segment of texts (key: its chunk) or a word list (key: -1 - its bucket).
CUT = ("key long, chunk long, doc_ids array<long>, counts array<int>, positions binary, "
       "n_words int, words_size int, words binary, at binary")


def _cut(pattern: str, buckets: int):
    """(doc_id, text) -> rows of CUT: segments of texts as word numbers, and word lists by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        part, serial, held = TaskContext.get().partitionId(), 0, 0
        numbers: dict[str, int] = {}

        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.record_batch([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

        schema = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
                            ("positions", pa.binary()), ("n_words", pa.int32()),
                            ("words_size", pa.int32()), ("words", pa.binary()), ("at", pa.binary())])

        def word_lists() -> pa.RecordBatch:
            lists: dict[int, list[str]] = {}
            for word in numbers:
                lists.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
            chunk = part << 32 | serial
            packed = []
            for words in lists.values():
                raw = [w.encode() for w in words]
                sizes = np.fromiter(map(len, raw), "<u4", len(raw))
                packed.append((len(raw), 4 * len(raw) + int(sizes.sum()), _pack([sizes, *raw]),
                               _pack([_planes(np.fromiter(map(numbers.__getitem__, words), "<u4", len(words)))])))
            n, size, words, at = zip(*packed, strict=True)
            return rows(key=[-1 - b for b in lists], chunk=[chunk] * len(lists), n_words=n, words_size=size, words=words, at=at)

        for batch in batches:
            for piece in slices(batch, "text", SEGMENT_BYTES):
                found, counts = [], []
                for text in piece.column(1).to_pylist():
                    words = find(text)
                    counts.append(len(words))
                    for w in words:
                        found.append(numbers.setdefault(w, len(numbers)))
                yield rows(key=[part << 32 | serial], chunk=[part << 32 | serial], doc_ids=[piece.column(0).to_pylist()], counts=[counts],
                           positions=[_pack([_planes(np.array(found, "<u4"))])])
                held += piece.nbytes
                if held >= CHUNK_BYTES:
                    if numbers:
                        yield word_lists()
                    numbers, serial, held = {}, serial + 1, 0
        if numbers:
            yield word_lists()

    return run


MERGED = "chunk long, at binary, n_words int, sizes binary, n_ids int, ids binary"


def _merge(path: str):
    """Rows of CUT, dealt by key -> the ids of the word lists' words, list by list. All lists that
    can hold a word are in one partition, where it is merged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = _merger(path), {}
        for batch in batches:
            lists = batch.select(["chunk", "n_words", "words_size", "words", "at"]).filter(batch.column("words").is_valid())
            for row in lists.to_pylist():
                n, raw = row["n_words"], _unpack(row["words"], row["words_size"])
                ends = np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64) + 4 * n
                begin, merged = 4 * n, []
                for end in ends.tolist():
                    word = raw[begin:end]
                    begin = end
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                    merged.append(ids)
                sizes = np.fromiter(map(len, merged), "<u4", n) // 4
                joined = np.frombuffer(b"".join(merged), "<u4")
                yield pa.record_batch({
                    "chunk": pa.array([row["chunk"]], pa.int64()), "at": pa.array([row["at"]], pa.binary()),
                    "n_words": pa.array([n], pa.int32()), "sizes": pa.array([_pack([_planes(sizes)])], pa.binary()),
                    "n_ids": pa.array([len(joined)], pa.int32()), "ids": pa.array([_pack([_planes(joined)])], pa.binary())})

    return run


def _reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
    """One chunk's segments and its words' ids -> (doc_id, ids)."""
    places, sizes, ids = [], [], []
    for row in words.to_pylist():
        n = row["n_words"]
        places.append(_numbers(_unpack(row["at"], 4 * n)))
        sizes.append(_numbers(_unpack(row["sizes"], 4 * n)))
        ids.append(_numbers(_unpack(row["ids"], 4 * row["n_ids"])))
    none = np.zeros(0, "<u4")
    place, size, flat = (np.concatenate([none, *x]) for x in (places, sizes, ids))
    first, length = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    first[place] = np.cumsum(np.r_[0, size[:-1]]) if len(size) else 0
    length[place] = size
    doc_ids, arrays = [], []
    for row in texts.select(["doc_ids", "counts", "positions"]).to_pylist():
        if row["doc_ids"] is None:  # a word list
            continue
        counts = np.array(row["counts"], np.int64)
        at = _numbers(_unpack(row["positions"], 4 * int(counts.sum())))
        lengths = length[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        tokens = flat[np.repeat(first[at] - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]].astype(np.int32)
        doc_ids.append(pa.array(row["doc_ids"], pa.int64()))
        arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(tokens.astype(np.int32))))
    return pa.table({"doc_id": pa.chunked_array(doc_ids, pa.int64()),
                     "ids": pa.chunked_array(arrays, pa.list_(pa.int32()))})


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, ids array<int>), one row for each row.

    Each match of ``pattern`` is merged by the ranks file at ``path``; no special tokens, so their
    strings are ordinary text. Null and empty texts give an empty array; null or repeated doc_ids
    come out as they are; an empty table gives no rows; other columns are ignored.
    """
    path, pattern = path or ranks_path(), pattern or split_pattern()
    n = shuffle_partitions(docs.sparkSession)
    # one shuffle deals segments by chunk and word lists by bucket; both readers use it whole, so
    # that Spark plans it once
    cut = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
           .mapInArrow(releasing(_cut(pattern, n * BUCKETS_PER_PARTITION)), CUT).repartition(n, "key"))
    merged = cut.mapInArrow(releasing(_merge(path)), MERGED).repartition(n, "chunk")
    return cut.groupBy("key").cogroup(merged.groupBy("chunk")).applyInArrow(_reassemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with an ``ids array<int>`` column -> the same columns and ``decoded`` (binary):
    the bytes of its tokens one after another. Null ids give null; an unknown id fails; a column ``decoded``
    that was there is replaced."""
    encoded = encoded.drop("decoded")
    tokens = {i: b for b, i in load_ranks(path or ranks_path()).items()}
    shared = encoded.sparkSession.sparkContext.broadcast([tokens.get(i) for i in range(max(tokens) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.__getitem__
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for begin in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(begin, 256)
                out = [None if ids is None else b"".join(map(of, ids)) for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())],
                                                 names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(releasing(run), f"{schema}, decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    """Encodes, decodes and digests: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return decode(encode(docs)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
