"""Token ids as one wavelet matrix per shard.

A shard file is a Parquet file with one row per matrix: for each bit of the id, from the highest,
a plane of bits with a rank directory. Ids are sorted stably by each plane's bit before the next
plane, so access, counting (rank) and occurrence lookup (select) of a token each take one step per
plane. Shards follow ascending doc_id: the documents are range-partitioned by (doc_id, text hash),
every task encodes and writes its own range, and the shards' totals give the global starts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import shared_path, shuffle_partitions, table, text_or_empty
from ._text import slices
from .word_bpe import packed_ids, text_ids, tokenizer_path, worker_words

END_ID = 2
BITS = 16  # ids below 49,408
TOKENS_PER_SHARD = 2 << 20
BYTES_PER_PARTITION = 16 << 20
BYTES_PER_PIECE = 16 << 20  # of text, encoded together
RANK_STEP = 512  # bits between two entries of a rank directory


class WaveletMatrix:
    """A sequence of ids below 2^bits as ``bits`` planes."""

    def __init__(self, n: int, bits: int, planes: np.ndarray, ranks: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.planes, self.ranks, self.zeros = n, bits, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = BITS) -> WaveletMatrix:
        """Ids must be below 2^bits. An empty sequence gives a matrix of length 0."""
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"an id needs more than {bits} bits")
        planes, ranks, zeros = [], [], []
        for level in reversed(range(bits)):
            one = (x >> level) & 1 == 1
            packed = np.packbits(one, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % (RANK_STEP // 8)))
            per_step = np.bitwise_count(packed.reshape(-1, RANK_STEP // 8)).sum(axis=1, dtype=np.uint32)
            planes.append(packed)
            ranks.append(np.r_[np.uint32(0), np.cumsum(per_step, dtype=np.uint32)])
            zeros.append(len(x) - int(one.sum()))
            x = np.concatenate([x.take(np.flatnonzero(~one)), x.take(np.flatnonzero(one))])
        return cls(len(ids), bits, np.array(planes), np.array(ranks), np.array(zeros, np.int64))

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.planes.tobytes(), self.ranks.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, n: int, bits: int, planes: bytes, ranks: bytes, zeros: list[int]) -> WaveletMatrix:
        return cls(n, bits, np.frombuffer(planes, np.uint8).reshape(bits, -1),
                   np.frombuffer(ranks, "<u4").reshape(bits, -1), np.array(zeros, np.int64))

    def _ones(self, plane: int, upto: int) -> int:
        """Set bits among the first ``upto`` bits of a plane."""
        step, rest = divmod(upto, RANK_STEP)
        total = int(self.ranks[plane][step])
        if rest:
            begin = step * (RANK_STEP // 8)
            part = np.unpackbits(self.planes[plane][begin: begin + (rest + 7) // 8], bitorder="little")
            total += int(part[:rest].sum())
        return total

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for plane in range(self.bits):
            bit = int(self.planes[plane][i >> 3] >> (i & 7)) & 1
            ones = self._ones(plane, i)
            i = int(self.zeros[plane]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _span(self, token: int, upto: int) -> tuple[int, int]:
        """Where the token's occurrences among the first ``upto`` positions stand after all planes."""
        begin, end = 0, upto
        for plane in range(self.bits):
            a, b = self._ones(plane, begin), self._ones(plane, end)
            if token >> (self.bits - 1 - plane) & 1:
                begin, end = int(self.zeros[plane]) + a, int(self.zeros[plane]) + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def rank(self, token: int, upto: int | None = None) -> int:
        """How often the token occurs among the first ``upto`` positions (default: all)."""
        begin, end = self._span(token, self.n if upto is None else upto)
        return end - begin

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) set or clear bit of a plane."""
        steps = np.arange(len(self.ranks[plane]), dtype=np.int64) * RANK_STEP
        upto = self.ranks[plane].astype(np.int64) if bit else steps - self.ranks[plane]
        step = int(np.searchsorted(upto, k, side="right")) - 1
        begin = step * (RANK_STEP // 8)
        part = np.unpackbits(self.planes[plane][begin: begin + RANK_STEP // 8], bitorder="little")
        return step * RANK_STEP + int(np.flatnonzero(part == bit)[k - int(upto[step])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the token; -1 if there is none."""
        begin, end = self._span(token, self.n)
        if not 0 <= k < end - begin:
            return -1
        at = begin + k
        for plane in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._select_bit(plane, bit, at - int(self.zeros[plane]) if bit else at)
        return at

    def to_array(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest bit up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in reversed(range(self.bits)):
            one = np.unpackbits(self.planes[plane], count=self.n, bitorder="little").view(bool) if self.n else np.zeros(0, bool)
            z = int(self.zeros[plane])
            before = np.empty_like(x)
            before[np.flatnonzero(~one)] = x[:z]
            before[np.flatnonzero(one)] = x[z:] | x.dtype.type(1 << (self.bits - 1 - plane))
            x = before
        return x


SHARD = ("part int, serial int, n long, bits int, doc_ids array<long>, counts array<int>, "
         "zeros array<long>, ranks binary, planes binary")


def _shard_type() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("serial", pa.int32()), ("n", pa.int64()), ("bits", pa.int32()),
                      ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
                      ("zeros", pa.list_(pa.int64())), ("ranks", pa.binary()), ("planes", pa.binary())])


def _write_range(path: str, end_id: int, bits: int, most: int):
    """One sorted range of (doc_id, text) -> its matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, serial = worker_words("ids", path, packed_ids, b"".join), TaskContext.get().partitionId(), 0
        kind = np.uint16 if bits <= 16 else np.uint32
        end = np.array([end_id], kind)
        doc_ids: list = []
        counts: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def matrix() -> pa.RecordBatch:
            m = WaveletMatrix.build(np.concatenate(ids), bits)
            planes, ranks = m.to_bytes()
            row = [part, serial, m.n, bits, doc_ids, counts, m.zeros.tolist(), ranks, planes]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _shard_type(), strict=True)], schema=_shard_type())

        for batch in batches:
            for piece in slices(batch, "text", BYTES_PER_PIECE):
                for doc_id, own in zip(piece.column("doc_id").to_pylist(), text_ids(words, piece.column("text")), strict=True):
                    doc_ids.append(doc_id)
                    counts.append(len(own) + 1)
                    ids += [own.astype(kind), end]
                    held += len(own) + 1
                    if held >= most:
                        yield matrix()
                        doc_ids, counts, ids, held, serial = [], [], [], 0, serial + 1
        if doc_ids:
            yield matrix()

    return run


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, bits: int = BITS,
                 tokens_per_shard: int = TOKENS_PER_SHARD) -> None:
    """Encodes ``docs`` (doc_id, text, ...) and writes the shard files to ``folder``.

    Ascending doc_id, nulls first; rows with one doc_id follow each other by the hash of their
    text. Null and empty texts hold the end id alone. An empty table writes no matrix. Other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(shuffle_partitions(docs.sparkSession), total // BYTES_PER_PARTITION)
    (rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
     .select("doc_id", "text").mapInArrow(_write_range(path or tokenizer_path(), end_id, bits, tokens_per_shard), SHARD)
     .write.option("compression", "zstd").option("parquet.block.size", 256 << 20).parquet(folder))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shard files' matrices with ``start``: the number of ids in all shards before."""
    shards = spark.read.schema(SHARD).parquet(folder)
    before = Window.orderBy("part", "serial").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "serial", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return shards.join(starts, ["part", "serial"])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(names)}
            m = WaveletMatrix.from_bytes(row["n"].as_py(), row["bits"].as_py(), row["planes"].as_py(),
                                         row["ranks"].as_py(), row["zeros"].as_py())
            ids = m.to_array().astype("<u4")
            counts = np.asarray(row["counts"].values, np.int64)
            bounds = np.r_[0, np.cumsum(counts)]
            yield pa.record_batch({
                "doc_id": row["doc_ids"].values, "start": pa.array(row["start"].as_py() + bounds[:-1]),
                "n_tokens": pa.array(counts),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())})


def document_digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the matrices."""
    return shards.mapInArrow(_read_back, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "wavelet")
    write_shards(table(spark, sf_dir, "documents"), folder)
    return document_digests(read_shards(spark, folder))
