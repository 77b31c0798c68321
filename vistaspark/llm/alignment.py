"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A task tokenizes its texts with both tokenizers and lays all tokens of a batch on one line of byte
offsets. ``pandas.merge_asof`` keyed by document finds, for each token start, the other side's
token that covers it; the union of both directions is every pair whose byte ranges overlap, and
offsets where both sides end cut a text into groups.

How often an id pair is linked in the whole corpus is counted like the distinct words of
``byte_bpe``: each chunk of texts numbers its distinct pairs and counts them, the lists are shuffled
by the id of the second side, summed there (all pairs of an id meet, so its highest count is
known), and go back to their chunks, where the texts' links are looked up by number. A pair that
fills the corpus is sent once for each chunk, and what is held at a time is a chunk and the
distinct pairs of one partition.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import shuffle_partitions, table, text_or_empty
from ._text import slices
from .byte_bpe import _numbers, _pack, _planes, _unpack

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 6 << 20
SEGMENT_BYTES = 1 << 20
BUCKETS_PER_PARTITION = 4
HELD_BYTES = 32 << 20
SHIFT = 24  # a pair is one number: first id, SHIFT bits of second id


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- the two sides: texts -> ids, and the bytes of each id -----------------------------------


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable bytes of Latin-1 stand
    for themselves, the others, in order, for the code points from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def side_a(path: str):
    """(texts -> lists of ids, list of each id's bytes) of a byte-level BPE file.

    The file's merges are in the order of the ids they make, so the ids are ranks and the ids of a
    text are those of the ranked merges of its split; that is asserted here. Special tokens have no
    rank: their strings are plain text."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letter, vocab = _byte_letters(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    assert made == sorted(set(made)) and all(max(vocab[a], vocab[b]) < i for (a, b), i in zip(merges, made, strict=True))
    spelled = {*map("".join, merges), *letter}
    ranks = {bytes(map(letter.__getitem__, token)): i for token, i in vocab.items() if token in spelled}
    encode = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    of = {i: b for b, i in ranks.items()}
    return (lambda texts: [encode(" " + t) for t in texts]), [of.get(i, b"") for i in range(max(of) + 1)]


@lru_cache(2)
def side_b(path: str):
    """As ``side_a`` for a sentencepiece model, which puts the space before a text itself."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) or p.is_unknown(i)
              else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]
    return (lambda texts: p.encode(texts, num_threads=1)), pieces


@lru_cache(4)
def _spelled(n: int, marks: tuple[bytes, bytes]) -> np.ndarray:
    """For each id its decimal digits after the first mark, then each after the second."""
    out = np.empty(2 * n, object)
    out[:] = [marks[0] + b"%d" % i for i in range(n)] + [marks[1] + b"%d" % i for i in range(n)]
    return out


# --- one batch ----------------------------------------------------------------------------------


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, the document of each)."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for one in ids for i in one), np.int64, int(counts.sum()))
    return flat, np.repeat(np.arange(len(ids)), counts)


def covering(at: np.ndarray, doc: np.ndarray, starts: np.ndarray, starts_doc: np.ndarray) -> np.ndarray:
    """For each offset ``at`` of a document, the index of the token of the other side that covers it."""
    found = pd.merge_asof(pd.DataFrame({"start": at, "doc": doc}),
                          pd.DataFrame({"start": starts, "doc": starts_doc, "token": np.arange(len(starts))}), on="start", by="doc")
    return found["token"].to_numpy(np.int64)


def align(texts: list[str], path_a: str, path_b: str) -> dict[str, np.ndarray | list]:
    """Tokens, links and groups of some texts.

    n_a, n_b, n_groups, n_links: one number for each text. groups: its groups, spelled
    ``a1,a2|b1;a3|b2,b3``, as bytes (empty without tokens). pairs: of each link, text by text, the
    two ids as one number. links_a, links_b: the same links as token numbers within the batch. A
    text that is empty, or whose joined token bytes of a side aren't a space and the text, has no
    tokens."""
    (encode_a, bytes_a), (encode_b, bytes_b) = side_a(path_a), side_b(path_b)
    n = len(texts)
    ids_a, ids_b = encode_a(texts), encode_b(texts)
    for k, text in enumerate(texts):
        whole = b" " + text.encode()
        if not text or b"".join(map(bytes_a.__getitem__, ids_a[k])) != whole or b"".join(map(bytes_b.__getitem__, ids_b[k])) != whole:
            ids_a[k] = ids_b[k] = ()
    (a, doc_a), (b, doc_b) = _flat(ids_a), _flat(ids_b)
    length_a = np.fromiter(map(len, bytes_a), np.int64, len(bytes_a))[a]
    length_b = np.fromiter(map(len, bytes_b), np.int64, len(bytes_b))[b]
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)  # texts have equal lengths on both sides
    start_a, start_b = end_a - length_a, end_b - length_b
    over_b = covering(start_a, doc_a, start_b, doc_b)  # B's token over each start of A
    over_a = covering(start_b, doc_b, start_a, doc_a)
    other = start_a[over_a] != start_b  # equal starts are found from both sides
    links_a = np.r_[np.arange(len(a)), over_a[other]]
    links_b = np.r_[over_b, np.flatnonzero(other)]
    order = np.argsort(doc_a[links_a], kind="stable")
    links_a, links_b = links_a[order], links_b[order]
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    # spelled tokens in the order group by group, A before B: a token comes after its own side's
    # earlier tokens and the other side's tokens of earlier groups (B's: of its own group too)
    pieces = np.empty(len(a) + len(b), object)
    first_a, first_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
    pieces[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = _spelled(len(bytes_a), (b",", b";"))[a + len(bytes_a) * first_a]
    pieces[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = _spelled(len(bytes_b), (b",", b"|"))[b + len(bytes_b) * first_b]
    n_a, n_b = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)
    bounds = np.r_[0, np.cumsum(n_a + n_b)].tolist()
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_a[first_a], minlength=n),
            "n_links": np.bincount(doc_a[links_a], minlength=n),
            "groups": [b"".join(pieces[lo:hi].tolist())[1:] for lo, hi in zip(bounds, bounds[1:], strict=False)],
            "pairs": a[links_a] << SHIFT | b[links_b], "links_a": links_a, "links_b": links_b}


# --- corpus-wide counts -------------------------------------------------------------------------

#: A row is a segment of texts (key: its chunk) or a list of pairs (key: -1 - its bucket).
CUT = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())),
                 ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())),
                 ("groups", pa.list_(pa.string())), ("links", pa.binary()), ("n_pairs", pa.int32()), ("pairs", pa.binary()),
                 ("counts", pa.binary()), ("at", pa.binary())])
CUT_SQL = ("key long, chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
           "groups array<string>, links binary, n_pairs int, pairs binary, counts binary, at binary")


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def _pair_planes(pairs: np.ndarray) -> list[np.ndarray]:
    """Sorted pairs as the planes of first and second ids."""
    return [_planes(pairs >> SHIFT), _planes(pairs & ((1 << SHIFT) - 1))]


def _pairs(raw: bytes) -> np.ndarray:
    half = len(raw) // 2
    return _numbers(raw[:half]).astype(np.int64) << SHIFT | _numbers(raw[half:])


def _cut(path_a: str, path_b: str, buckets: int):
    """(doc_id, text) -> rows of CUT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, held = TaskContext.get().partitionId(), 0, 0
        segments: list[tuple[list, dict]] = []

        def chunk() -> Iterator[pa.RecordBatch]:
            key = part << 32 | serial
            sizes = [len(s["pairs"]) for _, s in segments]
            distinct, number, counts = np.unique(np.concatenate([s["pairs"] for _, s in segments]), return_inverse=True, return_counts=True)
            for (doc_ids, s), end, size in zip(segments, np.cumsum(sizes).tolist(), sizes, strict=True):
                yield _rows(CUT, key=[key], chunk=[key], doc_ids=[doc_ids], n_a=[s["n_a"]], n_b=[s["n_b"]], n_groups=[s["n_groups"]],
                            n_links=[s["n_links"]], groups=[s["groups"]], links=[_pack([_planes(number[end - size:end])])])
            bucket = (distinct & ((1 << SHIFT) - 1)) % buckets
            order = np.argsort(bucket, kind="stable")
            here, begins = np.unique(bucket[order], return_index=True)
            lists = np.split(order, begins[1:]) if len(here) else []
            if lists:
                yield _rows(CUT, key=-1 - here, chunk=[key] * len(lists), n_pairs=list(map(len, lists)),
                            pairs=[_pack(_pair_planes(distinct[x])) for x in lists], counts=[_pack([_planes(counts[x])]) for x in lists],
                            at=[_pack([_planes(x)]) for x in lists])

        for batch in batches:
            for piece in slices(batch, "text", SEGMENT_BYTES):
                one = align(piece.column(1).to_pylist(), path_a, path_b)
                one["groups"] = [hashlib.sha256(g).hexdigest() if g else "" for g in one["groups"]]
                segments.append((piece.column(0).to_pylist(), {k: v for k, v in one.items() if not k.startswith("links_")}))
                held += piece.nbytes
                if held >= CHUNK_BYTES:
                    yield from chunk()
                    segments, serial, held = [], serial + 1, 0
        if segments:
            yield from chunk()

    return run


COUNTED = pa.schema([("chunk", pa.int64()), ("at", pa.binary()), ("n_pairs", pa.int32()), ("totals", pa.binary()), ("best", pa.binary())])


def _wide(x: np.ndarray) -> list[np.ndarray]:
    """Counts of more than 32 bits: planes of the low and the high half."""
    return [_planes(x & 0xFFFFFFFF), _planes(x >> 32)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CUT, dealt by key -> for each list its pairs' counts in all lists, and whether a
    count is its second id's highest. Lists wait in memory up to HELD_BYTES, then in a temporary
    file of this task, until the partition is summed."""
    pairs, totals = np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def merge() -> None:
        nonlocal pairs, totals, waiting
        every = np.concatenate([pairs, *(p for p, _ in fresh)])
        counts = np.concatenate([totals, *(c for _, c in fresh)])
        pairs, at = np.unique(every, return_inverse=True)
        totals = np.zeros(len(pairs), np.int64)
        np.add.at(totals, at, counts)
        fresh.clear()
        waiting = 0

    with tempfile.SpooledTemporaryFile(max_size=HELD_BYTES) as held:
        sizes = []
        for batch in batches:
            for row in batch.select(["chunk", "at", "n_pairs", "pairs", "counts"]).filter(batch.column("pairs").is_valid()).to_pylist():
                n = row["n_pairs"]
                p = _pairs(_unpack(row["pairs"], 8 * n))
                fresh.append((p, _numbers(_unpack(row["counts"], 4 * n)).astype(np.int64)))
                waiting += n
                if waiting > 1 << 20 and waiting > len(pairs):
                    merge()
                held.write(row["pairs"])
                held.write(row["at"])
                sizes.append((row["chunk"], n, len(row["pairs"]), len(row["at"])))
        merge()
        second = pairs & ((1 << SHIFT) - 1)
        order = np.argsort(second, kind="stable")
        ids, begins = np.unique(second[order], return_index=True)
        highest = np.maximum.reduceat(totals[order], begins) if len(ids) else totals
        best = totals == highest[np.searchsorted(ids, second)]
        held.seek(0)
        for key, n, size, at_size in sizes:
            found = np.searchsorted(pairs, _pairs(_unpack(held.read(size), 8 * n)))
            yield _rows(COUNTED, chunk=[key], at=[held.read(at_size)], n_pairs=[n], totals=[_pack(_wide(totals[found]))],
                        best=[_pack([best[found].astype(np.uint8)])])


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
ALIGNED = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string"


def _look_up(texts: pa.Table, counted: pa.Table) -> pa.Table:
    """One chunk's segments and its pairs' counts -> rows of ALIGNED."""
    n = sum(counted.column("n_pairs").to_pylist())
    totals, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for row in counted.to_pylist():
        k = row["n_pairs"]
        at, raw = _numbers(_unpack(row["at"], 4 * k)), _unpack(row["totals"], 8 * k)
        totals[at] = _numbers(raw[:4 * k]).astype(np.int64) | _numbers(raw[4 * k:]).astype(np.int64) << 32
        best[at] = np.frombuffer(_unpack(row["best"], k), np.uint8)
    out: dict[str, list] = {c: [] for c in ["doc_id", *COUNTS, "groups_sha256"]}
    for row in texts.to_pylist():
        if row["doc_ids"] is None:  # a list of pairs
            continue
        ends = np.cumsum(row["n_links"])
        links = _numbers(_unpack(row["links"], 4 * int(ends[-1])))
        for name, value in (("n_best", best), ("count_sum", totals)):
            upto = np.r_[0, np.cumsum(value[links])]
            out[name].extend((upto[ends] - upto[ends - row["n_links"]]).tolist())
        for name, value in (("doc_id", "doc_ids"), ("groups_sha256", "groups"), *((c, c) for c in COUNTS[:4])):
            out[name].extend(row[value])
    return pa.table({c: pa.array(v, pa.string() if c == "groups_sha256" else pa.int64()) for c, v in out.items()})


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> ALIGNED, one row for each row: tokens of both sides, groups,
    links, links whose id pair is the most frequent one of its second id, the sum over links of
    their pair's count, and the digest of the groups.

    Null and empty texts, and texts that a side does not give back byte for byte, have no tokens:
    zeros and ''. Null or repeated doc_ids come out as they are, repeated rows count repeatedly;
    other columns are ignored; an empty table gives no rows.
    """
    path_a, path_b = path_a or _path(SIDE_A), path_b or _path(SIDE_B)
    n = shuffle_partitions(docs.sparkSession)
    # one shuffle deals segments by chunk and lists by bucket; both readers use it whole
    cut = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
           .mapInArrow(_cut(path_a, path_b, n * BUCKETS_PER_PARTITION), CUT_SQL).repartition(n, "key"))
    counted = cut.mapInArrow(_count, "chunk long, at binary, n_pairs int, totals binary, best binary").repartition(n, "chunk")
    return cut.groupBy("key").cogroup(counted.groupBy("chunk")).applyInArrow(_look_up, ALIGNED)


def links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, a int, b int, a_id int, b_id int): every pair of
    token positions (from 0, by document) whose byte ranges overlap, with the tokens' ids. Cases as
    in ``alignments``; a text without tokens gives no row."""
    path_a, path_b = path_a or _path(SIDE_A), path_b or _path(SIDE_B)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SEGMENT_BYTES):
                one = align(piece.column(1).to_pylist(), path_a, path_b)
                doc = np.repeat(np.arange(piece.num_rows), one["n_links"])
                first_a, first_b = (np.r_[0, np.cumsum(one[c])][doc] for c in ("n_a", "n_b"))
                yield pa.record_batch({"doc_id": piece.column(0).take(pa.array(doc)), **{
                    name: pa.array(value.astype(np.int32)) for name, value in (
                        ("a", one["links_a"] - first_a), ("b", one["links_b"] - first_b),
                        ("a_id", one["pairs"] >> SHIFT), ("b_id", one["pairs"] & ((1 << SHIFT) - 1)))}})

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .mapInArrow(run, "doc_id long, a int, b int, a_id int, b_id int"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
