"""Exact n-gram Jaccard self-join by PartEnum signatures.

Two texts link when their sets of distinct word shingles have a Jaccard similarity of at least
``percent``/100. That bounds the symmetric difference of sets of sizes a and b by
``(a + b) * (100 - percent) / (100 + percent)``. PartEnum cuts the feature domain (the 64-bit
shingle hashes) into 2^j parts, where j follows from the size band, and a signature is one part's
whole content. Of 2^j parts two similar sets differ in at most k, so at least 2^j - k are equal in
both; each set therefore only has to emit its k + 1 fullest parts (ties by part number): the
fullest equal part has at least 2^j - k - 1 equal parts below it, so neither set can leave it out.
The fullest parts are also the most selective ones, and empty parts are hardly ever among them.
A set whose largest possible partner falls into the next band also signs in that band.

Signatures sharing one value give candidate groups. A group is first tested as a star around its
smallest member; what the verified links then join needs no further test, and only pairs of
members still in different components are tested afterwards, so a large group of near copies
costs its size and not its square. Candidates pass a lossless bound (parity sketches: the number
of differing bits never exceeds the symmetric difference) before the exact sets are compared.

Texts that are equal byte for byte are one node (64-bit hash of the text) from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import free_names, materialise, releasing, shuffle_partitions, table, text_or_empty
from ._text import mix, row_sets, slices
from .components import connected_components

SHINGLE, PERCENT = 5, 75
LEAST_SKETCH_BITS = 512  # and at least four bits an element
SIGNATURE_BYTES = 5  # kept of a signature beside its bucket
BUCKETS_PER_PARTITION = 4
FIRST_GROUPS = 6
PIECE_BYTES = 1 << 20  # of text hashed at once
HELD_SIGNATURES = 1_000_000  # of a task, before it sends them
FILTER_BITS = 1 << 27  # most bits of a broadcast Bloom filter


def difference_bound(a, b, percent: int):
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (100 - percent) // (100 + percent)


def band(size: int) -> int:
    """log2 of the number of parts for sets of this size: about 1 to 2 elements a part (half of
    that for small sets, so that enough parts hold something)."""
    bits = max(size - 1, 1).bit_length()
    return max(3, bits - (1 if size > 64 else 0))


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of a sorted set of 64-bit hashes."""
    size = len(elements)
    most = size * 100 // percent
    keep = difference_bound(size, most, percent) + 1
    spread = mix(elements)
    out = []
    for j in sorted({band(size), band(most)}):
        parts = 1 << j
        bounds = np.searchsorted(elements, np.arange(parts, dtype=np.uint64) << np.uint64(64 - j))
        counts = np.diff(np.r_[bounds, size])
        chosen = np.argsort(-counts, kind="stable")[:keep]
        sums = np.r_[np.uint64(0), np.cumsum(spread, dtype=np.uint64)]
        content = sums[bounds[chosen] + counts[chosen]] - sums[bounds[chosen]]
        out.append(mix(content + mix(chosen.astype(np.uint64) + np.uint64(j << 48))))
    return np.concatenate(out)


def sketch(elements: np.ndarray) -> bytes:
    """Parity of the number of elements in each cell (low hash bits); the cells are a power of two
    that grows with the set, so that unrelated large sets differ in many of them too."""
    bits = max(LEAST_SKETCH_BITS, 1 << (4 * len(elements) - 1).bit_length())
    cells = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(bool), bitorder="little").tobytes()


class Sketches:
    """Sketches as one matrix for each length, compared pair by pair; the longer one of a pair is
    folded (the parity of a coarser cell is the exclusive or of its halves)."""

    def __init__(self, sketches: list[bytes]):
        lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
        self.length, self.row = lengths, np.zeros(len(lengths), np.int64)
        self.matrix: dict[tuple[int, int], np.ndarray] = {}
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            self.row[at] = np.arange(len(at))
            self.matrix[n, n] = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64).reshape(len(at), -1)

    def folded(self, length: int, to: int) -> np.ndarray:
        if (length, to) not in self.matrix:
            x = self.folded(length, 2 * to)
            self.matrix[length, to] = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
        return self.matrix[length, to]

    def differing(self, at: np.ndarray, other: Sketches, to: np.ndarray) -> np.ndarray:
        """Number of differing cells of self[at] and other[to], pair by pair."""
        out = np.zeros(len(at), np.int64)
        pairs = self.length[at] << 32 | other.length[to]
        for code in np.unique(pairs).tolist():
            la, lb = code >> 32, code & 0xFFFFFFFF
            n = min(la, lb)
            x, y = self.folded(la, n), other.folded(lb, n)
            rows = np.flatnonzero(pairs == code)
            most = max(1, (4 << 20) // n)
            for k in range(0, len(rows), most):
                r = rows[k: k + most]
                out[r] = np.bitwise_count(x[self.row[at[r]]] ^ y[other.row[to[r]]]).sum(axis=1, dtype=np.int64)
        return out


def _seed_free_hash(values: np.ndarray) -> np.ndarray:
    return mix(values + np.uint64(0x5851F42D4C957F2D))


# --- passes over the texts -------------------------------------------------------------------

def _profile(size: int):
    """(doc_id, node, text) -> (doc_id, node, n, sketch); sketch only where n > 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                sets = row_sets(part, "text", size)
                yield pa.record_batch({
                    "doc_id": part.column(0), "node": part.column(1),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "sketch": pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())})

    return run


def _sign(size: int, percent: int, buckets: int):
    """(node, text) -> (bucket, sigs, nodes): one row for each bucket and piece of input, with the
    signatures (SIGNATURE_BYTES beyond the bucket number) and their nodes side by side. Texts seen
    before in the task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held_s: list[np.ndarray] = []
        held_n: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            sig, node = np.concatenate(held_s), np.concatenate(held_n)
            target = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            sig, node, target = sig[order], node[order], target[order]
            bounds = np.searchsorted(target, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(bounds))
            short = (sig // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIGNATURE_BYTES]
            return pa.record_batch({
                "bucket": pa.array(used.astype(np.int32)),
                "sigs": pa.array([short[bounds[b]: bounds[b + 1]].tobytes() for b in used], pa.binary()),
                "nodes": pa.array([node[bounds[b]: bounds[b + 1]].tobytes() for b in used], pa.binary())})

        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                nodes = part.column(0).to_pylist()
                for node, elements in zip(nodes, row_sets(part, "text", size), strict=True):
                    if not len(elements) or node in seen:
                        continue
                    seen.add(node)
                    sig = signatures(elements, percent)
                    held_s.append(sig)
                    held_n.append(np.full(len(sig), node, np.int64))
                    count += len(sig)
                if count >= HELD_SIGNATURES:
                    yield flush()
                    held_s, held_n, count = [], [], 0
        if held_s:
            yield flush()

    return run


def _groups_of_bucket(table_: pa.Table) -> pa.Table:
    """One bucket's signatures -> its distinct groups of two or more nodes: (gid, pivot, node)."""
    short = np.frombuffer(b"".join(table_.column("sigs").to_pylist()), np.uint8).reshape(-1, SIGNATURE_BYTES)
    sig = np.pad(short, ((0, 0), (0, 8 - SIGNATURE_BYTES))).view("<u8").ravel()
    node = np.concatenate([np.frombuffer(x, np.int64) for x in table_.column("nodes").to_pylist()])
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
    sig, node = sig[fresh], node[fresh]
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    counts = np.diff(np.r_[starts, len(sig)])
    several = counts > 1
    if several.any():
        gid = np.add.reduceat(_seed_free_hash(node.view(np.uint64)), starts).view(np.int64)
        _, first = np.unique(gid[several], return_index=True)
        starts, counts, gid = starts[several][first], counts[several][first], gid[several][first]
        rows = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        node, gid, pivot = node[rows], np.repeat(gid, counts), np.repeat(node[starts], counts)
    else:
        node = gid = pivot = np.zeros(0, np.int64)
    return pa.table({"gid": gid, "pivot": pivot, "node": node})


def _filter_cells(nodes: np.ndarray, bits: int) -> np.ndarray:
    """Three cells of a Bloom filter for each node."""
    x = nodes.view(np.uint64)
    return np.stack([mix(x + np.uint64(k)) & np.uint64(bits - 1) for k in (1, 2, 3)], axis=1).astype(np.int64)


def _bloom(nodes: DataFrame) -> np.ndarray | None:
    """Bloom filter of the nodes (16 bits each), or None when it would exceed FILTER_BITS. Its words
    are combined on the executors; only the filter itself comes to the driver."""
    bits = max(1 << 10, 1 << (16 * nodes.count()).bit_length())
    if bits > FILTER_BITS:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            cells = _filter_cells(np.asarray(batch.column(0)), bits).ravel()
            np.bitwise_or.at(words, cells >> 6, np.uint64(1) << (cells & 63).astype(np.uint64))
        words = words.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.record_batch({"i": pa.array(at), "word": pa.array(words[at])})

    out = np.zeros(bits // 64, np.int64)
    for r in nodes.mapInArrow(releasing(run), "i long, word long").groupBy("i").agg(F.bit_or("word").alias("word")).toLocalIterator():
        out[r["i"]] = r["word"]
    return out


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """One (node, text) for each of ``nodes``. Copies of a text that one task holds are sent once;
    a Bloom filter of the nodes, when small enough, keeps other texts out of the shuffle."""
    bloom = _bloom(nodes)
    shared = texts.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes = np.asarray(batch.column(0))
            keep = np.ones(len(nodes), bool)
            if shared.value is not None:
                cells = _filter_cells(nodes, 64 * len(shared.value))
                keep = ((shared.value[cells >> 6] >> (cells & 63)) & 1).all(axis=1)
            keep = [bool(k) and not (x in seen or seen.add(x)) for k, x in zip(keep, nodes.tolist(), strict=True)]
            if any(keep):
                yield batch.filter(pa.array(keep))

    return texts.mapInArrow(releasing(run), "node long, text string").join(nodes, "node", "left_semi").dropDuplicates(["node"])


# --- candidates and links --------------------------------------------------------------------

def _possible(na, nb, differing, percent: int):
    return (np.maximum(na, nb) * percent <= np.minimum(na, nb) * 100) & (differing <= difference_bound(na, nb, percent))


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            rows = np.arange(batch.num_rows)
            differing = Sketches(col["sketch_a"].to_pylist()).differing(rows, Sketches(col["sketch_b"].to_pylist()), rows)
            keep = _possible(np.asarray(col["n_a"]), np.asarray(col["n_b"]), differing, percent)
            yield pa.record_batch({"u": col["u"], "v": col["v"]}).filter(pa.array(keep))

    return run


def _across(percent: int):
    """One mixed group -> pairs of members with different labels that pass the sketch bound. The
    largest component's members are only compared with the others. ``first`` holds a member's
    least groups: a pair that has one of them in common, before this group, is left to that one."""

    def run(table_: pa.Table) -> pa.Table:
        node, label, n = (np.asarray(table_[name]) for name in ("node", "label", "n"))
        values, inverse, counts = np.unique(label, return_inverse=True, return_counts=True)
        order = np.argsort(inverse == np.argmax(counts), kind="stable")  # the largest one last
        node, label, n = node[order], label[order], n[order]
        sketches = Sketches(table_["sketch"].combine_chunks().take(pa.array(order)).to_pylist())
        gid = table_["gid"][0].as_py()
        first = np.full((len(node), FIRST_GROUPS), gid, np.int64)  # padded with this group
        for i, groups in zip(np.argsort(order), table_["first"].to_pylist(), strict=True):
            first[i, : len(groups)] = groups
        others = len(node) - int(counts.max())
        us, vs = [], []
        block = max(1, (8 << 20) // len(node))
        for i in range(0, others, block):
            rows = slice(i, min(i + block, others))
            near = np.maximum(n[rows, None], n[None, i:]) * percent <= np.minimum(n[rows, None], n[None, i:]) * 100
            a, b = np.nonzero(near & (label[rows, None] != label[None, i:]))
            a, b = a + i, b + i
            a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 1 << 16):
                x, y = a[k: k + (1 << 16)], b[k: k + (1 << 16)]
                earlier = np.zeros(len(x), bool)
                for c in range(FIRST_GROUPS):
                    own = first[x, c]
                    earlier |= (own < gid) & (first[y] == own[:, None]).any(axis=1)
                x, y = x[~earlier], y[~earlier]
                ok = _possible(n[x], n[y], sketches.differing(x, sketches, y), percent)
                us.append(node[x[ok]])
                vs.append(node[y[ok]])
        empty = np.zeros(0, np.int64)
        u, v = np.concatenate([empty, *us]), np.concatenate([empty, *vs])
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return run


def _verify(size: int, percent: int):
    """Rows sorted by (v, salt, is_member): the pivot's text first, then its candidates' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                u, v = [], []
                names = part.schema.names
                keys = list(zip(*(part.column(names.index(x)).to_pylist() for x in ("v", "salt")), strict=True))
                members = part.column(names.index("u")).to_pylist()
                for at, member, elements in zip(keys, members, row_sets(part, "text", size), strict=True):
                    if member is None:
                        key, own = at, elements
                        continue
                    if key != at:
                        raise ValueError(f"no text for node {at[0]}")
                    shared = len(np.intersect1d(own, elements, assume_unique=True))
                    if 100 * shared >= percent * (len(own) + len(elements) - shared):
                        u.append(member)
                        v.append(at[0])
                yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose exact similarity reaches the threshold. Texts are sent to the task of
    the pair's smaller node v; its pairs are salted over 16 tasks, each with a copy of v's text."""
    salted = materialise(pairs.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(16)).cast("int")), "pairs")
    sides = salted.select(F.col("u").alias("node"), "u", "v", "salt").union(
        salted.select(F.col("v").alias("node"), F.lit(None).cast("long"), "v", "salt").distinct())
    # one text for each node that a pair names; the list is written, so that the join knows its size
    named = materialise(sides.select("node").distinct(), "named")
    return (sides.join(_texts_of(texts, named), "node").drop("node").repartition(shuffle_partitions(texts.sparkSession), "v", "salt")
            .sortWithinPartitions("v", "salt", F.col("u").asc_nulls_first())
            .select("v", "salt", "u", "text")
            .mapInArrow(releasing(_verify(size, percent)), "u long, v long"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, node, label, n_shingles, component_id), one row
    per row.

    ``node`` is the hash of the text, ``label`` the smallest node of its component (null without
    words). ``component_id`` is the smallest doc_id reachable by links,
    the row's own included. Null or wordless texts have an empty set, link with nothing (not with
    each other) and keep their own doc_id. Null doc_ids take part; a component of null ids only
    has a null component_id. Repeated rows come out as often as they came in. An empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("node"), text_or_empty().alias("text"))
    texts = rows.select("node", "text")
    profile = materialise(
        rows.mapInArrow(releasing(_profile(size)), "doc_id long, node long, n long, sketch binary"), "profile")
    nodes = materialise(profile.where("n > 0").groupBy("node").agg(
        F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("doc_id").alias("least")), "nodes")
    sketches = nodes.select("node", "n", "sketch")

    buckets = shuffle_partitions(spark) * BUCKETS_PER_PARTITION
    groups = materialise(
        texts.mapInArrow(releasing(_sign(size, percent, buckets)), "bucket int, sigs binary, nodes binary")
        .groupBy("bucket").applyInArrow(_groups_of_bucket, "gid long, pivot long, node long")
        .dropDuplicates(["gid", "node"]), "groups")

    def bounded(pairs: DataFrame) -> DataFrame:
        a = sketches.select(F.col("node").alias("u"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        b = sketches.select(F.col("node").alias("v"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        return pairs.join(a, "u").join(b, "v").mapInArrow(releasing(_bounded(percent)), "u long, v long")

    stars = groups.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    linked = materialise(_links(bounded(stars), texts, size, percent), "links")
    labels = connected_components(linked)

    # members of one group that the stars left in different components
    labelled = (groups.select("gid", "node").join(labels, "node", "left")
                .select("gid", "node", F.coalesce("label", "node").alias("label")))
    mixed = (labelled.groupBy("gid").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
             .where("c > 2 and lo <> hi").select("gid"))
    mixed = materialise(labelled.join(mixed, "gid", "left_semi"), "mixed")
    first = mixed.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("gid")), 1, FIRST_GROUPS).alias("first"))
    rest = (mixed.join(sketches.join(first, "node"), "node").groupBy("gid").applyInArrow(_across(percent), "u long, v long").distinct())
    rest = materialise(rest, "rest")
    if not rest.isEmpty():
        more = materialise(_links(rest, texts, size, percent), "links")
        if not more.isEmpty():
            labels = connected_components(linked.union(more))

    named = nodes.select("node", "least").join(labels, "node", "left").select(
        "node", "least", F.coalesce("label", "node").alias("label"))
    component = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = named.join(component, "label").select("node", "label", "component_id")
    return (profile.join(by_node, "node", "left")
            .select("doc_id", "node", "label", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each_group(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (then text hash);
    of rows equal in doc_id and text any one. Wordless texts are kept, each row of them."""
    last = F.lit(2**63 - 1)  # where null doc_ids sort
    d, node, has_words = free_names(docs, "_d", "_node", "_words")
    found = materialise(jaccard_components(docs, size, percent), "components")
    kept = (found.where("n_shingles > 0").groupBy("label")
            .agg(F.min(F.struct(F.coalesce("doc_id", last).alias("d"), "node")).alias("first"))
            .select(F.col("first.d").alias(d), F.col("first.node").alias(node)))
    tagged = docs.withColumns({d: F.coalesce("doc_id", last), node: F.xxhash64(text_or_empty()),
                               has_words: text_or_empty().rlike("[^\\x20\\x09-\\x0D]")})
    words = tagged.where(F.col(has_words)).join(kept, [d, node], "left_semi").dropDuplicates([d, node])
    return words.select(*docs.columns).union(tagged.where(~F.col(has_words)).select(*docs.columns))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
