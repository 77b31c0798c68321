"""Conversation prefix trie: every distinct beginning of a conversation is a node.

Turns are dictionary-encoded: a turn's code is a 64-bit hash of role and text, and the codes are
checked to stand for one turn each (else another seed is taken). Conversations of equal codes are
one sequence before anything is sorted, and sequences are range-partitioned into shards, so a
prefix that fills the corpus is spread over many shards. Each shard numbers its codes in order,
builds a ternary search tree by inserting the median sequence first, then the medians of both
halves, and an iterative traversal accumulates members, leaves and savings.

Only nodes on the paths of a shard's first and last sequence reach into a neighbour, and only down
to the prefix that the neighbours share. A shard gives those nodes as one row of arrays. The boundary
merge streams one such row for each shard and holds the path that is open, a stack as deep as the
shared prefix; it numbers the boundary nodes and gives each one once. All other nodes are final in
their shard, but for the smallest member of a parent on the boundary, which is joined.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import materialise, shuffle_partitions, table

SHARD_TURNS = 1 << 18
DIGEST_BYTES = 1 << 20
SEEDS = 8
MOST_TAKEN = 5

# --- sequences ----------------------------------------------------------------------------------


def encoded_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> (conv_id, turn, code, chars): ``code`` (long) is the same for
    equal (role, text) and for no others, ``chars`` the text's code points.

    Null roles and texts are empty; rows without conv_id belong to no conversation and go; other
    columns are ignored. Two hashes of a turn make 128 bits: a code with two second hashes is a
    collision, and the turns are encoded again by the next seed. Written to the shared folder when
    called."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    for seed in range(SEEDS):
        coded = materialise(rows.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.xxhash64(F.lit(seed), role, text).alias("code"), F.length(text).alias("chars"),
            F.xxhash64(text, F.lit(seed), F.length(role), role).alias("other")), "trie-turns")
        seconds = coded.groupBy("code").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
        if seconds.where("lo <> hi").isEmpty():
            return coded.drop("other")
    raise RuntimeError("no seed gives every turn a code of its own")


def taken_turns(conv_id: str = "conv_id") -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % (MOST_TAKEN + 1)).cast("int")


def ordered(turns: DataFrame) -> DataFrame:
    """``encoded_turns`` -> (conv_id, steps array<struct<code, chars>>): a conversation's turns by ``turn``
    (null first), equal ones by code. A conversation is one row of numbers (12 bytes a turn)."""
    step = F.struct("turn", "code", "chars")  # sort_array has nulls first
    steps = F.sort_array(F.collect_list(step))
    return turns.groupBy("conv_id").agg(F.transform(steps, lambda s: F.struct(s["code"].alias("code"), s["chars"].alias("chars"))).alias("steps"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``ordered`` -> the same columns: the first h turns of conversation c - c % 100 (all if fewer, none
    if absent), then c's own turns after its first h; h is the crc32 of c's digits modulo 6. Every
    conversation is a row, also when no turn is left."""
    none = F.array().cast("array<struct<code: bigint, chars: int>>")
    heads = conversations.where("conv_id % 100 = 0").select(F.col("conv_id").alias("_base"), F.slice("steps", 1, MOST_TAKEN).alias("_head"))
    own = conversations.withColumn("_base", F.col("conv_id") - F.col("conv_id") % 100)
    h = taken_turns()
    steps = F.concat(F.slice(F.coalesce("_head", none), F.lit(1), h), F.slice("steps", h + 1, F.size("steps")))
    return own.join(heads, "_base", "left").select("conv_id", steps.alias("steps"))


# --- one shard ----------------------------------------------------------------------------------


class SearchTree:
    """Ternary search tree over sequences of numbers, as lists. A tree node has a number, the trees of
    sequences with a lower or higher number at this place (``lo``, ``hi``) and the tree of what
    follows it (``eq``). Tree node 0 is the root, whose ``eq`` begins all sequences."""

    def __init__(self):
        self.key, self.lo, self.eq, self.hi = [-1], [-1], [-1], [-1]

    def insert(self, sequence: list[int]) -> int:
        """The tree node at which the sequence ends."""
        key, lo, eq, hi = self.key, self.lo, self.eq, self.hi
        at = 0
        for x in sequence:
            link, here = eq, at
            while (child := link[here]) >= 0 and key[child] != x:
                link, here = (lo if x < key[child] else hi), child
            if child < 0:
                child = link[here] = len(key)
                key.append(x)
                for pointers in (lo, eq, hi):
                    pointers.append(-1)
            at = child
        return at

    def children(self, at: int) -> Iterator[int]:
        """The nodes one turn deeper, in order."""
        stack, node = [], self.eq[at]
        while stack or node >= 0:
            while node >= 0:
                stack.append(node)
                node = self.lo[node]
            node = stack.pop()
            yield node
            node = self.hi[node]


def medians(n: int) -> Iterator[int]:
    """0..n-1: the middle of each range before those of its halves."""
    ranges = [(0, n)]
    for lo, hi in ranges:  # grows as it goes
        if lo < hi:
            middle = (lo + hi) // 2
            yield middle
            ranges += [(lo, middle), (middle + 1, hi)]


PARTS = ("conv_id", "n_convs", "n_children", "n_leaves", "saved", "chars", "end_a", "end_b")
#: A node (path null), or a shard's boundary (the other columns null but for shard): its nodes shared
#: with the shard before (``n_first`` of them), then those shared with the next one below the first ``n_both``.
SHARD = pa.schema([*((c, pa.int64()) for c in ("shard", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                               "saved_tokens", "end_a", "end_b")), ("side", pa.int32()), ("n_first", pa.int32()), ("n_both", pa.int32()),
                   ("path", pa.list_(pa.struct([(c, pa.int64()) for c in PARTS])))])
SHARD_SQL = ("shard long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
             f"end_a long, end_b long, side int, n_first int, n_both int, path array<struct<{', '.join(f'{c}: long' for c in PARTS)}>>")
BEFORE, AFTER = 1, 2  # the side of a boundary node that is a parent


def _sequences(table: pa.Table) -> tuple[list[list[int]], list[int], np.ndarray]:
    """Sequences as numbers of the shard's own dictionary (in the order of codes), and each number's chars."""
    column = table.column("codes").combine_chunks()
    bounds = np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy())].tolist()
    codes = pc.list_flatten(column).to_numpy()
    chars = pc.list_flatten(table.column("chars").combine_chunks()).to_numpy()
    dictionary, number = np.unique(codes, return_inverse=True)
    length = np.zeros(len(dictionary), np.int64)
    length[number] = chars
    flat = number.tolist()
    return [flat[lo:hi] for lo, hi in zip(bounds, bounds[1:], strict=False)], length.tolist()


def _shard(table: pa.Table) -> pa.Table:
    """One shard's distinct sequences -> SHARD. Columns: shard, codes, chars, n (members), least (smallest
    member), end_a and end_b (the sequence's key), before and after (how many first turns the shard's
    nearest sequence shares with that neighbour; -1: no neighbour)."""
    table = table.take(pc.sort_indices(table.column("least")))
    sequences, length = _sequences(table)
    members, least, end_a, end_b = (table.column(c).to_pylist() for c in ("n", "least", "end_a", "end_b"))
    shard, before, after = (table.column(c)[0].as_py() for c in ("shard", "before", "after"))
    sorted_by_codes = sorted(range(len(sequences)), key=sequences.__getitem__)
    tree, ends = SearchTree(), {}
    for i in medians(len(sequences)):
        ends[tree.insert(sequences[sorted_by_codes[i]])] = sorted_by_codes[i]
    size = len(tree.key)
    chars = [0, *map(length.__getitem__, tree.key[1:])]
    n, children, leaves, saved, depth, parent = ([0] * size for _ in range(6))
    low: list[int] = [1 << 63] * size
    for node, i in ends.items():
        n[node], low[node] = members[i], least[i]
    order = [0]
    for node in order:  # grows: a node before its children
        for child in tree.children(node):
            parent[child], depth[child] = node, depth[node] + 1
            order.append(child)

    def path(sequence: list[int], shared: int) -> list[int]:
        """Tree nodes of the sequence's first ``shared`` turns, the root first."""
        found = [0] if shared >= 0 else []
        for x in sequence[:max(shared, 0)]:
            found.append(next(c for c in tree.children(found[-1]) if tree.key[c] == x))
        return found

    first, last = path(sequences[sorted_by_codes[0]], before), path(sequences[sorted_by_codes[-1]], after)
    side = dict.fromkeys(last, AFTER) | dict.fromkeys(first, BEFORE)  # of the boundary's nodes
    n_both = len(set(first) & set(last))
    for node in reversed(order):
        whole = node not in side
        if whole:
            leaves[node] = leaves[node] or 1
            saved[node] += (n[node] - 1) * chars[node]
        if node:
            up = parent[node]
            n[up] += n[node]
            low[up] = min(low[up], low[node])
            if whole:  # a boundary node is counted when it is whole
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]

    def end(node: int, of: list[int]) -> int | None:
        return of[ends[node]] if node in ends else None

    closed = [node for node in order if node not in side]
    rows = {"shard": [shard] * len(closed), "conv_id": [low[x] for x in closed], "depth": [depth[x] for x in closed],
            "parent_conv_id": [low[parent[x]] if x and parent[x] not in side else None for x in closed],
            "n_convs": [n[x] for x in closed], "n_children": [children[x] for x in closed], "n_leaves": [leaves[x] for x in closed],
            "saved_tokens": [saved[x] for x in closed], "end_a": [end(x, end_a) for x in closed], "end_b": [end(x, end_b) for x in closed],
            "side": [side.get(parent[x], 0) if x else 0 for x in closed]}
    boundary = [dict(zip(PARTS, (low[x], n[x], children[x], leaves[x], saved[x], chars[x], end(x, end_a), end(x, end_b)), strict=True))
                for x in [*first, *last[n_both:]]]
    rows = pa.table({f.name: pa.array(rows.get(f.name, [None] * len(closed)), f.type) for f in SHARD}, schema=SHARD)
    return pa.concat_tables([rows, pa.Table.from_pylist([{"shard": shard, "n_first": len(first), "n_both": n_both, "path": boundary}], SHARD)])


def _shared(a: str, b: str) -> Column:
    """How many first items two arrays share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), True)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def shards(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Distinct sequences with the shard (a range of codes) they are in, and what their shard shares
    with its neighbours. A shard has about ``shard_turns`` turns. Written to the shared folder: the
    ranges come from a sample, and all readers must see the same ones."""
    turns = sequences.agg(F.coalesce(F.sum(F.size("codes") + 1), F.lit(0)).alias("n")).first().n
    n = max(math.ceil(turns / shard_turns), shuffle_partitions(sequences.sparkSession))
    split = materialise(sequences.repartitionByRange(n, "codes").withColumn("shard", F.spark_partition_id().cast("long")), "trie-shards")
    edges = materialise(split.groupBy("shard").agg(F.min("codes").alias("first"), F.max("codes").alias("last")), "trie-edges")
    line = Window.orderBy("shard")  # one number for each shard
    near = edges.select("shard").withColumn("next", F.lead("shard").over(line)).where("next is not null")
    pairs = (near.join(edges.select("shard", F.col("last").alias("a")), "shard")
             .join(edges.select(F.col("shard").alias("next"), F.col("first").alias("b")), "next").select("shard", "next", _shared("a", "b").alias("n")))
    pairs = materialise(pairs, "trie-pairs")
    near = (edges.select("shard").join(pairs.select(F.col("next").alias("shard"), F.col("n").alias("before")), "shard", "left")
            .join(pairs.select("shard", F.col("n").alias("after")), "shard", "left").na.fill(-1))
    return split.join(near, "shard")


# --- the boundary merge -------------------------------------------------------------------------

#: A boundary node with its number and its parent's, or (n_convs null) the number of a shard's node.
MERGED = pa.schema([*((c, pa.int64()) for c in ("node", "parent", "shard", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                                "end_a", "end_b")), ("side", pa.int32())])
MERGED_SQL = ", ".join(f"{f.name} {'int' if f.name == 'side' else 'long'}" for f in MERGED)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundaries of all shards in order -> MERGED. ``stack``: the nodes that the shards read so far
    share with the next one, the root first."""
    stack: list[dict] = []
    out: list[dict] = []
    made = 0

    def close(keep: int) -> None:
        while len(stack) > keep:
            x = stack.pop()
            x["n_leaves"] = x["n_leaves"] or 1
            x["saved"] += (x["n_convs"] - 1) * x["chars"]
            if stack:
                up = stack[-1]
                up["n_children"] += 1
                up["n_leaves"] += x["n_leaves"]
                up["saved"] += x["saved"]
            out.append({**x, "saved_tokens": x["saved"], "parent": stack[-1]["node"] if stack else None, "depth": len(stack)})

    for batch in batches:
        for row in batch.to_pylist():
            n_first, n_both, path = row["n_first"], row["n_both"], row["path"]
            for x, more in zip(stack, path[:n_first], strict=True):
                x["conv_id"] = min(x["conv_id"], more["conv_id"])
                for c in ("n_convs", "n_children", "n_leaves", "saved"):
                    x[c] += more[c]
                if more["end_a"] is not None:
                    x["end_a"], x["end_b"] = more["end_a"], more["end_b"]
            out.extend({"node": x["node"], "shard": row["shard"], "depth": d, "side": BEFORE} for d, x in enumerate(stack))
            close(n_both)
            for x in path[n_first:]:
                stack.append({**x, "node": made})
                made += 1
            out.extend({"node": x["node"], "shard": row["shard"], "depth": d, "side": AFTER} for d, x in enumerate(stack) if d >= n_both)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=MERGED)
                out = []
    close(0)
    yield pa.RecordBatch.from_pylist(out, schema=MERGED)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_a", "end_b"]


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> tuple[DataFrame, DataFrame]:
    """``ordered`` or ``rebuilt`` -> (nodes, members).

    nodes (NODE): of each distinct beginning its smallest member, depth, the parent's smallest member
    (root: null), members, children, leaves below it (a leaf counts itself), saved_tokens (summed over
    its subtree: members but one, times the chars of the node's last turn), and the key of the
    conversations that end there (null: none). members: (end_a, end_b, conv_id). A table without
    conversations has no nodes. Intermediate tables are written to the shared folder when called."""
    codes = F.col("steps.code")
    whole = materialise(conversations.select("conv_id", codes.alias("codes"), F.col("steps.chars").alias("chars"), F.xxhash64(codes).alias("end_a"),
                                             F.xxhash64(F.size("steps"), codes).alias("end_b")), "trie-conversations")
    sequences = whole.groupBy("end_a", "end_b", "codes", "chars").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    built = materialise(shards(sequences, shard_turns).groupBy("shard").applyInArrow(_shard, SHARD_SQL), "trie-nodes")
    boundary = built.where("path is not null").select("shard", "n_first", "n_both", "path")
    merged = materialise(boundary.repartition(1).sortWithinPartitions("shard").mapInArrow(_merge, MERGED_SQL), "trie-boundary")
    shared = merged.where("n_convs is not null")
    names = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    places = (merged.where("n_convs is null").select(F.col("node").alias("parent"), "shard", "side", (F.col("depth") + 1).alias("depth"))
              .join(names.withColumnRenamed("parent_conv_id", "boundary_conv_id"), "parent").drop("parent"))
    closed = built.where("path is null").drop("path", "n_first", "n_both")
    inner = closed.where("side = 0").select(*NODE)
    hanging = closed.where("side <> 0").drop("parent_conv_id").join(places, ["shard", "side", "depth"])
    return (inner.unionByName(hanging.withColumnRenamed("boundary_conv_id", "parent_conv_id").select(*NODE))
            .unionByName(shared.join(names, "parent", "left").select(*NODE))), whole.select("end_a", "end_b", "conv_id")


# --- the digest of the conversations that end at a node ------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (end_a, end_b, conv_id) -> (end_a, end_b, first, ids): conv_ids of one key, comma-joined, in
    pieces of DIGEST_BYTES."""
    key, first, held, size = None, None, [], 0
    for batch in batches:
        out = []
        a, b, ids = (batch.column(i).to_pylist() for i in range(3))
        for *now, conv in zip(a, b, ids, strict=True):
            if held and (now != key or size > DIGEST_BYTES):
                out.append((*key, first, ",".join(held)))
                held, size = [], 0
            if not held:
                key, first = now, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
        yield _columns(out, ("end_a", "end_b", "first", "ids"))
    yield _columns([(*key, first, ",".join(held))] if held else [], ("end_a", "end_b", "first", "ids"))


def _columns(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = [pa.string() if c in ("ids", "ends_sha256") else pa.int64() for c in names]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs -> (end_a, end_b, ends_sha256)."""
    key, digest = None, None
    for batch in batches:
        out = []
        for now_a, now_b, ids in zip(*(batch.column(c).to_pylist() for c in ("end_a", "end_b", "ids")), strict=True):
            if (now_a, now_b) != key:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (now_a, now_b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _columns(out, ("end_a", "end_b", "ends_sha256"))
    yield _columns([(*key, digest.hexdigest())] if key else [], ("end_a", "end_b", "ends_sha256"))


def end_digests(members: DataFrame) -> DataFrame:
    """(end_a, end_b, conv_id) -> (end_a, end_b, ends_sha256): SHA-256 of the conv_ids, ascending and
    comma-joined. Ranges of (key, conv_id) join ids in many tasks, also those of one key that has most
    rows; then a key's pieces, a megabyte each, are digested in order."""
    n = shuffle_partitions(members.sparkSession)
    keys = ["end_a", "end_b"]
    runs = (members.repartitionByRange(n, *keys, "conv_id").sortWithinPartitions(*keys, "conv_id").select(*keys, "conv_id")
            .mapInArrow(_runs, "end_a long, end_b long, first long, ids string"))
    return runs.repartition(n, *keys).sortWithinPartitions(*keys, "first").mapInArrow(_digests, "end_a long, end_b long, ends_sha256 string")


def conversation_trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A table of turns -> the nodes of its rebuilt conversations with ends_sha256 (none: the digest of
    the empty string)."""
    nodes, members = prefix_trie(rebuilt(ordered(encoded_turns(rows))), shard_turns)
    ended = nodes.where("end_a is not null").join(end_digests(members), ["end_a", "end_b"])
    return (ended.unionByName(nodes.where("end_a is null").withColumn("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def oracle_sql() -> str:
    """Every beginning of every conversation as a row, grouped by the digests of its turns."""
    return f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS code, length(coalesce(text, '')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (  -- crc32 of the decimal digits, four bits at a time
  SELECT conv_id, conv_id::VARCHAR AS digits, 4294967295::BIGINT AS crc, 0 AS step FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, digits, xor(crc >> 4, list_extract([{', '.join(map(str, _CRC_NIBBLES))}],
           ((xor(crc, CASE step % 2 WHEN 0 THEN ascii(digits[step // 2 + 1]) ELSE ascii(digits[step // 2 + 1]) >> 4 END) & 15) + 1)::INT)::BIGINT), step + 1
  FROM crc WHERE step < 2 * length(digits)),
taken AS (SELECT conv_id, xor(crc, 4294967295) % {MOST_TAKEN + 1} AS h FROM crc WHERE step = 2 * length(digits)),
rebuilt AS (
  SELECT k.conv_id, t.place, t.code, t.chars FROM taken k JOIN turns t ON t.conv_id = k.conv_id - k.conv_id % 100 AND t.place <= k.h
  UNION ALL
  SELECT k.conv_id, t.place, t.code, t.chars FROM taken k JOIN turns t ON t.conv_id = k.conv_id AND t.place > k.h),
sequences AS (
  SELECT k.conv_id, coalesce(list(r.code ORDER BY r.place) FILTER (r.code IS NOT NULL), []) AS codes,
         coalesce(list(r.chars ORDER BY r.place) FILTER (r.code IS NOT NULL), []) AS chars
  FROM taken k LEFT JOIN rebuilt r USING (conv_id) GROUP BY k.conv_id),
beginnings AS (
  SELECT conv_id, d AS depth, md5(array_to_string(codes[1:d], ',')) AS node,
         CASE WHEN d > 0 THEN md5(array_to_string(codes[1:d - 1], ',')) END AS parent, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, d = len(codes) AS ends
  FROM (SELECT *, unnest(range(len(codes) + 1)) AS d FROM sequences)),
nodes AS (
  SELECT depth, node, parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM beginnings GROUP BY depth, node, parent),
children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (  -- each node under every beginning of its smallest member
  SELECT b.depth, b.node, sum(n.saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node JOIN beginnings b ON b.conv_id = n.conv_id AND b.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, b.leaves AS n_leaves,
       b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.node = n.node LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.parent
"""


def _crc_step(nibble: int) -> int:
    for _ in range(4):
        nibble = nibble >> 1 ^ (0xEDB88320 if nibble & 1 else 0)
    return nibble


_CRC_NIBBLES = [_crc_step(i) for i in range(16)]
