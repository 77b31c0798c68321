"""Exact k nearest neighbours, pruned by Voronoi cells around pivots.

Train rows belong to the cell of their nearest pivot, and within a cell to a ring, a range of
distances from the pivot. A ring can hold a neighbour of a query only if the triangle inequality lets it:
for a query at distance t of the pivot, a ring (a, b] has nothing nearer than max(t - b, a - t), and
a cell nothing nearer than the query's distance from the plane between its own pivot and the cell's.

Rows are compared by blocks of about ``BLOCK_ROWS`` rows: small cells that lie near each other share one, a
ring with more rows has several. Round one compares each query with its own cell's block and so
bounds its k-th distance; round two sends it, once each, to those other blocks whose rings could hold something
nearer. Queries of a block are dealt into chunks, so a task holds a bounded block of each side however the
rows are spread, and where nothing can be pruned (many dimensions, no clusters) a query is sent to
rows / ``BLOCK_ROWS`` blocks instead of to each cell. Only pivots and each cell's ring bounds (at most
PIVOTS x RINGS numbers) and counts by block are held by the driver and sent to tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

PIVOTS, RINGS = 1024, 64  # at most
BLOCK_ROWS = 10_000
SLACK = 1e-6  # of the largest norm: what rounding may add to a bound
ROUTED_ROWS, PAIRS = 5_000, 500_000  # rows of a frame that routing yields; pairs that are looked at together


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(vectors: pd.Series, d: int) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64).reshape(len(vectors), d)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rows of x from rows of p, up to rounding (see SLACK)."""
    squares = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T
    return np.sqrt(np.maximum(squares, 0))


class Cells:
    """Pivots, the distances between them, and of each cell the bounds of its rings (from 0 to infinity); the
    blocks of a ring are ``salts`` numbers from ``block`` on, both by slot, the ring's number among all."""

    def __init__(self, pivots: np.ndarray, slack: float):
        self.pivots, self.slack = pivots, slack
        self.between = _distances(pivots, pivots)
        self.bounds = [np.array([0.0, np.inf])] * len(pivots)
        self.filled = np.zeros(len(pivots), bool)

    def number(self) -> None:
        """Numbers the slots, once the bounds are known."""
        self.slot = np.cumsum([0, *(len(b) - 1 for b in self.bounds)])

    def pack(self, counts: np.ndarray, block_rows: int) -> None:
        """Deals the slots, with their counts of rows, into blocks of at most ``block_rows`` rows (salted ones: on
        average). Cells of one ring go along a chain of pivots, each the nearest of those left."""
        self.salts = np.maximum(1, -(-counts // block_rows))
        self.block = np.zeros(len(counts), np.int64)
        full = block_rows + 1
        self.blocks, rows, at = 0, full, 0
        left = np.ones(len(self.pivots), bool)
        for _ in range(len(self.pivots)):
            left[at] = False
            for slot in range(self.slot[at], self.slot[at + 1]):
                if len(self.bounds[at]) > 2 or counts[slot] > block_rows:
                    self.block[slot] = self.blocks
                    self.blocks += int(self.salts[slot])
                    rows = full  # the next cell begins a block
                elif rows + counts[slot] > block_rows:
                    self.block[slot], rows = self.blocks, counts[slot]
                    self.blocks += 1
                else:
                    self.block[slot], rows = self.blocks - 1, rows + counts[slot]
            if left.any():
                at = int(np.where(left, np.nan_to_num(self.between[at], nan=1e300), np.inf).argmin())

    def routes(self, distances: np.ndarray, reach: np.ndarray, only_own: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, block), each pair once: all blocks of a query's own cell, or the others that have a ring within
        ``reach``."""
        own = self.cell_of(distances)
        q = np.repeat(np.arange(len(own)), self.slot[own + 1] - self.slot[own])
        pairs = self._pairs(q, self.slot[own][q] + np.arange(len(q)) - np.searchsorted(q, q, "left"))
        if not only_own:
            q, c, ring = self.blocks_for(distances, reach, own, False)
            pairs = np.setdiff1d(self._pairs(q, self.slot[c] + ring), pairs, assume_unique=True)
        return pairs // self.blocks, pairs % self.blocks

    def _pairs(self, q: np.ndarray, slot: np.ndarray) -> np.ndarray:
        salts = self.salts[slot]
        of = np.repeat(np.arange(len(q)), salts)
        salt = np.arange(len(of)) - np.repeat(np.cumsum(salts) - salts, salts)
        return np.unique(q[of] * self.blocks + self.block[slot][of] + salt)

    def cell_of(self, distances: np.ndarray) -> np.ndarray:
        return distances.argmin(1)

    def blocks_for(self, distances: np.ndarray, reach: np.ndarray, own: np.ndarray, only_own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell, ring) for each ring within ``reach`` of a query: of its own cell, or of all others."""
        n, m = distances.shape
        rows = np.arange(n)
        if only_own:
            q, c = rows, own
        else:
            nearest = distances[rows, own]
            apart = self.between[own]  # of the query's pivot from each other one
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart > 0, (distances ** 2 - nearest[:, None] ** 2) / (2 * apart), 0.0)
            # written so that an undefined distance prunes nothing
            possible = ~(plane > reach[:, None] + self.slack * (1 + np.where(apart > 0, (distances + nearest[:, None]) / np.maximum(apart, 1e-300), 0))) & self.filled
            possible[rows, own] = False
            q, c = np.nonzero(possible)
        found = []
        for cell in np.unique(c):
            of = q[(c == cell)]
            t, r = distances[of, cell][:, None], reach[of][:, None] + self.slack
            lo, hi = self.bounds[cell][:-1][None, :], self.bounds[cell][1:][None, :]
            i, ring = np.nonzero(~((lo > t + r) | (hi < t - r)))
            found.append((of[i], np.full(len(i), cell), ring))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cells(train: DataFrame, pivots: int) -> tuple[Cells, DataFrame, int]:
    """(cells, train rows (rid, rv, block) written, dimensions)."""
    drawn = train.orderBy(F.xxhash64("rid"), "rid").limit(pivots).collect()
    points = np.unique(np.array([r.rv for r in drawn], np.float64), axis=0)
    d = points.shape[1]
    largest = train.agg(F.max(F.aggregate("rv", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    cells = Cells(points, SLACK * float(np.sqrt(largest)) + 1e-12)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            t = _distances(_matrix(batch["rv"], d), points)
            cell = t.argmin(1)
            yield batch.assign(cell=cell.astype(np.int32), dist=t[np.arange(len(t)), cell])

    placed = _written(train.mapInPandas(assign, "rid long, rv array<double>, cell int, dist double"), "knn-train")
    grid = F.percentile_approx("dist", [i / RINGS for i in range(1, RINGS)], 1000)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), grid.alias("grid")).collect():  # a row for each pivot
        rings = min(RINGS, -(-r.n // BLOCK_ROWS))
        inner = [r.grid[i * RINGS // rings - 1] for i in range(1, rings)]
        cells.bounds[r.cell] = np.array([0.0, *sorted(set(inner)), np.inf])
        cells.filled[r.cell] = True
    cells.number()
    bounds, first = cells.bounds, cells.slot

    def slot(cell: pd.Series, dist: pd.Series) -> np.ndarray:
        # a ring is (lower bound, upper bound]
        return np.array([first[c] + min(max(int(np.searchsorted(bounds[c], x, "left")) - 1, 0), len(bounds[c]) - 2) for c, x in zip(cell, dist, strict=True)], np.int64)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots, n = np.unique(slot(batch["cell"], batch["dist"]), return_counts=True)
            yield pd.DataFrame({"slot": slots, "n": n})

    counts = np.zeros(int(first[-1]), np.int64)
    for r in placed.select("cell", "dist").mapInPandas(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # a row for each ring
        counts[r.slot] = r.n
    cells.pack(counts, BLOCK_ROWS)
    block, salts = cells.block, cells.salts

    def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = slot(batch["cell"], batch["dist"])
            yield batch[["rid", "rv"]].assign(block=(block[s] + batch["salt"].to_numpy() % salts[s]).astype(np.int32))

    salted = placed.withColumn("salt", F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(1 << 40)))
    return cells, salted.mapInPandas(blocked, "rid long, rv array<double>, block int"), d


ROUTED = "qid long, qv array<double>, reach double, block int"


def routed(batch: pd.DataFrame, cells: Cells, d: int, only_own: bool) -> Iterator[pd.DataFrame]:
    """(qid, qv, reach) -> ROUTED: a row for each block that a query must be compared with, ROUTED_ROWS at a time."""
    step = max(1, min(500, 1_000_000 // max(1, len(cells.salts) + cells.blocks)))
    for begin in range(0, len(batch), step):
        part = batch.iloc[begin:begin + step]
        q, block = cells.routes(_distances(_matrix(part["qv"], d), cells.pivots), part["reach"].to_numpy(np.float64), only_own)
        for at in range(0, len(q), ROUTED_ROWS):
            of = part.iloc[q[at:at + ROUTED_ROWS]]
            yield of[["qid", "qv", "reach"]].assign(block=block[at:at + ROUTED_ROWS].astype(np.int32))


def nearest_of(qid: np.ndarray, a: np.ndarray, reach: np.ndarray, rid: np.ndarray, b: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """(qid, rid, d2): of rows b the k nearest of each query a within its reach, a bounded number of pairs at a
    time. Distances by a matrix product say which pairs can count; only those are measured exactly."""
    squares = (b * b).sum(1)
    rounding = 1e-13 * b.shape[1]  # of the squared norms: far above what the product loses
    step, m = max(1, PAIRS // max(1, len(b))), min(k, len(b))
    for begin in range(0, len(a), step):
        x = a[begin:begin + step]
        own = (x * x).sum(1)
        d2 = own[:, None] + squares[None, :] - 2 * x @ b.T
        most = reach[begin:begin + step] ** 2
        if not np.isfinite(most).all():
            most = np.fmin(most, np.partition(d2, m - 1, axis=1)[:, m - 1])
        most = most * (1 + 1e-9) + rounding * (own + squares.max()) + 1e-300
        i, j = np.nonzero(~(d2 > most[:, None]))  # an undefined distance stays
        exact = np.empty(len(i))
        for s in range(0, len(i), 50_000):
            diff = x[i[s:s + 50_000]] - b[j[s:s + 50_000]]
            exact[s:s + 50_000] = np.einsum("ij,ij->i", diff, diff)
        order = np.lexsort((rid[j], exact, i))  # by distance, then id
        i, j, exact = i[order], j[order], exact[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i, "left") < m
        yield pd.DataFrame({"qid": qid[begin:begin + step][i[kept]], "rid": rid[j[kept]], "d2": exact[kept]})


def _compared(queries: DataFrame, train: DataFrame, cells: Cells, d: int, k: int, block_rows: int, only_own: bool) -> DataFrame:
    """Queries (qid, qv, reach) and blocks of train rows -> (qid, rid, d2): of each pair of blocks the k nearest of
    each query. Routing runs when this is called, to count each block's queries; vectors are only shuffled."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(cells.blocks, np.int64)
        for batch in batches:
            for part in routed(batch, cells, d, only_own):
                n += np.bincount(part["block"], minlength=cells.blocks)
        found = np.nonzero(n)[0]
        yield pd.DataFrame({"block": found.astype(np.int32), "n": n[found]})

    chunks = np.zeros(cells.blocks, np.int64)
    for r in queries.mapInPandas(counted, "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():  # a row for each block
        chunks[r.block] = -(-r.n // block_rows)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashed = pd.Series(batch["hash"].to_numpy(), index=batch.index)
            for part in routed(batch, cells, d, only_own):
                yield part.assign(chunk=(hashed.loc[part.index].to_numpy() % chunks[part["block"]]).astype(np.int32))

    sent = queries.withColumn("hash", F.pmod(F.xxhash64("qid"), F.lit(1 << 40))).mapInPandas(dealt, f"{ROUTED}, chunk int")
    parts = train.sparkSession.createDataFrame([(int(b), int(chunks[b])) for b in np.nonzero(chunks)[0]], "block int, parts int")
    rows = train.join(F.broadcast(parts), "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def nearest(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": np.zeros(0, np.int64), "rid": np.zeros(0, np.int64), "d2": np.zeros(0)})]
        if len(q) and len(r):
            out += nearest_of(q["qid"].to_numpy(), _matrix(q["qv"], d), q["reach"].to_numpy(np.float64), r["rid"].to_numpy(), _matrix(r["rv"], d), k)
        return pd.concat(out[1:] or out, ignore_index=True)

    by = ["block", "chunk"]
    return sent.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(nearest, "qid long, rid long, d2 double")


def nearest_neighbours(train: DataFrame, test: DataFrame, key: str, vec: str, k: int, pivots: int | None = None,
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(qid, rid, d2): the k nearest rows of ``train`` (fewer if it has fewer) for each row of ``test``, by squared
    distance, equal ones by train key. Exact. Keys are unique; rows without a key or vector take no part;
    an empty side gives no rows. Assigning cells and round one run when this is called; their tables are
    written to the shared folder."""
    tr = train.select(F.col(key).cast("long").alias("rid"), F.col(vec).cast("array<double>").alias("rv")).na.drop()
    te = test.select(F.col(key).cast("long").alias("qid"), F.col(vec).cast("array<double>").alias("qv")).na.drop()
    n = tr.count()
    if not n:
        return train.sparkSession.createDataFrame([], "qid long, rid long, d2 double")
    cells, placed, d = _cells(tr, pivots or min(PIVOTS, max(16, 2 * int(n ** 0.5))))
    rows = _written(placed, "knn-blocks")
    first = _compared(te.withColumn("reach", F.lit(float("inf"))), rows, cells, d, k, block_rows, True)
    best = Window.partitionBy("qid").orderBy("d2", "rid")
    first = _written(first.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k), "knn-first")
    # the k-th distance found so far; a query whose own block has fewer rows reaches everywhere
    reach = first.where(F.col("r") == k).select("qid", F.sqrt("d2").alias("reach"))
    reached = _written(te.join(reach, "qid", "left").na.fill(float("inf"), ["reach"]), "knn-reached")
    second = _compared(reached, rows, cells, d, k, block_rows, False)
    both = first.select("qid", "rid", "d2").unionByName(second)
    return both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def classify(train: DataFrame, test: DataFrame, key: str, vec: str, label: str, k: int = 3, **parameters) -> DataFrame:
    """Majority vote of the k nearest neighbours; ties in votes go to the smallest label."""
    found = nearest_neighbours(train, test, key, vec, k, **parameters)
    labels = train.select(F.col(key).cast("long").alias("rid"), F.col(label).cast("long").alias("rl"))
    votes = found.join(labels, "rid").groupBy("qid", "rl").agg(F.count(F.lit(1)).alias("votos"))
    return votes.groupBy("qid").agg(F.max_by("rl", F.struct(F.col("votos"), -F.col("rl"))).alias("prediccion")).select(
        F.col("qid").alias(key), "prediccion")
