"""Nearest neighbours by cells equal brute force, and cells do prune."""

import numpy as np
import pandas as pd
import pytest

from vistaspark.ml import neighbours as NB

DRAW = np.random.default_rng(5)


def brute(train, test, k):
    out = {}
    for q, v in test:
        d = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), r) for r, w in train)
        out[q] = [r for _, r in d[:k]]
    return out


def shapes():
    centres = DRAW.normal(0, 30, (8, 5))
    clustered = [centres[i % 8] + DRAW.normal(0, 1, 5) for i in range(700)]
    yield "clusters", clustered[:500], clustered[500:]
    yield "one hot cluster", [DRAW.normal(0, 1e-3, 5) if i % 3 else DRAW.normal(0, 50, 5) for i in range(500)], DRAW.normal(0, 1, (80, 5))
    yield "even", DRAW.uniform(0, 1, (400, 5)), DRAW.uniform(-1, 2, (60, 5))
    grid = DRAW.integers(0, 3, (300, 3)).astype(float)  # many equal rows and distances
    yield "ties", grid[:250], grid[250:]
    yield "far from 0", DRAW.normal(1e4, 1, (200, 4)), DRAW.normal(1e4, 1, (40, 4))


@pytest.mark.parametrize("name,train,test", list(shapes()), ids=lambda x: x if isinstance(x, str) else "")
def test_neighbours_equal_brute_force(spark, monkeypatch, name, train, test):
    monkeypatch.setattr(NB, "BLOCK_ROWS", 40)  # so that cells have rings
    a = [(i * 3, [float(x) for x in v]) for i, v in enumerate(train)]
    b = [(i, [float(x) for x in v]) for i, v in enumerate(test)]
    k = 4
    df = lambda rows: spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = {}
    for r in NB.nearest_neighbours(df([*a, (10_001, None)]), df([*b, (None, a[0][1])]), "id", "v", k, pivots=12, block_rows=25).collect():
        got.setdefault(r.qid, []).append((r.d2, r.rid))
    assert {q: [r for _, r in sorted(v)] for q, v in got.items()} == brute(a, b, k)


def test_few_rows_and_empty_sides(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    two = df([(1, [0.0, 0.0]), (2, [1.0, 0.0])])
    got = NB.nearest_neighbours(two, df([(9, [0.9, 0.0])]), "id", "v", 3).collect()
    assert sorted((r.qid, r.rid, round(r.d2, 6)) for r in got) == [(9, 1, 0.81), (9, 2, 0.01)]
    assert NB.nearest_neighbours(two.limit(0), two, "id", "v", 3).collect() == [] == NB.nearest_neighbours(two, two.limit(0), "id", "v", 3).collect()


def test_cells_prune():
    """Of far clusters only a query's own is visited."""
    points = np.array([[0.0, 0], [100, 0], [0, 100]])
    cells = NB.Cells(points, 1e-6)
    cells.filled[:] = True
    cells.bounds = [np.array([0.0, 1.0, np.inf])] * 3
    queries = np.array([[1.0, 1], [50.0, 0]])
    t = NB._distances(queries, points)
    q, c, ring = cells.blocks_for(t, np.array([2.0, 2.0]), cells.cell_of(t), False)
    assert 0 not in q.tolist() and set(c[q == 1].tolist()) == {1}  # the second lies on the plane between two pivots
    assert ring[q == 1].tolist() == [1]


def test_a_query_is_sent_once_to_each_block_and_in_bounded_frames(monkeypatch):
    """Where nothing can be pruned, a frame of routed queries grows neither with the cells nor with their rings."""
    points = DRAW.normal(0, 1, (200, 16))
    cells = NB.Cells(points, 1e-6)
    cells.filled[:] = True
    cells.number()
    cells.pack(np.full(200, 10), 500)
    assert cells.blocks == 4
    queries = pd.DataFrame({"qid": range(3000), "qv": list(DRAW.normal(0, 1, (3000, 16))), "reach": np.inf})
    monkeypatch.setattr(NB, "ROUTED_ROWS", 700)
    own, others = (list(NB.routed(queries, cells, 16, x)) for x in (True, False))
    assert max(map(len, own + others)) <= 700
    pairs = pd.concat(own + others)[["qid", "block"]]
    assert len(pairs) == 3000 * 4 == len(pairs.drop_duplicates())


def test_copies_are_dealt_over_blocks(spark, monkeypatch):
    """A ring of copies, which no distance can part, is many blocks; the smallest keys of equal ones win."""
    monkeypatch.setattr(NB, "BLOCK_ROWS", 50)
    df = lambda rows: spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    train = [(i, [1.0, 2.0]) for i in range(900)] + [(1000 + i, [float(i), 0.0]) for i in range(30)]
    cells, placed, _ = NB._cells(df(train).toDF("rid", "rv"), 12)
    sizes = [r["count"] for r in placed.groupBy("block").count().collect()]
    assert sum(sizes) == 930 and len(sizes) <= cells.blocks and max(sizes) < 150
    got = NB.nearest_neighbours(df(train), df([(1, [1.0, 2.1]), (2, [20.0, 0.0])]), "id", "v", 3, pivots=12, block_rows=25).collect()
    assert {q: sorted(r.rid for r in got if r.qid == q) for q in (1, 2)} == {1: [0, 1, 2], 2: [1019, 1020, 1021]}


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1e-4, 1e3), (1e6, 0.0)])
def test_measured_pairs_equal_all_pairs(scale, shift):
    a, b = (np.round(DRAW.normal(0, 1, (n, 6)), 1) * scale + shift for n in (60, 300))
    b[100:140] = b[:40]
    a[:20] = b[:20]
    rid = DRAW.permutation(300)
    exact = np.einsum("ijk,ijk->ij", a[:, None] - b, a[:, None] - b)
    order = np.lexsort((np.broadcast_to(rid, exact.shape), exact), axis=1)[:, :5]
    reach = np.sqrt(np.take_along_axis(exact, order, 1)[:, -1])
    for r in (np.full(60, np.inf), reach):
        got = pd.concat(NB.nearest_of(np.arange(60), a, r, rid, b, 5))
        assert got.rid.tolist() == rid[order].ravel().tolist()
        assert np.array_equal(got.d2, np.take_along_axis(exact, order, 1).ravel())
