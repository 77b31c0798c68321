"""W3 pages by rank and M16's exact strata against plain sorting."""

import random

import pytest

from datasets import SF_LARGE
from vistaspark.ml import models as MD
from vistaspark.operators import windows as W


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    return [(draw.choice([None, 1, 1, 1, 2, 3]), draw.choice([None, "a", "b"]), i) for i in draw.sample(range(10_000), 3000)]


@pytest.mark.parametrize("limit", [10_000, 60])
def test_pages_equal_a_sorted_list(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(W, "PAGE_ROWS", limit)
    df = spark.createDataFrame(rows, "x int, y string, id long").repartition(4)
    # x ascending has nulls first, y descending has them last
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is None, -ord(r[1] or "a"), r[2]))
    for page_no in (1, 2, 40, 75, 76):
        got = W.page(df, ["x", "-y"], "id", page_no, 40).collect()
        assert [(r.x, r.y, r.id) for r in got] == want[(page_no - 1) * 40:page_no * 40]
        assert all((r.total_filas, r.paginas) == (3000, 75) for r in got)


def test_page_of_an_empty_list(spark):
    assert W.page(spark.createDataFrame([], "x int, id long"), ["x"], "id", 1, 10).collect() == []


def test_last_page_sorts_one_range(spark):
    """The sort of the last page of lineitem reads a range, by filters that reach the scan."""
    lines = spark.read.parquet(f"{SF_LARGE}/lineitem.parquet").selectExpr("l_orderkey * 8 + l_linenumber AS id", "l_extendedprice AS x")
    total = lines.count()
    part, before = W._range_of(lines, [("x", False), ("id", False)], total, total - 20, total)
    assert part.count() <= W.PAGE_ROWS and before >= total - W.PAGE_ROWS
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" in plan.split("PushedFilters")[1].split("]")[0]
    last = W.page(lines, ["x"], "id", -(-total // 20), 20)
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("method", ["xxhash", "knuth"])
def test_exact_strata(spark, method):
    draw = random.Random(8)
    rows = [(i, draw.choice(["half"] * 3 + ["b", "c", None])) for i in range(2000)] + [(5000, "alone"), (5001, "pair"), (5002, "pair"), (5002, "dup"), (5002, "dup")]
    df = spark.createDataFrame(rows, "id long, g string").repartition(5)
    train, test = MD.split(df, "id", 0.75, 42, method, strata="g", exact_strata=True)
    assert train.columns == test.columns == ["id", "g"]
    number = {r.id: r.v for r in df.select("id", MD.split_number("id", 42, method).alias("v")).collect()}
    got, rest = [tuple(r) for r in train.collect()], [tuple(r) for r in test.collect()]
    assert sorted(map(str, got + rest)) == sorted(map(str, rows))
    for g in {g for _, g in rows}:
        order = sorted((number[i], i) for i, h in rows if h == g)
        n = int(0.75 * len(order) + 0.5)
        assert sorted((number[i], i) for i, h in got if h == g) == order[:n], g


def test_nothing_or_everything_is_trained(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, g int")
    for frac, n in ((0.0, 0), (1.0, 30)):
        assert MD.split(df, "id", frac, 1, strata="g", exact_strata=True)[0].count() == n
