"""Exact quantiles by selection: narrow to the cells that hold the wanted ranks, then rank only those rows.

A mergeable equi-depth histogram (``percentile_approx`` on a fixed grid, partial on the map side)
gives the cell that holds a rank. One aggregate then counts exactly what is below the cell, at its
edges and inside; a cell that still holds more than ``limit`` rows is divided again in the same way. Only
the values inside the last cells are shuffled, grouped by value before, and ranked. Nothing depends on
how good the histogram is but the number of rows ranked: a rank that the exact counts don't place inside
its cell keeps the wider cell of the round before. Every column and probability shares each pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

CELLS = 128
ACCURACY = 1000  # of the histogram: ranks within n / ACCURACY, an eighth of a cell
LIMIT = 100_000
ROUNDS = 6


def _written(df: DataFrame, keys: list[str]) -> DataFrame:
    """A small table that several passes read, with one row for each group; without groups, the row itself."""
    if not keys:
        return df.sparkSession.createDataFrame([df.first()], df.schema)
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/quantiles-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grid(c: Column) -> Column:
    return F.percentile_approx(c, [i / CELLS for i in range(CELLS + 1)], ACCURACY)


def _edge(grid: str, part: Column, step: int) -> Column:
    """The grid's value a cell or more before (step -1) or after (+1) the place ``part`` (0 to 1); null
    beyond the grid's ends."""
    at = F.floor(part * CELLS) - 1 if step < 0 else F.floor(part * CELLS) + 2
    return F.when((at > 0) & (at < CELLS), F.get(grid, at.cast("int")))


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], by: Sequence[str] = (), limit: int = LIMIT) -> DataFrame:
    """One row for each group (one row without groups) with the columns of ``by`` and, for each column c of
    ``wanted``, ``c``: array of its quantiles (double, linear interpolation at (n - 1) * p, as ``percentile``),
    and ``c__n``: how many values it has. Null values are left out; a group or column without any has null
    quantiles; null group keys are a group. Reads ``df`` three times, and twice more for each division; the
    first passes run when this is called, and write the table of cells (a row for each group).
    """
    targets = [(f"t{i}", f"x{k}", p) for i, (k, p) in enumerate((k, p) for k, ps in enumerate(wanted.values()) for p in ps)]
    inner = [t for t in targets if 0 < t[2] < 1]
    columns = [f"x{k}" for k in range(len(wanted))]
    keys = [f"g{k}" for k in range(len(by))]  # as text, so that null keys join too
    rows = df.select(*[F.to_json(F.struct(F.col(b).alias("v"))).alias(g) for g, b in zip(keys, by, strict=True)],
                     *[F.col(b).alias(f"{g}_by") for g, b in zip(keys, by, strict=True)],
                     *[F.col(c).cast("double").alias(x) for x, c in zip(columns, wanted, strict=True)])
    cells = rows.groupBy(*keys).agg(*[F.any_value(f"{g}_by").alias(f"{g}_by") for g in keys], *[F.count(x).alias(f"{x}_n") for x in columns],
                                    *[F.min(x).alias(f"{x}_min") for x in columns], *[F.max(x).alias(f"{x}_max") for x in columns],
                                    *[_grid(F.col(x)).alias(f"{x}_grid") for x in columns if any(t[1] == x for t in inner)])
    rows = rows.drop(*[f"{g}_by" for g in keys])
    for t, x, p in inner:
        place = (F.col(f"{x}_n") - 1) * F.lit(float(p))
        part = F.try_divide(place, F.col(f"{x}_n"))
        cells = cells.withColumns({f"{t}_r": F.floor(place).cast("long"), f"{t}_s": F.ceil(place).cast("long"),
                                   f"{t}_lo": _edge(f"{x}_grid", part, -1), f"{t}_hi": _edge(f"{x}_grid", part, 1)})
    cells = _counted(rows, _written(cells.drop(*[f"{x}_grid" for x in columns]), keys), keys, inner)
    for _ in range(ROUNDS if inner else 0):
        if cells.where(F.greatest(F.lit(0), *[F.when(_needed(t), F.col(f"{t}_in")) for t, _, _ in inner]) > limit).isEmpty():
            break
        cells = _divided(rows, cells, keys, inner, limit)
    found = _attached(cells, _picked(rows, cells, keys, inner), keys, "left") if inner else cells

    def value(t: str, rank: str) -> Column:
        upto = F.col(f"{t}_below") + F.col(f"{t}_at_lo")
        return (F.when(F.col(f"{t}_{rank}") < upto, F.col(f"{t}_lo")).when(F.col(f"{t}_{rank}") < upto + F.col(f"{t}_in"), F.col(f"{t}_{rank}_v"))
                .otherwise(F.col(f"{t}_hi")))

    out = []
    for c, column in zip(wanted, columns, strict=True):
        quantiles = []
        for t, x, p in (t for t in targets if t[1] == column):
            if p in (0, 1):
                quantiles.append(F.col(f"{x}_max" if p else f"{x}_min"))
                continue
            place = (F.col(f"{x}_n") - 1) * F.lit(float(p))
            lo, hi = value(t, "r"), value(t, "s")
            quantiles.append(lo + (place - F.floor(place)) * (hi - lo))
        out += [F.when(F.col(f"{column}_n") > 0, F.array(*quantiles)).alias(c), F.col(f"{column}_n").alias(f"{c}__n")]
    return found.select(*[F.col(f"{g}_by").alias(b) for g, b in zip(keys, by, strict=True)], *out)


def _attached(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``small`` has one row for each group: joined, or, without groups, its one row as literals."""
    if keys:
        return rows.join(small, keys, how)
    row = small.first()
    return rows.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in small.schema.fields})


def _needed(t: str) -> Column:
    """A rank of the target is inside its cell, not at an edge."""
    begin = F.col(f"{t}_below") + F.col(f"{t}_at_lo")
    inside = [(F.col(f"{t}_{r}") >= begin) & (F.col(f"{t}_{r}") < begin + F.col(f"{t}_in")) for r in "rs"]
    return inside[0] | inside[1]


def _inside(t: str, x: str) -> Column:
    """The value lies between the edges of the target's cell; a missing edge is no bound."""
    return (F.col(f"{t}_lo").isNull() | (F.col(x) > F.col(f"{t}_lo"))) & (F.col(f"{t}_hi").isNull() | (F.col(x) < F.col(f"{t}_hi")))


def _with_cells(rows: DataFrame, cells: DataFrame, keys: list[str], inner: list[tuple], more: Sequence[str] = ()) -> DataFrame:
    return _attached(rows, cells.select(*keys, *[f"{t}_{e}" for t, _, _ in inner for e in ("lo", "hi", *more)]), keys)


def _counted(rows: DataFrame, cells: DataFrame, keys: list[str], inner: list[tuple]) -> DataFrame:
    """With the exact counts of each target: below its cell, at the lower edge, inside."""
    if not inner:
        return cells
    counts = []
    for t, x, _ in inner:
        lo, v = F.col(f"{t}_lo"), F.col(x)
        counts += [F.count_if(lo.isNotNull() & (v < lo)).alias(f"{t}_below"), F.count_if(v == lo).alias(f"{t}_at_lo"),
                   F.count_if(v.isNotNull() & _inside(t, x)).alias(f"{t}_in"),
                   F.count_if(v == F.col(f"{t}_hi")).alias(f"{t}_at_hi")]
    counted = _attached(cells, _with_cells(rows, cells, keys, inner).groupBy(*keys).agg(*counts), keys)
    for t, x, _ in inner:  # ranks that aren't in the cell: the whole column is the cell
        end = F.col(f"{t}_below") + F.col(f"{t}_at_lo") + F.col(f"{t}_in") + F.when(F.col(f"{t}_lo") == F.col(f"{t}_hi"), 0).otherwise(F.col(f"{t}_at_hi"))
        good = (F.col(f"{t}_r") >= F.col(f"{t}_below")) & (F.col(f"{t}_s") < end) | (F.col(f"{x}_n") == 0)
        counted = counted.withColumn("_good", good).withColumns({
            f"{t}_in": F.when(F.col("_good"), F.col(f"{t}_in")).otherwise(F.col(f"{x}_n")),
            f"{t}_below": F.when(F.col("_good"), F.col(f"{t}_below")).otherwise(0), f"{t}_at_lo": F.when(F.col("_good"), F.col(f"{t}_at_lo")).otherwise(0),
            f"{t}_lo": F.when(F.col("_good"), F.col(f"{t}_lo")), f"{t}_hi": F.when(F.col("_good"), F.col(f"{t}_hi"))}).drop("_good", f"{t}_at_hi")
    return _written(counted, keys)


def _divided(rows: DataFrame, cells: DataFrame, keys: list[str], inner: list[tuple], limit: int) -> DataFrame:
    """Cells with more than ``limit`` rows inside cut to the part that holds their ranks."""
    grids = _with_cells(rows, cells, keys, inner, ["in"]).groupBy(*keys).agg(*[
        _grid(F.when(_inside(t, x) & (F.col(f"{t}_in") > limit), F.col(x))).alias(f"{t}_grid") for t, x, _ in inner])
    cut = _attached(cells, grids, keys)
    for t, _, _ in inner:
        held = F.col(f"{t}_in")
        # ranks at an edge leave that edge where it is
        part_r, part_s = (F.try_divide(F.least(F.greatest(F.col(f"{t}_{r}") - F.col(f"{t}_below") - F.col(f"{t}_at_lo"), F.lit(0)), held - 1), held)
                          for r in "rs")
        big = (held > limit) & _needed(t)
        cut = cut.withColumns({f"{t}_lo": F.when(big, F.coalesce(_edge(f"{t}_grid", part_r, -1), F.col(f"{t}_lo"))).otherwise(F.col(f"{t}_lo")),
                               f"{t}_hi": F.when(big, F.coalesce(_edge(f"{t}_grid", part_s, 1), F.col(f"{t}_hi"))).otherwise(F.col(f"{t}_hi"))})
    cut = cut.drop(*[f"{t}_{e}" for t, _, _ in inner for e in ("grid", "below", "at_lo", "in")])
    return _counted(rows, _written(cut, keys), keys, inner)


def _picked(rows: DataFrame, cells: DataFrame, keys: list[str], inner: list[tuple]) -> DataFrame:
    """For each target the values at its two ranks, where they are inside the cell."""
    candidates = []
    for i, (t, x, _) in enumerate(inner):
        begin = F.col(f"{t}_below") + F.col(f"{t}_at_lo")
        candidates.append(F.when(F.col(x).isNotNull() & _inside(t, x) & _needed(t), F.struct(
            F.lit(i).alias("t"), (F.col(f"{t}_r") - begin).alias("r"), (F.col(f"{t}_s") - begin).alias("s"), F.col(x).alias("v"))))
    held = _with_cells(rows, cells, keys, inner, ["below", "at_lo", "in", "r", "s"])
    values = (held.select(*keys, F.explode(F.array_compact(F.array(*candidates))).alias("c")).groupBy(*keys, "c.t", "c.r", "c.s", "c.v")
              .agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("n").over(Window.partitionBy(*keys, "t").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = values.withColumn("upto", upto)
    return ranked.groupBy(*keys).agg(*[
        F.max(F.when((F.col("t") == i) & (F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("n") <= F.col(rank)), F.col("v"))).alias(f"{t}_{rank}_v")
        for i, (t, _, _) in enumerate(inner) for rank in "rs"])
