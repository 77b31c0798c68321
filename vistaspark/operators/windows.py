"""Window-style operators (W1-W6) and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_list, col_of, dense_index, r6


def sigma_outliers(df: DataFrame, key: str, c: str, k: float = 2.0) -> DataFrame:
    """Rows whose value lies outside mean +/- k sample std of their group.

    Per-group stats are a partial aggregate joined back by key (not a window over the
    group), so a group holding a third of the rows is still pre-combined in every task;
    the stats table has one row per group and AQE broadcasts it when small. A group of one
    row has a null std and yields no outlier.
    """
    stats = df.groupBy(key).agg(F.avg(c).alias("media"), F.stddev_samp(c).alias("desviacion"))
    j = df.join(stats, key, "inner")
    dev = F.abs(F.col(c) - F.col("media"))
    return j.filter(F.col("desviacion").isNotNull() & (dev > F.lit(k) * F.col("desviacion"))).withColumn(
        "media", r6("media")
    ).withColumn("desviacion", r6("desviacion"))


def cash_cut(payments: DataFrame, date_col: str, start: str, end: str, amount: str, key: str,
             excluded: Sequence[str] = (), method: str | None = None) -> DataFrame:
    """Payments in [start, end) (end exclusive), numbered with a running total.

    The running total is a distributed prefix sum (range partitions + per-partition
    offsets), not a single-partition window.
    """
    d = F.col(date_col)
    sel = payments.filter((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")))
    if excluded and method:
        sel = sel.filter(F.col(method).isNull() | ~F.col(method).isin(list(excluded)))
    return dense_index(sel, [date_col, key], value=amount, index_name="n", running_name="acumulado")


PAGE_ROWS, SAMPLE, SPLITTERS = 10_000, 2_000, 32


def _before(order: Sequence[tuple[str, bool]], bound: Sequence) -> Column:
    """The row comes before ``bound`` in ``order`` ((column, descending); nulls first, or last if descending)."""
    out = F.lit(False)
    for (name, desc), value in reversed(list(zip(order, bound, strict=True))):
        c = F.col(name)
        b = F.lit(value)
        if desc:
            first = c.isNotNull() if value is None else F.coalesce(c > b, F.lit(False))
        else:
            first = F.lit(False) if value is None else c.isNull() | (c < b)
        out = first | (c.eqNullSafe(b) & out)
    return out


def _range_of(df: DataFrame, order: Sequence[tuple[str, bool]], total: int, begin: int, end: int) -> tuple[DataFrame, int]:
    """(a range of rows that holds those from ``begin`` to ``end`` of the order, how many come before it).

    Splitters are drawn from a sample of the order's columns and the rows before each are counted by one
    partial aggregate; the range between the two that hold the page is divided again until it has
    at most PAGE_ROWS rows (or a page's). The sample decides how fast that is, never which rows are found."""
    names = [c for c, _ in order]
    part, before, rows = df, 0, total
    while rows > max(PAGE_ROWS, 2 * (end - begin)):
        drawn = part.select(*names).sample(min(1.0, SAMPLE / rows), seed=before).orderBy(*[F.desc(c) if d else F.asc(c) for c, d in order]).collect()
        splitters = [drawn[i * len(drawn) // (SPLITTERS + 1)] for i in range(1, SPLITTERS + 1)] if drawn else []
        if not splitters:
            break
        counts = part.agg(*[F.count_if(_before(order, s)) for s in splitters]).first()
        lo = max((i for i, n in enumerate(counts) if before + n <= begin), default=None)
        hi = min((i for i, n in enumerate(counts) if before + n >= end), default=None)
        first, last = 0 if lo is None else counts[lo], rows if hi is None else counts[hi]
        if last - first >= rows:
            break
        if lo is not None:
            part = part.filter(~_before(order, splitters[lo]))
        if hi is not None:
            part = part.filter(_before(order, splitters[hi]))
        before, rows = before + first, last - first
    return part, before


def page(df: DataFrame, order: Sequence[str], key: str, page_no: int, size: int) -> DataFrame:
    """One page of a totally ordered list, with total rows and page count.

    ``order``: column names, descending with a leading "-"; ``key`` is unique and breaks ties. The page is
    sought by rank (:func:`_range_of`), so a deep page sorts one range of some thousand rows and not
    all rows before it; the passes that find it run when this is called."""
    by = [(c.removeprefix("-"), c.startswith("-")) for c in [*order, key]]
    total = df.count()
    begin = (page_no - 1) * size
    part, before = _range_of(df, by, total, begin, min(begin + size, total))
    ordered = part.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in by]).offset(begin - before).limit(size)
    return ordered.withColumn("total_filas", F.lit(total).cast("long")).withColumn("paginas", F.lit(-(-total // size)).cast("long"))


def latest(df: DataFrame, ts: str, key: str, n: int = 1, group=None) -> DataFrame:
    """Newest ``n`` rows overall, or per group.

    Per group it is ``row_number() <= n``; Spark plans that with a WindowGroupLimit that
    keeps only ``n`` rows per group in every task *before* the shuffle, so a hot group
    costs no more than ``n`` rows per task.
    """
    if group is None:
        return df.orderBy(F.desc(ts), F.desc(key)).limit(n)
    w = Window.partitionBy(*as_list(group)).orderBy(F.desc(ts), F.desc(key))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def minmax(df: DataFrame, cols: Sequence[str], suffix: str = "_esc") -> DataFrame:
    """Scale columns to [0, 1] with whole-table min/max from one scalar subquery;
    a constant column scales to 0."""
    st = df.agg(F.struct(*[x for c in cols for x in (F.min(c).cast("double").alias(f"{c}_min"),
                                                      F.max(c).cast("double").alias(f"{c}_max"))])).scalar()
    out = df
    for c in cols:
        lo, hi = st[f"{c}_min"], st[f"{c}_max"]
        out = out.withColumn(c + suffix, r6(F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))))
    return out


# ---------------------------------------------------------------- sets
def missing_ids(a: DataFrame, b: DataFrame, key: str, b_key: str | None = None) -> DataFrame:
    """Distinct ids of ``a`` absent from ``b`` (anti join; nulls never match)."""
    ids = a.select(key).filter(F.col(key).isNotNull()).distinct()
    bk = b.select(F.col(b_key or key).alias(key))
    return ids.join(bk, key, "left_anti")


def distinct_ids(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-null ids."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct()


def stack_sections(sections: dict[str, DataFrame], label: str = "seccion") -> DataFrame:
    """Union differently built sections by name, tagged with their section."""
    out = None
    for name, df in sections.items():
        one = df.withColumn(label, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
