"""Projections, filters and predicates.

Filters are written on raw columns with pushable predicates (comparisons, IN, IS NULL,
StartsWith) so Catalyst can hand them to the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import as_list, col_of


def clean_charges(df: DataFrame, qty: str = "cantidad", price: str = "precio", sub: str = "subtotal") -> DataFrame:
    """cast to double (bad text -> null), drop nulls, keep rows with qty, price, subtotal > 0."""
    out = df
    for c in (qty, price, sub):
        out = out.withColumn(c, F.col(c).try_cast("double"))
    return out.na.drop(subset=[qty, price, sub]).filter((F.col(qty) > 0) & (F.col(price) > 0) & (F.col(sub) > 0))


def clean_selected(df: DataFrame, cols: Sequence[str], positive: Sequence[str] = ()) -> DataFrame:
    """project ``cols``, drop any row with a null among them, keep ``positive`` > 0."""
    out = df.select(*cols).na.drop()
    for c in positive:
        out = out.filter(F.col(c) > 0)
    return out


def cleaning_report(df: DataFrame, valid: Column) -> DataFrame:
    """initial, valid, removed rows and the removal rate %, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("iniciales"), F.count_if(valid).alias("validos")).select(
        "iniciales", "validos", (F.col("iniciales") - F.col("validos")).alias("eliminados"),
        F.coalesce(F.round(F.try_divide((F.col("iniciales") - F.col("validos")) * 100.0, F.col("iniciales")), 2),
                   F.lit(0.0)).alias("tasa_eliminacion"),
    )


def derive_finance(df: DataFrame, date_col: str = "fecha", qty: str = "cantidad", price: str = "precio",
                   sub: str = "subtotal") -> DataFrame:
    """month, year, margin = subtotal/price, unit price = subtotal/qty (zero -> null)."""
    return (
        df.withColumn("mes", F.month(date_col))
        .withColumn("anio", F.year(date_col))
        .withColumn("margen", F.try_divide(F.col(sub), F.col(price)))
        .withColumn("precio_unitario", F.try_divide(F.col(sub), F.col(qty)))
    )


# Price-band cut points and labels.
PRICE_CUTS = (100.0, 300.0)
PRICE_LABELS = ("Bajo", "Medio", "Alto")


def band(c, cuts: Sequence[float] = PRICE_CUTS, labels: Sequence[str] = PRICE_LABELS) -> Column:
    """label by half-open bands: < cuts[0] -> labels[0], ..., else labels[-1]; null -> null."""
    x = col_of(c)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for cut, lab in zip(cuts, labels):
        out = out.when(x < cut, F.lit(lab))
    return out.otherwise(F.lit(labels[-1]))


# Amount distribution bands [0,100) [100,500) [500,1000) [1000,inf).
AMOUNT_BANDS = ((0.0, 100.0, "0-100"), (100.0, 500.0, "100-500"), (500.0, 1000.0, "500-1000"), (1000.0, None, "1000+"))


def amount_distribution(df: DataFrame, c: str = "subtotal", bands=AMOUNT_BANDS) -> DataFrame:
    """rows per half-open amount band, one aggregate, long output."""
    aggs = []
    for lo, hi, name in bands:
        cond = F.col(c) >= lo
        if hi is not None:
            cond = cond & (F.col(c) < hi)
        aggs.append(F.count_if(cond).alias(name))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}`" for _, _, n in bands)
    return wide.selectExpr(f"stack({len(bands)}, {stack}) AS (rango, n)")


# Vital-sign normal ranges (low, high); None = unbounded side.
VITAL_RANGES = {"fc": (60.0, 100.0), "fr": (12.0, 20.0), "temp": (36.1, 37.2), "spo2": (95.0, None)}


def out_of_range(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]] = VITAL_RANGES) -> DataFrame:
    """rows with any reading outside its range. A null reading is unknown; the row is
    kept when any known side is out."""
    cond = F.lit(False)
    for c, (lo, hi) in ranges.items():
        v = F.col(c).try_cast("double")
        if lo is not None:
            cond = cond | F.coalesce(v < lo, F.lit(False))
        if hi is not None:
            cond = cond | F.coalesce(v > hi, F.lit(False))
    return df.filter(cond)


def status_is(c, value: str) -> Column:
    """F8: case- and blank-insensitive exact match (a literal compare, not a regex)."""
    return F.upper(F.trim(col_of(c))) == value.upper().strip()


def search(df: DataFrame, cols: Sequence[str], q: str, key: str, n: int = 5) -> DataFrame:
    """literal case-insensitive contains over several columns, first ``n`` by key."""
    needle = q.lower()
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False))
    return df.filter(cond).orderBy(F.asc(key)).limit(n)


def period_filter(df: DataFrame, date_col: str, start: str, end: str, col: str | None = None,
                  excluded: Sequence[str] = ()) -> DataFrame:
    """half-open [start, end] day range (end day included) and NOT IN that keeps nulls."""
    d = F.col(date_col)
    out = df.filter((d >= F.lit(start).cast("date")) & (d < F.date_add(F.lit(end).cast("date"), 1)))
    if col and excluded:
        out = out.filter(F.col(col).isNull() | ~F.col(col).isin(list(excluded)))
    return out


def in_or_blank(c, values: Sequence[str]) -> Column:
    """value in list, or null, or empty."""
    x = col_of(c)
    return x.isin(list(values)) | x.isNull() | (x == "")


def available_or(df: DataFrame, flag: str, key: str, current=None) -> DataFrame:
    """free resources (flag = 0) plus the one currently held; ``current=None`` holds none."""
    cond = F.coalesce(F.col(flag), F.lit(0)) == 0
    if current is not None:
        cond = cond | (F.col(key) == F.lit(current))
    return df.filter(cond)


def overdue(df: DataFrame, status: str, date_col: str, as_of: str, days: int = 7,
            pending: str = "PENDIENTE") -> DataFrame:
    """pending rows more than ``days`` days old at ``as_of``."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date(F.col(date_col)))
    return df.filter(status_is(status, pending) & (age > days)).withColumn("dias", age)


def stock_risk(stock, sales, hi_stock: float = 10, hi_sales: float = 100, mid_stock: float = 15) -> Column:
    """stock < 10 and sales > 100 -> Alto; stock < 15 -> Medio; else Bajo."""
    s, v = col_of(stock), col_of(sales)
    return F.when((s < hi_stock) & (v > hi_sales), "Alto").when(s < mid_stock, "Medio").otherwise("Bajo")


def impute_median(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    """nulls -> exact column median. ``method="exact"``: Spark's ``percentile`` (one
    scalar subquery for all columns); ``method="rank"``: selection, one set of passes for all
    columns, run when this is called."""
    if method == "rank":
        from .quantiles import exact_quantiles

        found = exact_quantiles(df, {c: [0.5] for c in cols}).first()
        meds = {c: F.lit(found[c] and found[c][0]).cast("double") for c in cols}
    else:
        med = df.agg(F.struct(*[F.percentile(c, 0.5).alias(c) for c in cols])).scalar()
        meds = {c: med[c] for c in cols}
    out = df
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), meds[c]))
    return out


def label_by(df: DataFrame, c: str, threshold: float | str = "median", name: str = "etiqueta",
             method: str = "exact") -> DataFrame:
    """F16: binary label: ``c >= median`` (exact; ``method="rank"`` by selection), or
    ``c > threshold`` for a fixed number."""
    if threshold == "median":
        if method == "rank":
            from .quantiles import exact_quantiles

            q = exact_quantiles(df, {c: [0.5]}).first()[c]
            m = F.lit(q and q[0]).cast("double")
        else:
            m = df.select(F.percentile(c, 0.5)).scalar()
        return df.withColumn(name, F.when(F.col(c) >= m, 1).otherwise(0))
    return df.withColumn(name, F.when(F.col(c) > F.lit(threshold), 1).otherwise(0))


def drop_prefixes(df: DataFrame, c: str, prefixes: Sequence[str]) -> DataFrame:
    """drop rows whose column starts with any prefix (nulls kept)."""
    cond = F.lit(True)
    for p in prefixes:
        cond = cond & ~F.coalesce(F.col(c).startswith(p), F.lit(False))
    return df.filter(cond)


def require(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): valid rows have every required field non-blank."""
    ok = F.lit(True)
    for c in as_list(cols):
        ok = ok & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return df.filter(ok), df.filter(~ok)
