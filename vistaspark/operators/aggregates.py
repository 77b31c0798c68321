"""Aggregations.

All of them are hash aggregates with a partial (map-side) step, so a key that holds a third
of the rows is pre-combined in every task before the shuffle. Whole-table numbers that feed a
second pass (totals, quartiles, min/max) are scalar subqueries, never a window without
PARTITION BY and never a cross join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pct
from ..functions.text import OCULAR_KEYWORDS, contains_any, fold, fold_word, parse_bp
from ._common import as_list, col_of, money_sum, r6
from .quantiles import exact_quantiles


# ---------------------------------------------------------------- A1-A3 finance aggregates
def revenue_by(df: DataFrame, key, amount: str = "subtotal") -> DataFrame:
    """Count, exact sum, mean, max, min of ``amount`` per key."""
    keys = as_list(key)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_registros"),
        money_sum(amount).alias("total"),
        r6(F.avg(amount)).alias("promedio"),
        F.max(amount).alias("maximo"),
        F.min(amount).alias("minimo"),
    )


def top_by_sum(df: DataFrame, key, amount: str = "subtotal", k: int = 10) -> DataFrame:
    """A2: k groups with the largest exact sum (ties by key). A distributed top-k."""
    keys = as_list(key)
    return (
        df.groupBy(*keys).agg(money_sum(amount).alias("total"), F.count(F.lit(1)).alias("n_registros"))
        .orderBy(F.desc("total"), *[F.asc(k_) for k_ in keys])
        .limit(k)
    )


def global_stats(df: DataFrame, c: str = "subtotal") -> DataFrame:
    """A3: mean, sample std, exact sum and count in one pass; empty input -> zeros."""
    return df.agg(
        F.coalesce(r6(F.avg(c)), F.lit(0.0)).alias("media"),
        F.coalesce(r6(F.stddev_samp(c)), F.lit(0.0)).alias("desviacion"),
        F.coalesce(money_sum(c), F.lit(0).cast("decimal(38,2)")).alias("total"),
        F.count(c).alias("n"),
    )


def profile_table(df: DataFrame, name: str, category: str, price: str | None = None) -> DataFrame:
    """A4 for one table: rows, distinct values and their sorted list, price min/max.

    ``category`` must be a low-cardinality column (a status, a type): its distinct values
    are listed in the single output row.
    """
    p = col_of(price) if price else F.lit(None).cast("double")
    return df.agg(
        F.lit(name).alias("tabla"),
        F.count(F.lit(1)).alias("filas"),
        F.count_distinct(category).alias("distintos"),
        F.array_join(F.array_sort(F.collect_set(category)), ",").alias("valores"),
        F.min(p).alias("precio_min"),
        F.max(p).alias("precio_max"),
    )


def profile_tables(specs: Sequence[tuple[DataFrame, str, str, str | None]]) -> DataFrame:
    """A4: one profile row per (df, name, category, price) spec, stacked."""
    out = None
    for df, name, cat, price in specs:
        one = profile_table(df, name, cat, price)
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- A5-A16 grouped counts
def count_where(df: DataFrame, key, conds: Mapping[str, Column]) -> DataFrame:
    """A5: conditional counts per group, all in one aggregate."""
    return df.groupBy(*as_list(key)).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conds.items()]
    )


def repeats(df: DataFrame, key, c: str) -> DataFrame:
    """Rows, distinct values and repeats = rows - distinct (null values count as repeats)."""
    return (
        df.groupBy(*as_list(key))
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("distintos"))
        .withColumn("repetidos", F.col("n") - F.col("distintos"))
    )


def open_account_totals(att: DataFrame, charges: DataFrame, key: str = "id_atencion",
                        status: str = "status", open_value: str = "ABIERTA",
                        amount: str = "subtotal") -> DataFrame:
    """Exact charge total per open attention (0 when it has no charge).

    Charges are aggregated per attention *before* the join, so the join never fans out.
    """
    totals = charges.groupBy(key).agg(money_sum(amount).alias("total_cuenta"))
    open_att = att.filter(F.col(status) == open_value)
    return open_att.join(totals, key, "left").withColumn(
        "total_cuenta", F.coalesce("total_cuenta", F.lit(0).cast("decimal(38,2)"))
    )


def product_totals(df: DataFrame, product: str, qty: str, price: str) -> DataFrame:
    """Per product: quantity, mean price, rows, revenue sum(price * qty)."""
    return df.groupBy(product).agg(
        F.sum(qty).alias("cantidad_total"),
        r6(F.avg(price)).alias("precio_promedio"),
        F.count(F.lit(1)).alias("n_ventas"),
        r6(F.sum(F.col(price) * F.col(qty))).alias("ingreso"),
    )


def rollup_status(df: DataFrame, key, status: str = "estado") -> DataFrame:
    """A10: any PENDIENTE -> PENDIENTE, else any CANCELADO -> CANCELADO, else REALIZADO."""
    s = F.upper(F.trim(F.col(status)))
    return df.groupBy(*as_list(key)).agg(
        F.when(F.bool_or(s == "PENDIENTE"), "PENDIENTE")
        .when(F.bool_or(s == "CANCELADO"), "CANCELADO")
        .otherwise("REALIZADO").alias("estado_general"),
        F.count(F.lit(1)).alias("n_detalles"),
    )


def nest_details(df: DataFrame, key, order: Sequence[str], fields: Sequence[str], as_: str = "detalles") -> DataFrame:
    """Details of each key as a deterministically ordered array of structs.

    Intended for keys with a bounded fan-out (the lines of one exam / one attention).
    """
    return df.groupBy(*as_list(key)).agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in list(order) + list(fields)]))).alias(as_)
    )


def first_values(df: DataFrame, key, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first value of each attribute per group, by an explicit order (``min_by`` of a
    struct: a partial aggregate, so a hot group is reduced map-side)."""
    return df.groupBy(*as_list(key)).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(o) for o in order])).alias("_f")
    ).select(*as_list(key), *[F.col(f"_f.{c}").alias(c) for c in cols])


def names_joined(df: DataFrame, key, name: str, order: str | None = None, sep: str = ", ") -> DataFrame:
    """The names of each group joined with ', ' in a deterministic order."""
    o = F.col(order) if order else F.col(name)
    arr = F.array_sort(F.collect_list(F.struct(o.alias("o"), F.col(name).alias("v"))))
    return df.groupBy(*as_list(key)).agg(F.array_join(F.transform(arr, lambda x: x["v"]), sep).alias("nombres"))


def pending_by_type(det: DataFrame, cat: DataFrame, key: str = "id_catalogo", exam: str = "id_atencion",
                    type_col: str = "tipo", status: str = "estado", pending: str = "PENDIENTE") -> DataFrame:
    """Distinct pending requests per catalogue type, plus the overall total row."""
    j = (det.filter(F.upper(F.trim(F.col(status))) == pending).select(key, exam)
         .join(cat.select(key, type_col), key))
    per = j.groupBy(type_col).agg(F.count_distinct(exam).alias("pendientes"))
    total = j.agg(F.lit("TOTAL").alias(type_col), F.count_distinct(exam).alias("pendientes"))
    return per.unionByName(total)


def duplicate_keys(df: DataFrame, key: str, row_id: str, fingerprint: bool = True) -> DataFrame:
    """Every row whose key occurs more than once, with the key's count.

    Counts are a partial aggregate and the offending rows come back through a join, one row
    each (a hot key never becomes one giant array). With ``fingerprint`` (for long keys such as
    whole texts) the first shuffle carries only an 8-byte hash of the key; only rows whose hash
    repeats are grouped by the key itself, so the answer stays exact (a hash collision never
    merges different keys) while unique rows never ship their key across the network.
    """
    if not fingerprint:
        dups = df.groupBy(key).agg(F.count(F.lit(1)).alias("veces")).filter("veces > 1")
        return df.select(key, row_id).join(dups, key, "inner")
    d = df.select(key, row_id, F.xxhash64(F.col(key)).alias("_h"))
    repeated = d.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_h")
    cand = d.join(repeated, "_h", "left_semi")
    dups = cand.groupBy("_h", key).agg(F.count(F.lit(1)).alias("veces")).filter("veces > 1")
    return cand.join(dups, ["_h", key], "inner").select(key, row_id, "veces")


def max_key(df: DataFrame, key: str) -> DataFrame:
    """High-water mark of a key (0 on an empty table)."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("max_id"))


# ---------------------------------------------------------------- A17-A21 clinical roll-ups
def occupancy(beds: DataFrame, area: str = "area", used: str = "ocupada", critical: float = 80.0) -> DataFrame:
    """Total / used / free / % per area plus the overall row (area = 'TOTAL')."""
    u = F.coalesce(F.col(used).cast("int"), F.lit(0)) == 1  # null flag -> free
    g = beds.rollup(area).agg(
        F.grouping(area).alias("_g"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(u).alias("ocupadas"),
    )
    return g.select(
        F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.coalesce(F.col(area), F.lit("Sin dato"))).alias(area),
        "total",
        "ocupadas",
        (F.col("total") - F.col("ocupadas")).alias("libres"),
        pct("ocupadas", "total").alias("porcentaje"),
        (pct("ocupadas", "total") > critical).alias("critica"),
    )


def demand(att: DataFrame, keys: Sequence[str] = ("especialidad", "area"), k: int = 10) -> DataFrame:
    """Top-k (specialty, area) pairs by number of attentions."""
    return att.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), *[F.asc_nulls_first(c) for c in keys]
    ).limit(k)


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))


def type_stats(df: DataFrame, key: str, amount: str = "subtotal", price: str = "precio") -> DataFrame:
    """Per type: exact sum, mean, count, mean price, sample std of price."""
    return df.groupBy(key).agg(
        money_sum(amount).alias("total"),
        r6(F.avg(amount)).alias("promedio"),
        F.count(F.lit(1)).alias("n"),
        r6(F.avg(price)).alias("precio_promedio"),
        r6(F.stddev_samp(price)).alias("precio_std"),
    )


# ---------------------------------------------------------------- A22-A32 statistics
def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair as (var_a, var_b, corr).

    Computed as covar_samp / (stddev_samp * stddev_samp) with try_divide, so a constant
    column yields null instead of an ANSI divide-by-zero. One aggregate for all pairs.
    """
    aggs = []
    for a in cols:
        for b in cols:
            c = F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
            aggs.append(r6(c).alias(f"{a}__{b}"))
    wide = df.agg(*aggs)
    n = len(cols) * len(cols)
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a in cols for b in cols)
    return wide.selectExpr(f"stack({n}, {stack}) AS (var_a, var_b, corr)")


def monthly_trend(df: DataFrame, date_col: str, n: int, as_of: str) -> DataFrame:
    """Counts for the last ``n`` calendar months up to ``as_of``; empty months -> 0."""
    spark = df.sparkSession
    end = F.trunc(F.lit(as_of).cast("date"), "month")
    months = spark.range(1).select(
        F.explode(F.sequence(F.add_months(end, -(n - 1)), end, F.expr("interval 1 month"))).alias("mes")
    )
    counts = (
        df.select(F.trunc(F.col(date_col).cast("date"), "month").alias("mes"))
        .filter((F.col("mes") >= F.add_months(end, -(n - 1))) & (F.col("mes") <= end))
        .groupBy("mes").agg(F.count(F.lit(1)).alias("n"))
    )
    return months.join(F.broadcast(counts), "mes", "left").select(
        "mes", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def share_top(df: DataFrame, key: str, n: int = 6, label_null: str = "Sin dato", other: str = "Otros") -> DataFrame:
    """Top n-1 categories by count, the rest folded into 'Otros', with % of total."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(label_null))
    counts = df.groupBy(k.alias("categoria")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("categoria")).limit(n - 1)
    total = df.select(F.count(F.lit(1))).scalar()
    top_sum = top.select(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    rest = df.sparkSession.range(1).select(F.lit(other).alias("categoria"), (total - top_sum).alias("n")).filter("n > 0")
    return top.unionByName(rest).withColumn("porcentaje", pct(F.col("n"), total))


def rank_items(df: DataFrame, item: str, match: Column, n: int = 7) -> DataFrame:
    """Top-n items among the matching rows; when no row matches, top-n of all rows.

    Both rankings are planned; the fallback branch is gated by a scalar subquery, so the
    choice is made on the executors, not by a driver-side branch.
    """
    matched = df.filter(match)
    ranked_match = matched.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(item)).limit(n)
    n_match = matched.select(F.count(F.lit(1))).scalar()
    ranked_all = (
        df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(item)).limit(n)
        .filter(n_match == 0)
    )
    return ranked_match.withColumn("coincide", F.lit(True)).unionByName(ranked_all.withColumn("coincide", F.lit(False)))


def patients_with(df: DataFrame, patient: str, text_cols: Sequence[str], words: Sequence[str] = OCULAR_KEYWORDS) -> DataFrame:
    """Distinct patients and rows with a keyword hit in any of the text columns."""
    hit = F.lit(False)
    for c in text_cols:
        hit = hit | contains_any(fold(c), [fold_word(w) for w in words])
    return df.agg(
        F.count_distinct(F.when(hit, F.col(patient))).alias("pacientes"),
        F.count_if(hit).alias("registros"),
    )


def revenue_share(df: DataFrame, key: str, amount: str = "subtotal") -> DataFrame:
    """Amount, count, % of the overall amount and mean per service, per type."""
    total = df.select(money_sum(amount)).scalar()
    return df.groupBy(key).agg(
        money_sum(amount).alias("monto"),
        F.count(F.lit(1)).alias("n"),
        r6(F.avg(amount)).alias("promedio_servicio"),
    ).withColumn("porcentaje", pct(F.col("monto"), total))


def alert_rates(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]],
                pressures: Mapping[str, tuple[tuple[float, float], tuple[float, float]]] | None = None) -> DataFrame:
    """Per vital sign: alerts (outside [lo, hi]), valid readings, alert %.

    ``pressures`` maps text columns ("120/80" anywhere, T4) to the ranges of systolic and diastolic
    pressure; a reading is valid when it parses and an alert when either side is out. All counts are one
    aggregate over the wide rows; its one row is then stacked.
    """
    counts = {}
    for name, (lo, hi) in ranges.items():
        v = F.col(name).try_cast("double")
        sides = [s for s in (v < lo if lo is not None else None, v > hi if hi is not None else None) if s is not None]
        counts[name] = (F.count_if(reduce(or_, sides, F.lit(False))), F.count(v))
    for name, ((sis_lo, sis_hi), (dia_lo, dia_hi)) in (pressures or {}).items():
        bp = parse_bp(name)
        sis, dia = bp["sistolica"], bp["diastolica"]
        counts[name] = (F.count_if((sis < sis_lo) | (sis > sis_hi) | (dia < dia_lo) | (dia > dia_hi)), F.count(sis))
    wide = df.agg(*[c.alias(f"{name}__{i}") for name, pair in counts.items() for i, c in enumerate(pair)])
    rows = ", ".join(f"'{name}', `{name}__0`, `{name}__1`" for name in counts)
    return wide.selectExpr(f"stack({len(counts)}, {rows}) AS (signo, alertas, validos)").withColumn("porcentaje", pct("alertas", "validos"))


def ranked_quantiles(df: DataFrame, c: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation (as ``percentile``), by selection
    (:func:`exact_quantiles`): one row per group with an array ``q`` (one row, no groups, when
    ``by`` is empty; null on empty input)."""
    return exact_quantiles(df, {c: probs}, by).select(*by, F.col(c).alias("q"))


def iqr_summary(df: DataFrame, c: str, k: float = 1.5, approx_accuracy: int | None = None,
                method: str = "exact") -> DataFrame:
    """Quartiles (linear interpolation), IQR, upper fence and rows above it.

    ``method="exact"``: Spark's ``percentile`` (a value -> count map merged in one task: fine
    when distinct values are bounded, e.g. money in cents). ``method="rank"``: exact by
    selection (:func:`exact_quantiles`), for unbounded value domains; its passes run when this is
    called. ``approx_accuracy``: ``percentile_approx`` with bounded memory.
    """
    probs = [0.25, 0.5, 0.75]
    if approx_accuracy is not None:
        qrow = df.agg(F.percentile_approx(c, probs, approx_accuracy).cast("array<double>").alias("q"))
    elif method == "rank":
        q = ranked_quantiles(df, c, probs).first().q
        qrow = df.sparkSession.range(1).select(F.array(*map(F.lit, q or [None] * 3)).cast("array<double>").alias("q"))
    else:
        qrow = df.agg(F.percentile(c, probs).alias("q"))
    q1, q2, q3 = F.col("q")[0], F.col("q")[1], F.col("q")[2]
    fence = q3 + F.lit(k) * (q3 - q1)
    # the quartiles are columns of the one-row frame; the fence reaches the second pass as one scalar subquery
    fence_s = qrow.select(fence).scalar()
    n = df.select(F.count(c)).scalar()
    above = df.filter(F.col(c) > fence_s).select(F.count(F.lit(1))).scalar()
    return qrow.select(
        n.alias("n"), r6(q1).alias("q1"), r6(q2).alias("mediana"), r6(q3).alias("q3"), r6(q3 - q1).alias("iqr"),
        r6(fence).alias("limite_superior"), above.alias("atipicos"),
    )


def histogram(df: DataFrame, c: str, k: int | None = None) -> DataFrame:
    """Equal-width histogram; k = clamp(int(sqrt n), 5, 10) unless given; last bin closed.

    Empty bins are filled from ``sequence(0, k-1)``. All rows have the same value -> one bin.
    """
    spark = df.sparkSession
    st = df.agg(F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("lo"),
                         F.max(c).cast("double").alias("hi"))).scalar()
    n, lo, hi = st["n"], st["lo"], st["hi"]
    kk = F.lit(k) if k else F.least(F.greatest(F.floor(F.sqrt(n)).cast("int"), F.lit(5)), F.lit(10))
    kk = F.when(hi == lo, F.lit(1)).otherwise(kk)
    width = F.try_divide(hi - lo, kk)
    b = F.when(width > 0, F.least(F.floor((F.col(c) - lo) / width).cast("int"), kk - 1)).otherwise(F.lit(0))
    counts = df.filter(F.col(c).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = spark.range(1).select(F.explode(F.sequence(F.lit(0), kk - 1)).alias("bin")).filter(n > 0)
    return bins.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        r6(lo + F.col("bin") * width).alias("desde"),
        r6(lo + (F.col("bin") + 1) * width).alias("hasta"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def box_stats(df: DataFrame, key: str, c: str, method: str = "exact") -> DataFrame:
    """Five-number summary per group (exact percentiles). ``method="rank"`` selects within
    groups (:func:`exact_quantiles`) instead of merging each group's value map in one task."""
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    if method == "rank":
        j = exact_quantiles(df, {c: probs}, by=[key]).select(key, F.col(c).alias("_q"), F.col(f"{c}__n").alias("n"))
    else:
        j = df.groupBy(key).agg(F.percentile(c, probs).alias("_q"), F.count(c).alias("n"))
    return j.select(
        key, "n",
        r6(F.col("_q")[0]).alias("minimo"), r6(F.col("_q")[1]).alias("q1"), r6(F.col("_q")[2]).alias("mediana"),
        r6(F.col("_q")[3]).alias("q3"), r6(F.col("_q")[4]).alias("maximo"),
    )


def mean_age(df: DataFrame, age: str = "edad") -> DataFrame:
    """Mean over valid (non-null) ages."""
    return df.agg(r6(F.avg(age)).alias("edad_promedio"), F.count(age).alias("n"))


def kpis(spark, metrics: Mapping[str, Column]) -> DataFrame:
    """One KPI row from named scalar subqueries (no cross join of one-row frames)."""
    return spark.range(1).select(*[v.alias(k) for k, v in metrics.items()])


def describe(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    """Count, mean, std, min, quartiles, max per column, as rows (exact quartiles;
    ``method="rank"`` takes them all from one :func:`exact_quantiles`)."""
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}__count"), r6(F.avg(c)).alias(f"{c}__mean"),
            r6(F.stddev_samp(c)).alias(f"{c}__std"), F.min(c).cast("double").alias(f"{c}__min"),
            F.max(c).cast("double").alias(f"{c}__max"),
        ] + ([] if method == "rank" else [F.percentile(c, [0.25, 0.5, 0.75]).alias(f"{c}__q")])
    wide = df.agg(*aggs)
    if method == "rank":
        q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols}).first()
        wide = wide.select("*", *[F.array(*map(F.lit, q[c] or [None] * 3)).cast("array<double>").alias(f"{c}__q") for c in cols])
    rows = ", ".join(
        f"'{c}', `{c}__count`, `{c}__mean`, `{c}__std`, `{c}__min`, round(`{c}__q`[0], 6), "
        f"round(`{c}__q`[1], 6), round(`{c}__q`[2], 6), `{c}__max`"
        for c in cols
    )
    return wide.selectExpr(
        f"stack({len(cols)}, {rows}) AS (columna, n, media, desviacion, minimo, q25, q50, q75, maximo)"
    )


def argmax_rows(df: DataFrame, cols: Sequence[str], key: str, keep: Sequence[str] = ()) -> DataFrame:
    """For each column, the row holding its maximum (ties -> smallest key)."""
    out = None
    keep = [k for k in keep if k != key]
    for c in cols:
        one = (
            df.filter(F.col(c).isNotNull())
            .orderBy(F.desc(c), F.asc(key)).limit(1)
            .select(F.lit(c).alias("columna"), F.col(c).cast("double").alias("valor"), key, *keep)
        )
        out = one if out is None else out.unionByName(one)
    return out


def top_category(df: DataFrame, c: str) -> DataFrame:
    """Most frequent value (ties -> smallest value)."""
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(c)).limit(1)


def inventory_summary(df: DataFrame, category: str, stock: str, price: str) -> DataFrame:
    """Per category and overall: rows, stock sum, stock value; categories on the total row."""
    g = df.rollup(category).agg(
        F.grouping(category).alias("_g"),
        F.count(F.lit(1)).alias("filas"),
        F.sum(stock).cast("long").alias("stock_total"),
        r6(F.sum(F.col(stock) * F.col(price))).alias("valor_total"),
        F.count_distinct(category).alias("categorias"),
    )
    return g.select(
        F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col(category)).alias(category),
        "filas", "stock_total", "valor_total", "categorias",
    )


def accounts_with_total(df: DataFrame, account: str, line: str, amount: str = "subtotal",
                        rate: str = "0.16") -> DataFrame:
    """Detail lines, a subtotal/IVA/total row per account and a grand-total row.

    ``GROUPING SETS ((account, line), (account), ())`` in one aggregate, decimal money.
    """
    s = money_sum(amount)
    g = df.rollup(account, line).agg(F.grouping_id().alias("nivel"), s.alias("subtotal"))
    iva = F.round(F.col("subtotal") * F.lit(rate).cast("decimal(4,2)"), 2).cast("decimal(38,2)")
    return g.select(
        account, line, F.col("nivel").cast("int").alias("nivel"), "subtotal",
        iva.alias("iva"), (F.col("subtotal") + iva).cast("decimal(38,2)").alias("total"),
    )
