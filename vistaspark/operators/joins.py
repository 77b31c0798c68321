"""Joins (J1-J11).

Joins are by column *name* so the key is not duplicated. Right sides are aggregated or
filtered before the join so it never fans out. No broadcast is forced on tables whose size
grows with the data: Spark's size-checked broadcast (``autoBroadcastJoinThreshold`` and AQE
at runtime) chooses it, with sort-merge join beyond the threshold and AQE skew-join
splitting for hot keys. Only literal rule tables are broadcast explicitly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import as_list, col_of, money_sum


def inner(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Inner equi join (``$lookup`` + ``$unwind``)."""
    return left.join(right, as_list(on), "inner")


def left(left_df: DataFrame, right: DataFrame, on) -> DataFrame:
    """Left outer equi join by name (unmatched rows kept, key not duplicated)."""
    return left_df.join(right, as_list(on), "left")


def left_filtered(left_df: DataFrame, right: DataFrame, on, cond: Column | str) -> DataFrame:
    """Left join to a right side filtered *before* the join (sub-pipeline lookup)."""
    return left_df.join(right.filter(cond), as_list(on), "left")


def nest(left_df: DataFrame, right: DataFrame, on, as_: str = "items",
         fields: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """J4 (nesting form): matching right rows as an ordered array; no match -> empty array.

    For keys with a bounded fan-out (lines of an account). Use :func:`reduce_matches`
    for unbounded ones.
    """
    keys = as_list(on)
    cols = list(order) + [c for c in (fields or [c for c in right.columns if c not in keys]) if c not in order]
    grouped = right.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(as_))
    out = left_df.join(grouped, keys, "left")
    return out.withColumn(as_, F.coalesce(F.col(as_), F.array().cast(grouped.schema[as_].dataType)))


def reduce_matches(left_df: DataFrame, right: DataFrame, on, amount: str, prefix: str = "") -> DataFrame:
    """J4 (reducing form): size / exact sum / mean of matching rows; no match -> 0."""
    keys = as_list(on)
    agg = right.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{prefix}n"),
        money_sum(amount).alias(f"{prefix}suma"),
        F.avg(amount).alias(f"{prefix}promedio"),
    )
    out = left_df.join(agg, keys, "left")
    return out.fillna({f"{prefix}n": 0, f"{prefix}promedio": 0.0}).withColumn(
        f"{prefix}suma", F.coalesce(F.col(f"{prefix}suma"), F.lit(0).cast("decimal(38,2)"))
    )


def join_any(left_df: DataFrame, arr_col: str, right: DataFrame, key: str, left_key: str) -> DataFrame:
    """Join on an array-valued key: one output row per (left row, matched element).

    Elements are exploded (``explode_outer`` keeps rows with an empty/null array) and joined
    by equality; callers re-aggregate by ``left_key`` when they need one row back.
    """
    ex = left_df.select("*", F.explode_outer(arr_col).alias(key))
    return ex.join(right, key, "left")


def first_match(left_df: DataFrame, right: DataFrame, on, order: Sequence[str], fields: Sequence[str],
                how: str = "left") -> DataFrame:
    """Only the first matching right row per key, by an explicit order (ties impossible
    when ``order`` ends with a unique column). A partial aggregate (``min_by``), so a hot
    key is reduced map-side."""
    keys = as_list(on)
    ordering = F.struct(*[F.col(o) for o in order])
    picked = right.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f) for f in fields]), ordering).alias("_m"))
    picked = picked.select(*keys, *[F.col("_m")[f].alias(f) for f in fields])
    return left_df.join(picked, keys, how)


def orphans(child: DataFrame, parent: DataFrame, key, parent_key=None) -> DataFrame:
    """Child rows without a parent (``left_anti``)."""
    if parent_key is None or parent_key == key:
        return child.join(parent.select(*as_list(key)), as_list(key), "left_anti")
    return child.join(parent, col_of(key) == parent[parent_key], "left_anti")


def assemble(base: DataFrame, facts: Sequence[DataFrame], key, fill: Mapping[str, object] | None = None) -> DataFrame:
    """Base entity left-joined to pre-aggregated facts (one row per key each); nulls -> 0."""
    out = base
    for f in facts:
        out = out.join(f, as_list(key), "left")
    if fill:
        out = out.fillna(dict(fill))
    return out


def enrich_charges(charges: DataFrame, patients: DataFrame, atts: DataFrame,
                   att_key: str = "id_atencion", pat_key: str = "Id_exp",
                   att_cols: Sequence[str] = ("Id_exp", "status", "especialidad", "fecha_ing"),
                   pat_cols: Sequence[str] = ("nombre", "area")) -> DataFrame:
    """Charges with attention and patient attributes (two left joins on unique keys)."""
    a = atts.select(att_key, *att_cols)
    p = patients.select(pat_key, *pat_cols)
    return charges.join(a, att_key, "left").join(p, pat_key, "left")


def expand_orders(requests: DataFrame, catalog: DataFrame, req_key: str = "id_examen",
                  item: str = "id_catalogo", qty: str = "cantidad", price: str = "precio",
                  name: str = "nombre") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requested (request, item) pairs x catalogue -> detail rows, charges, header total.

    Unknown catalogue items drop (inner join), as in the reference.
    """
    det = requests.join(catalog.select(item, name, price), item, "inner").withColumn(
        "subtotal", (F.col(price).cast("decimal(18,2)") * F.coalesce(F.col(qty), F.lit(1))).cast("decimal(18,2)")
    ).withColumn("estado", F.lit("PENDIENTE"))
    charges = det.select(req_key, item, F.col(name).alias("descripcion"), qty, price, "subtotal")
    header = det.groupBy(req_key).agg(
        money_sum("subtotal").alias("subtotal_total"), F.count(F.lit(1)).alias("n_detalles")
    )
    return det, charges, header
