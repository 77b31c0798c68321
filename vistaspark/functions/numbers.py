"""Numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of

IVA_RATE = "0.16"  # fixed value: tax rate


def parse_money(c, default: float | None = 0.0) -> Column:
    """Strip '$' and ',' then parse; null, NaN or garbage -> ``default``."""
    s = F.regexp_replace(col_of(c).cast("string"), r"[$,]", "")
    v = s.try_cast("double")
    v = F.when(F.isnan(v), None).otherwise(v)
    return F.coalesce(v, F.lit(default).cast("double")) if default is not None else v


def pct(num, den, digits: int = 2) -> Column:
    """round(100 * num / den, digits); zero or null denominator -> null."""
    return F.round(F.try_divide(col_of(num).cast("double"), col_of(den).cast("double")) * 100, digits)


def money(c) -> Column:
    """Money as an exact decimal so sums do not depend on row order."""
    return col_of(c).cast("decimal(18,2)")


def with_iva(sub, rate: str = IVA_RATE) -> tuple[Column, Column]:
    """(iva, total) in decimal arithmetic, rounded to cents. ``sub`` is a decimal column."""
    s = col_of(sub)
    iva = F.round(s * F.lit(rate).cast("decimal(4,2)"), 2).cast("decimal(38,2)")
    return iva, (s + iva).cast("decimal(38,2)")
