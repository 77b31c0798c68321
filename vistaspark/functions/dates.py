"""Date functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of

# Accepted text layouts in priority order (d/m/Y is tried before m/d/Y).
TS_FORMATS: tuple[str, ...] = (
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "d/M/yyyy",
    "M/d/yyyy",
    "yyyyMMdd",
    "d-M-yyyy",
    "yyyy/M/d",
)

# Spanish month abbreviations, January first.
MONTHS_ES = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")


def parse_ts(c, formats: Sequence[str] = TS_FORMATS) -> Column:
    """T5: text -> timestamp trying each layout in order; fraction and 'Z' dropped; else null."""
    s = F.trim(F.regexp_replace(col_of(c).cast("string"), "Z", ""))
    s = F.regexp_replace(s, r"\.\d*$", "")
    # wall-clock result (timestamp_ntz): independent of the session time zone
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def age_calendar(birth, as_of, max_age: int = 120) -> Column:
    """Whole years by the calendar rule; future births or ages over ``max_age`` -> null."""
    b = F.to_date(col_of(birth))
    a = F.to_date(col_of(as_of)) if not isinstance(as_of, str) else F.lit(as_of).cast("date")
    age = (F.year(a) - F.year(b)) - F.when(
        (F.month(a) < F.month(b)) | ((F.month(a) == F.month(b)) & (F.dayofmonth(a) < F.dayofmonth(b))), 1
    ).otherwise(0)
    return F.when((age >= 0) & (age <= max_age), age)


def age_months_rule(birth, as_of) -> Column:
    """``floor(months_between(as_of, birth) / 12)`` (differs from T6a on 29 Feb)."""
    a = F.lit(as_of).cast("date") if isinstance(as_of, str) else F.to_date(col_of(as_of))
    return F.floor(F.months_between(a, F.to_date(col_of(birth))) / 12).cast("int")


def days_between(start, end) -> Column:
    """Whole days from ``start`` to ``end`` (column names or Columns); negative -> null."""
    d = F.datediff(F.to_date(col_of(end)), F.to_date(col_of(start)))
    return F.when(d >= 0, d)


def month_label(c) -> Column:
    """Date -> 'Ene 24'."""
    d = col_of(c)
    names = F.array(*[F.lit(m) for m in MONTHS_ES])
    return F.concat_ws(" ", F.element_at(names, F.month(d)), F.substring(F.year(d).cast("string"), 3, 2))


def date_display(c, empty: str = "Sin fecha") -> Column:
    """Any supported text/date -> 'dd/MM/yyyy', unparseable -> 'Sin fecha'."""
    x = col_of(c)
    return F.coalesce(F.date_format(parse_ts(x), "dd/MM/yyyy"), F.lit(empty))
