"""Array functions (T8, T9, T17, U4) with higher-order functions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of


def split_clean(c, sep: str = ",") -> Column:
    """Split, trim, drop blanks, dedupe keeping first-seen order."""
    parts = F.transform(F.split(col_of(c), sep), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def first_non_blank(arr, field: str | None = None) -> Column:
    """First element (or struct field) that is not null/blank."""
    a = col_of(arr)
    vals = F.transform(a, lambda x: x[field]) if field else a
    return F.get(F.filter(vals, lambda x: x.isNotNull() & (F.trim(x.cast("string")) != "")), 0)


def zip_items(lists: dict[str, Column | str], name_field: str | None = None) -> Column:
    """Zip parallel lists into structs by position; short lists padded with '',
    items whose name field is blank dropped. ``lists`` maps output field -> array column."""
    arrays = [(name, col_of(c)) for name, c in lists.items()]
    key = name_field or arrays[0][0]
    n = F.greatest(*[F.coalesce(F.size(a), F.lit(0)) for _, a in arrays], F.lit(0))
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    items = F.transform(
        idx,
        lambda i: F.struct(*[F.coalesce(F.try_element_at(a, i).cast("string"), F.lit("")).alias(name)
                             for name, a in arrays]),
    )
    return F.filter(items, lambda x: F.trim(x[key]) != "")
