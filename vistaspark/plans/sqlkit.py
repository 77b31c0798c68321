"""SQL snippets shared by oracle queries (DuckDB dialect)."""

MONEY = "CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DECIMAL(38,2))"


def money(x: str) -> str:
    return MONEY.format(x=x)


def r6(x: str) -> str:
    return f"ROUND(CAST({x} AS DOUBLE), 6)"


def pct(num: str, den: str) -> str:
    return f"ROUND(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0) * 100, 2)"


def fold(x: str) -> str:
    """T1 in DuckDB: strip accents, drop non-ASCII, upper, strip whitespace."""
    return (
        "regexp_replace(upper(regexp_replace(strip_accents(COALESCE(CAST(" + x + " AS VARCHAR), ''))," 
        " '[^\\x00-\\x7F]', '', 'g')), '^\\s+|\\s+$', '', 'g')"
    )


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")" if words else "FALSE"


def rsig(x: str, digits: int = 11) -> str:
    """Twin of ``operators._common.rsig``."""
    parts = []
    for e in range(15, -4, -1):
        lim = f"{float(10 ** e)!r}" if e >= 0 else repr(10.0 ** e)
        parts.append(f"WHEN ABS(CAST({x} AS DOUBLE)) >= {lim} THEN ROUND(CAST({x} AS DOUBLE), {digits - 1 - e})")
    return "(CASE " + " ".join(parts) + f" ELSE ROUND(CAST({x} AS DOUBLE), {digits + 3}) END)"
