"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed base rules need no corpus. The method's own rules replace fixed cutoffs: every metric of the
documents that pass the base rules is counted in a mergeable quantile sketch for each language and
source (a histogram whose cells keep five bits after the leading one, so a quantile is off by at
most 1/32; sketches merge by adding counts, without any randomness). A group with too few rows uses
its language's merged sketch, then the corpus's. The thresholds follow from quantiles on the lower
half of a metric, which junk that fills less than half of a group does not move; the documents
join them on language and source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import materialise, table, text_or_empty

SEP = r"\\x20\\x09-\\x0D"
LEAST_ROWS = 100


@dataclass(frozen=True)
class Rule:
    """``metric`` may exceed its group's median by ``factor`` times (median - lower quartile), and
    by ``slack`` at least; with ``below`` also fall short of it as far."""

    metric: str
    factor: int
    slack: int
    below: bool = False


#: Shares are in thousandths; word_length is in hundredths of a character.
RULES = (Rule("symbol_share", 8, 20), Rule("dup_line_share", 8, 500), Rule("repeat_share", 8, 450),
         Rule("word_length", 16, 200, below=True))


#: Names that features and judge add; "text" is left out too.
ADDED = {"text", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "_w", "_t", "_l", "_h", "_3",
         "_s", "_r", "_lang", "_source", *(f"{p}{r.metric}" for r in RULES for p in ("", "lo_", "hi_"))}


def features(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and
    n_repeat_words (long).

    Three-word windows are compared by 64-bit hashes; the windows of a text are sorted once to find
    the repeated ones, so long texts cost n log n. Columns of ``docs`` that have an added name, or one
    that ``judge`` adds, are left out."""
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    d = docs.select(*keep, F.expr(f"filter(split(coalesce(text, ''), '[{SEP}]+'), w -> w <> '')").alias("_w"),
                    text_or_empty().alias("_t"))
    d = d.select(
        *keep, F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - F.length(F.regexp_replace("_t", f"[^{SEP}]+".replace("\\\\", "\\"), ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.expr(rf"filter(split(_t, '\n'), l -> l rlike '[^{SEP}]')").alias("_l"),
        F.expr("transform(_w, w -> xxhash64(w))").alias("_h"))
    base = [*keep, "n_words", "word_chars", "n_symbols"]
    d = d.select(*base, F.size("_l").cast("long").alias("n_lines"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                 F.expr("if(n_words < 3, cast(array() as array<bigint>), "
                        "transform(slice(_h, 1, n_words - 2), (x, i) -> xxhash64(x, _h[i + 1], _h[i + 2])))").alias("_3"))
    base += ["n_lines", "n_dup_lines"]
    d = d.select(*base, F.expr("if(size(array_distinct(_3)) = size(_3), null, "
                               "sort_array(transform(_3, (x, i) -> struct(x as x, i as i))))").alias("_s"))
    d = d.select(*base, F.expr("filter(transform(_s, (p, k) -> if(p.x = get(_s, k - 1).x or p.x = get(_s, k + 1).x, p.i, null)), "
                               "i -> i is not null)").alias("_r"))
    return d.select(*base, F.expr("coalesce(size(array_distinct(flatten(transform(_r, i -> array(i, i + 1, i + 2))))), 0)")
                    .cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def metrics() -> dict[str, Column]:
    """Integer metrics of documents with words."""
    share = lambda a, b: F.expr(f"1000 * {a} div greatest({b}, 1)")
    return {"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "word_length": F.expr("100 * word_chars div greatest(n_words, 1)")}


def _cell(v: str) -> str:
    return f"if({v} < 32, {v}, shiftleft(shiftright({v}, length(bin({v})) - 6), length(bin({v})) - 6))"


def sketches(rows: DataFrame, names: list[str]) -> DataFrame:
    """(lang, source, metric, ...) rows -> sketch cells at three levels: 0 language and source, 1
    language, 3 all: (level, lang, source, metric, cell, c). Counts combine map-side."""
    stacked = ", ".join(f"'{m}', {m}" for m in names)
    cells = (rows.selectExpr("lang", "source", f"stack({len(names)}, {stacked}) as (metric, v)")
             .withColumn("cell", F.expr(_cell("v"))).groupBy("lang", "source", "metric", "cell").agg(F.count("*").alias("c")))
    merged = [cells.select(F.lit(0).alias("level"), "lang", "source", "metric", "cell", "c"),
              cells.groupBy("lang", "metric", "cell").agg(F.sum("c").alias("c"))
              .select(F.lit(1), "lang", F.lit(None).cast("string"), "metric", "cell", "c"),
              cells.groupBy("metric", "cell").agg(F.sum("c").alias("c"))
              .select(F.lit(3), F.lit(None).cast("string"), F.lit(None).cast("string"), "metric", "cell", "c")]
    return merged[0].union(merged[1]).union(merged[2])


def quantiles(cells: DataFrame) -> DataFrame:
    """(level, lang, source, metric, n, q25, q50, q75): the least cell that reaches the quantile.
    A group has a few hundred cells at most."""
    upto = F.expr("sum(c) over (partition by level, lang, source, metric order by cell)")
    total = F.expr("sum(c) over (partition by level, lang, source, metric)")
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("n"), F.col("cell")))
    return (cells.withColumns({"upto": upto, "n": total}).groupBy("level", "lang", "source", "metric")
            .agg(F.first("n").alias("n"), at(25).alias("q25"), at(50).alias("q50"), at(75).alias("q75")))


def thresholds(cells: DataFrame, rules: tuple[Rule, ...] = RULES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, lo_<metric>, hi_<metric>): from the most specific sketch with enough rows."""
    q = quantiles(cells)
    own = q.where("level = 0").select("lang", "source", "metric", "n", "q25", "q50", "q75")
    by_lang = q.where("level = 1").select(F.col("lang").alias("_lang"), F.col("metric").alias("_metric"), F.col("n").alias("n1"),
                                          *[F.col(f"q{p}").alias(f"l{p}") for p in (25, 50, 75)])
    overall = q.where("level = 3").select("metric", *[F.col(f"q{p}").alias(f"a{p}") for p in (25, 50, 75)])
    picked = own.join(by_lang, own["lang"].eqNullSafe(by_lang["_lang"]) & (own["metric"] == by_lang["_metric"])).join(overall, "metric")
    for p in (25, 50, 75):
        picked = picked.withColumn(f"t{p}", F.when(F.col("n") >= least_rows, F.col(f"q{p}"))
                                   .when(F.col("n1") >= least_rows, F.col(f"l{p}")).otherwise(F.col(f"a{p}")))
    out = []
    for r in rules:
        of = F.col("metric") == r.metric
        out.append(F.max(F.when(of, F.col("t50") + F.greatest(r.factor * (F.col("t50") - F.col("t25")), F.lit(r.slack)))).alias(f"hi_{r.metric}"))
        out.append(F.max(F.when(of & F.lit(r.below), F.col("t50") - F.greatest(r.factor * (F.col("t75") - F.col("t50")), F.lit(r.slack)))).alias(f"lo_{r.metric}"))
    return picked.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``docs`` (text, lang, source, ...) without text, with the feature columns, base_failed and kept.

    One row for each row. Null and empty texts have no words and fail the base rules. Null lang or
    source are groups of their own. An empty table gives no rows. Columns with an added name are left out
    (``keep_good`` returns all of a row's own columns).
    """
    named = features(docs).withColumn("base_failed", base_failed()).withColumns(metrics())
    rows = materialise(named, "quality")
    names = [r.metric for r in rules]
    limits = thresholds(sketches(rows.where("not base_failed"), names), rules, least_rows)
    # written, so that the join below knows its size: broadcast if small, else a skew-aware shuffle
    limits = materialise(limits.withColumnsRenamed({"lang": "_lang", "source": "_source"}), "limits")
    joined = rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"]), "left")
    fine = ~F.col("base_failed")
    for r in rules:
        fine = fine & (F.col(r.metric) <= F.col(f"hi_{r.metric}"))
        if r.below:
            fine = fine & (F.col(r.metric) >= F.col(f"lo_{r.metric}"))
    return joined.withColumn("kept", F.coalesce(fine, F.lit(False)))


BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def keep_good(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` (text, lang, source, ...) that are kept, with all their columns."""
    packed = docs.select("text", "lang", "source", F.struct(*docs.columns).alias("_row"))
    return judge(packed, **parameters).where("kept").select("_row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs.select("doc_id", "text", "lang", "source")).select("doc_id", *BASE_COLUMNS)


def oracle_sql() -> str:
    """The same features, sketches and thresholds in DuckDB."""
    names = [r.metric for r in RULES]
    cell = "CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END"
    q = lambda p: f"min(cell) FILTER (WHERE 100 * upto >= {p} * n) AS q{p}"
    pick = lambda p: f"CASE WHEN o.n >= {LEAST_ROWS} THEN o.q{p} WHEN l.n >= {LEAST_ROWS} THEN l.q{p} ELSE a.q{p} END AS t{p}"
    bounds, fine = [], []
    for r in RULES:
        bounds.append(f"max(t50 + greatest({r.factor} * (t50 - t25), {r.slack})) FILTER (WHERE metric = '{r.metric}') AS hi_{r.metric}")
        fine.append(f"{r.metric} <= hi_{r.metric}")
        if r.below:
            bounds.append(f"max(t50 - greatest({r.factor} * (t75 - t50), {r.slack})) FILTER (WHERE metric = '{r.metric}') AS lo_{r.metric}")
            fine.append(f"{r.metric} >= lo_{r.metric}")
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS n_row, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM docs),
windows AS (
  SELECT n_row, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS x
  FROM (SELECT n_row, w, unnest(range(1, len(w) - 1)) AS i FROM cut WHERE len(w) >= 3)),
repeated AS (
  SELECT n_row, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT n_row, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT n_row, i, count(*) OVER (PARTITION BY n_row, x) AS c FROM windows) WHERE c > 1)
  GROUP BY n_row),
features AS (
  SELECT n_row, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM cut LEFT JOIN repeated USING (n_row)),
rows_ AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         1000 * n_symbols // greatest(word_chars, 1) AS symbol_share,
         1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share,
         1000 * n_repeat_words // greatest(n_words, 1) AS repeat_share,
         100 * word_chars // greatest(n_words, 1) AS word_length
  FROM features),
cells AS (
  SELECT lang, source, metric, {cell} AS cell, count(*) AS c
  FROM (SELECT lang, source, unnest({names}) AS metric, unnest([{", ".join(names)}]) AS v FROM rows_ WHERE NOT base_failed)
  GROUP BY ALL),
leveled AS (
  SELECT 0 AS level, * FROM cells
  UNION ALL SELECT 1, lang, NULL, metric, cell, sum(c) FROM cells GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, metric, cell, sum(c) FROM cells GROUP BY ALL),
running AS (
  SELECT *, sum(c) OVER (PARTITION BY level, lang, source, metric ORDER BY cell) AS upto,
         sum(c) OVER (PARTITION BY level, lang, source, metric) AS n FROM leveled),
quantiles AS (
  SELECT level, lang, source, metric, any_value(n) AS n, {q(25)}, {q(50)}, {q(75)}
  FROM running GROUP BY level, lang, source, metric),
picked AS (
  SELECT o.lang, o.source, o.metric, {pick(25)}, {pick(50)}, {pick(75)}
  FROM quantiles o JOIN quantiles l ON l.level = 1 AND l.metric = o.metric AND l.lang IS NOT DISTINCT FROM o.lang
  JOIN quantiles a ON a.level = 3 AND a.metric = o.metric WHERE o.level = 0),
limits AS (SELECT lang, source, {", ".join(bounds)} FROM picked GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND {" AND ".join(fine)}, false) AS kept
FROM rows_ r LEFT JOIN limits m ON r.lang IS NOT DISTINCT FROM m.lang AND r.source IS NOT DISTINCT FROM m.source
"""
