"""Benchmark decontamination in DataFrame functions only.

A document is contaminated when one of its windows, as long as a benchmark item, is similar to the
item: weighted Jaccard similarity of word shingles (weight: occurrences). Every window counts and
none is made: a window's similarity follows from the positions at which the text holds shingles of
the item, and the first window of the greatest similarity ends at such a position or starts the
text. Pairs of texts and items come from an exact prefix filter: a window that is similar enough
lacks too few of an item's shingles to miss all of its rarest ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import free_names, materialise, shuffle_partitions, table, text_or_empty

SHINGLE, PERCENT = 5, 75
BROADCAST_ROWS = 500_000  # the items' shingles are broadcast up to this count, else joined by shuffle

_WORDS = r"filter(split(lower({}), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def word_hash_column(text: str) -> Column:
    return F.expr(f"transform({_WORDS.format(text)}, w -> xxhash64(w))")


def shingles_sql(h: str, size: int) -> str:
    """Hashes of all runs of ``size`` words of the word hashes ``h``."""
    rest = "".join(f", {h}[i + {k}]" for k in range(1, size))
    return (f"if(size({h}) < {size}, cast(array() as array<bigint>), "
            f"transform(slice({h}, 1, size({h}) - {size - 1}), (x, i) -> xxhash64({size}, x{rest})))")


#: How often each element of the sorted array ``s`` is in it.
_TIMES = ("transform(array(reverse(s)), r -> transform(s, x -> "
          "cast(size(s) + 2 - array_position(s, x) - array_position(r, x) as int)))[0]")


def _placed_sql() -> str:
    """The text's shingles that the item has, in order: (p, hash, m), where m is how often the item has the hash.
    None when no window can hold enough of them."""
    placed = ("transform(filter(hits, x -> array_contains(s, x.hash)), "
              "x -> struct(x.p as p, x.hash as hash, times[cast(array_position(s, x.hash) as int) - 1] as m))")
    close = "sequence(need - 1, size(a) - 1), i -> a[i - need + 1].p > a[i].p - width"
    return f"explode(filter(array({placed}), a -> if(size(a) < need, false, exists({close}))))"


def _best_window_sql(percent: int) -> str:
    """The first window of the greatest weighted intersection: (shared, back = -start), if similar enough.

    A shingle at p counts in the windows that end from p on, until it leaves them (p + width) or the item's m
    occurrences of its hash are all found after it. The running sum of these steps is the intersection of each
    window, so that a pair costs its hits and not hits times width."""
    spans = "transform(h, (x, k) -> struct(x.p as p, least(x.p + width, if(get(h, k + x.m).hash = x.hash, get(h, k + x.m).p, null)) as stop))"
    steps = f"sort_array(flatten(transform({spans}, x -> array(struct(x.p as e, 1 as d), struct(x.stop as e, -1 as d)))))"
    more = "a.now + v.d > a.shared"
    best = (f"aggregate({steps}, struct(0 as now, 0 as shared, 0 as e), (a, v) -> struct(a.now + v.d as now, "
            f"if({more}, a.now + v.d, a.shared) as shared, if({more}, v.e, a.e) as e), "
            "a -> struct(a.shared as shared, -greatest(0, a.e - width + 1) as back))")
    by_hash = "sort_array(transform(at, x -> struct(x.hash as hash, x.p as p, x.m as m)))"
    return (f"explode(filter(transform(array({by_hash}), h -> {best}), "
            f"b -> 100 * b.shared >= {percent} * (least(n, length) - run + 1 + width - b.shared)))")


def find_items(docs: DataFrame, items: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text, ...), ``items`` (item_id, text, ...) -> (rid, item_id, similarity,
    start, n_words): for each text (``rid`` is its hash) and item found in it the first best window.

    Words are lower-cased. Items of fewer words than ``size`` are one shingle. Null and empty texts
    or items match nothing; repeated items count by their id; empty tables give no rows.
    """
    spark = docs.sparkSession
    words = (items.select("item_id", text_or_empty().alias("text")).select("item_id", word_hash_column("text").alias("h"))
             .where("size(h) > 0").withColumn("length", F.size("h")).withColumn("run", F.least("length", F.lit(size))))
    words = words.withColumn("copy", F.xxhash64("h"))  # items of equal words are looked for once
    ids = materialise(words.select("copy", "item_id").distinct(), "item-ids")
    short = "".join(f"when run = {n} then {shingles_sql('h', n)} " for n in range(1, size))
    known = materialise(words.drop("item_id").dropDuplicates(["copy"]).withColumn("s", F.expr(f"sort_array(case {short}else {shingles_sql('h', size)} end)"))
                        .withColumn("times", F.expr(_TIMES)).withColumn("width", F.size("s"))
                        .withColumn("need", F.expr(f"greatest(1, ({percent} * width + 99) div 100)").cast("int")).drop("h"), "items")
    lengths = sorted(r["run"] for r in known.select("run").distinct().collect())  # at most ``size`` values
    if not lengths:
        return spark.createDataFrame([], "rid long, item_id long, similarity double, start int, n_words int")

    pieces = known.select("copy", "run", "width", "need", F.explode("s").alias("hash"))
    small = F.broadcast if max(pieces.count(), ids.count()) <= BROADCAST_ROWS else (lambda d: d)
    often = pieces.groupBy("run", "hash").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("copy").orderBy("often", "hash")
    rare = materialise(pieces.join(often, ["run", "hash"]).withColumn("rank", F.row_number().over(rarest))
                       .where("rank <= width - need + 1").select("hash", "copy").distinct(), "rare")

    rows = docs.select(F.xxhash64(text_or_empty()).alias("rid"), word_hash_column("coalesce(text, '')").alias("h"))
    held = None
    for run in lengths:
        found = (rows.select("rid", F.size("h").alias("n"), F.posexplode(F.expr(shingles_sql("h", run))).alias("p", "hash"))
                 .join(small(often.where(F.col("run") == run).select("hash")), "hash"))
        held = found if held is None else held.unionByName(found)
    # one row for each text; copies of a text meet here after a map-side combine
    held = materialise(held.groupBy("rid").agg(F.min("n").alias("n"), F.sort_array(F.collect_set(F.struct("p", "hash"))).alias("hits")),
                       "hits")

    pairs = held.select("rid", F.explode("hits.hash").alias("hash")).join(small(rare), "hash").select("rid", "copy").distinct()
    # the pairs that are left are dealt out evenly: they are few, but each costs its hits
    pair = ["rid", "copy", "n", "length", "run", "width"]
    near = (pairs.join(held, "rid").join(small(known), "copy").select(*pair, F.expr(_placed_sql()).alias("at"))
            .repartition(shuffle_partitions(spark), "rid", "copy")
            .select(*pair, F.expr(_best_window_sql(percent)).alias("best")))
    return (near.withColumn("together", F.expr("least(n, length) - run + 1 + width - best.shared"))
            .join(small(ids), "copy")
            .groupBy("rid", "item_id").agg(F.max(F.struct((F.col("best.shared") / F.col("together")).alias("similarity"),
                                                          F.col("best.back").alias("back"), F.col("length"))).alias("best"))
            .select("rid", "item_id", "best.similarity", (-F.col("best.back")).alias("start"), F.col("best.length").alias("n_words")))


def contaminated(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """One row for each contaminated row of ``docs`` and item found in it: (doc_id, item_id,
    similarity, start, n_words). Rows with equal texts have equal findings."""
    found = find_items(docs, items, **parameters)
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("rid"))
    return rows.join(found, "rid").select("doc_id", "item_id", "similarity", "start", "n_words")


def without_contaminated(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the rows whose text holds an item; all other rows and columns stay."""
    rid, = free_names(docs, "_rid")
    found = materialise(find_items(docs, items, **parameters).select(F.col("rid").alias(rid)).distinct(), "found")
    return docs.withColumn(rid, F.xxhash64(text_or_empty())).join(found, rid, "left_anti").select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
