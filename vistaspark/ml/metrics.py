"""Exact model metrics and closed-form fits as SQL aggregates.

All are single aggregates over a prediction table, so they run as partial aggregation at any
scale and have an exact DuckDB twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._common import r6, rsig


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M3/M4: R2 = 1 - SSE/SST, MAE, MSE, RMSE (NaN/undefined -> null)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    # SST = n * var_pop(y): one pass, numerically stable, no second scan for the mean
    agg = pred.agg(
        F.sum((y - p) * (y - p)).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"),
        F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"), F.count(F.lit(1)).alias("n"),
    )
    return agg.select(
        r6(1 - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"), rsig("mae").alias("mae"),
        rsig("mse").alias("mse"), rsig(F.sqrt("mse")).alias("rmse"), "n",
    )


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction", positive=1) -> DataFrame:
    """M7: tp / fp / fn / tn in one aggregate (zero-filled)."""
    y, p = F.col(label) == positive, F.col(prediction) == positive
    return pred.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M8: accuracy, weighted precision / recall / F1 (class-frequency weights, as Spark's
    MulticlassClassificationEvaluator), and binary recall, specificity, precision, F1 with zero
    guards (division by zero -> 0)."""
    per = pred.groupBy(F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("support"),
                                                     F.count_if(F.col(prediction) == F.col(label)).alias("tp"))
    predicted = pred.groupBy(F.col(prediction).alias("c")).agg(F.count(F.lit(1)).alias("npred"))
    j = per.join(predicted, "c", "left").fillna({"npred": 0})
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("npred").cast("double")), F.lit(0.0))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double"))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    s = F.col("support")
    n = F.sum(s)
    weighted = j.agg(
        r6(F.sum("tp") / n).alias("accuracy"), r6(F.sum(s * prec) / n).alias("weighted_precision"),
        r6(F.sum(s * rec) / n).alias("weighted_recall"), r6(F.sum(s * f1) / n).alias("weighted_f1"),
    )
    cm = confusion(pred, label, prediction)
    tp, fp, fn, tn = (cm.select(c).scalar() for c in ("tp", "fp", "fn", "tn"))
    b_prec = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    b_rec = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    return weighted.select(
        "*",
        r6(b_rec).alias("recall"),
        r6(F.coalesce(F.try_divide(tn.cast("double"), (tn + fp).cast("double")), F.lit(0.0))).alias("specificity"),
        r6(b_prec).alias("precision"),
        r6(F.coalesce(F.try_divide(2 * b_prec * b_rec, b_prec + b_rec), F.lit(0.0))).alias("f1"),
    )


def simple_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares y = b0 + b1 x with R2 (``regr_*`` aggregates)."""
    return df.agg(r6(F.regr_intercept(y, x)).alias("b0"), r6(F.regr_slope(y, x)).alias("b1"),
                  r6(F.regr_r2(y, x)).alias("r2"), F.regr_count(y, x).alias("n"))


def fit_vs_naive(df: DataFrame, x: str, y: str) -> DataFrame:
    """Linear fit vs the naive mean predictor: both MSEs and the improvement %.

    Model MSE of the least-squares line = (1 - R2) * var_pop(y); naive MSE = var_pop(y).
    """
    a = df.agg(F.regr_slope(y, x).alias("b1"), F.regr_intercept(y, x).alias("b0"), F.regr_r2(y, x).alias("r2"),
               F.var_pop(F.col(y)).alias("v"), F.regr_count(y, x).alias("n"))
    return a.select(
        rsig("b0").alias("b0"), rsig("b1").alias("b1"), r6("r2").alias("r2"), rsig("v").alias("mse_naive"),
        rsig((1 - F.col("r2")) * F.col("v")).alias("mse_modelo"),
        r6(F.try_divide(F.col("v") - (1 - F.col("r2")) * F.col("v"), F.col("v")) * 100).alias("mejora_pct"), "n",
    )


def elbow(points: DataFrame, k: str = "k", y: str = "inercia") -> DataFrame:
    """Elbow of a (k, inertia) curve: normalise both axes to [0,1], take the point
    farthest from the chord joining the first and last points; < 3 points -> last k.

    Min/max and the end points come from one scalar subquery (the curve is one row per k).
    """
    st = points.agg(F.struct(
        F.min(k).cast("double").alias("k0"), F.max(k).cast("double").alias("k1"),
        F.min(y).cast("double").alias("y0"), F.max(y).cast("double").alias("y1"),
        F.min_by(F.col(y), F.col(k)).cast("double").alias("yf"), F.max_by(F.col(y), F.col(k)).cast("double").alias("yl"),
        F.count(F.lit(1)).alias("n"), F.max(k).alias("kmax"))).scalar()
    kn = F.try_divide(F.col(k) - st["k0"], st["k1"] - st["k0"])
    yn = F.try_divide(F.col(y) - st["y0"], st["y1"] - st["y0"])
    yfn = F.try_divide(st["yf"] - st["y0"], st["y1"] - st["y0"])
    yln = F.try_divide(st["yl"] - st["y0"], st["y1"] - st["y0"])
    # distance from (kn, yn) to the line through (0, yfn) and (1, yln)
    dist = F.abs((yln - yfn) * kn - yn + yfn) / F.sqrt((yln - yfn) * (yln - yfn) + 1)
    scored = points.select(k, dist.alias("d"))
    best = scored.agg(F.max_by(F.col(k), F.struct(F.round("d", 9), -F.col(k))).alias("k_codo"))
    return best.select(F.when(st["n"] < 3, st["kmax"]).otherwise(F.col("k_codo")).cast("int").alias("k_codo"))


def cluster_issues(spark: SparkSession, sizes: DataFrame, silhouette, variance, size_col: str = "n",
                   min_silhouette: float = 0.4, min_variance: float = 0.7, max_ratio: float = 3.0,
                   tiny_share: float = 0.05) -> DataFrame:
    """Diagnosis rows: low silhouette, low explained variance, unbalanced sizes
    (max/min > 3), tiny clusters (< 5 % of rows)."""
    from pyspark.sql import Window

    # ``sizes`` has one row per cluster (k rows), so a whole-table window over it is bounded
    sized = sizes.withColumn("_tot", F.sum(size_col).over(Window.partitionBy()))
    st = sized.agg(F.struct(F.max(size_col).alias("mx"), F.min(size_col).alias("mn"),
                            F.count_if(F.col(size_col) < F.lit(tiny_share) * F.col("_tot")).alias("tiny"))).scalar()
    tiny = st["tiny"]
    checks = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit("silueta_baja").alias("problema"), (F.lit(silhouette) < min_silhouette).alias("detectado"),
                 F.lit(silhouette).cast("double").alias("valor")),
        F.struct(F.lit("varianza_baja").alias("problema"), (F.lit(variance) < min_variance).alias("detectado"),
                 F.lit(variance).cast("double").alias("valor")),
        F.struct(F.lit("desbalance").alias("problema"), (F.try_divide(st["mx"], st["mn"]) > max_ratio).alias("detectado"),
                 F.try_divide(st["mx"].cast("double"), st["mn"].cast("double")).alias("valor")),
        F.struct(F.lit("clusters_diminutos").alias("problema"), (tiny > 0).alias("detectado"),
                 tiny.cast("double").alias("valor")),
    )).alias("c")).select("c.*")
    return checks.withColumn("detectado", F.coalesce("detectado", F.lit(False)))
