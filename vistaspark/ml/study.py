"""A fitted study kept in a folder: models, their test metrics and the patients' segments.

``fit_study`` fits once and saves; whatever reports on the study loads the saved pipelines and scores
tables with them, so a report never fits again and two reports of one study agree.

    modelos/<name>    PipelineModel of each regressor        metricas    r2, mae, mse, rmse, n by name
    segmentador       PipelineModel: scaler and k-means      segmentos   cluster sizes, means and names
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._common import money_sum, r6
from ..operators.rules import segment_name
from .metrics import regression_metrics
from .models import _features, cluster_means, fit_regressors, written

SEGMENT_COLS = ["edad", "visitas"]


def fit_study(charges: DataFrame, patients: DataFrame, path: str, features: Sequence[str] = ("cantidad", "precio"), label: str = "subtotal",
              key: str = "id_atencion", k: int = 3, seed: int = 42, **sizes) -> None:
    """Fits M1's three regressors on the charges and M19's segments on the patients, and saves all of it
    under ``path``. A study fitted again replaces the old one part by part; the metrics, written last of
    the models, name those that are there. ``sizes``: trees, depth, iters."""
    metrics, models = fit_regressors(charges, list(features), label, key, seed, **sizes)
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/modelos/{name}")
    metrics.write.mode("overwrite").parquet(f"{path}/metricas")
    data = written(patients.select(*SEGMENT_COLS).na.drop())
    model = Pipeline(stages=_features(SEGMENT_COLS, with_mean=True) + [
        KMeans(k=k, seed=seed, maxIter=20, featuresCol="features", predictionCol="cluster")]).fit(data)
    model.write().overwrite().save(f"{path}/segmentador")
    means = cluster_means(model.transform(data).drop("raw", "features"), SEGMENT_COLS)
    named = means.withColumn("segmento", segment_name(F.col("visitas_promedio"), F.col("edad_promedio")))
    named.coalesce(1).write.mode("overwrite").parquet(f"{path}/segmentos")


def metrics_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/metricas")


def best_name(spark: SparkSession, path: str) -> str:
    """The model of the highest test R2 (the last name of equal ones); models without one don't count."""
    row = metrics_of(spark, path).where("r2 IS NOT NULL AND NOT isnan(r2)").agg(F.max_by("modelo", F.struct("r2", "modelo"))).first()
    if row[0] is None:
        raise ValueError(f"no model with an R2 under {path}")
    return row[0]


def load_model(path: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/modelos/{name}")


def segments_of(spark: SparkSession, path: str, patients: DataFrame) -> DataFrame:
    """``patients`` with the saved segmenter's ``cluster`` and its name; rows without its columns go."""
    model = PipelineModel.load(f"{path}/segmentador")
    names = spark.read.parquet(f"{path}/segmentos").select("cluster", "segmento")  # a row for each cluster
    return model.transform(patients.na.drop(subset=SEGMENT_COLS)).drop("raw", "features").join(F.broadcast(names), "cluster")


def study_summary(spark: SparkSession, path: str, charges: DataFrame, patients: DataFrame, insights: DataFrame, n_insights: int = 5,
                  label: str = "subtotal") -> DataFrame:
    """(seccion, clave, valor): rows and revenue, the best fitted model with its test R2 and what it makes
    of all charges, the segments with their sizes now, and the first insights. Nothing is fitted here."""
    name = best_name(spark, path)
    scored = load_model(path, name).transform(charges.withColumn("label", F.col(label).cast("double")))
    number = lambda c: F.format_number(c.cast("double"), 2)
    row = lambda section, key, value: F.struct(F.lit(section).alias("seccion"), F.lit(key).alias("clave"), value.alias("valor"))
    totals = charges.agg(F.count(F.lit(1)).alias("n"), money_sum(label).alias("m")).select(F.explode(F.array(
        row("resumen", "filas", number(F.col("n"))), row("resumen", "ingreso", number(F.col("m"))))).alias("r")).select("r.*")
    fitted = metrics_of(spark, path).where(F.col("modelo") == name).select(F.explode(F.array(
        row("modelo", "mejor_modelo", F.col("modelo")), row("modelo", "r2_prueba", number(F.col("r2"))))).alias("r")).select("r.*")
    now = regression_metrics(scored.select("label", "prediction").na.drop()).select(row("modelo", "r2_todos", number(F.col("r2"))).alias("r")).select("r.*")
    groups = segments_of(spark, path, patients).groupBy("segmento", "cluster").agg(F.count(F.lit(1)).alias("n"))
    segments = groups.select(F.lit("segmentos").alias("seccion"), F.concat_ws(" ", "segmento", F.col("cluster").cast("string")).alias("clave"),
                             number(F.col("n")).alias("valor"))
    found = groups.agg(F.count(F.lit(1)).alias("n")).select(row("segmentos", "identificados", number(F.col("n"))).alias("r")).select("r.*")
    first = insights.orderBy("prioridad", "regla").limit(n_insights).select(F.lit("hallazgos").alias("seccion"), F.col("regla").alias("clave"),
                                                                            F.col("texto").alias("valor"))
    out = totals
    for part in (fitted, now, found, segments, first):
        out = out.unionByName(part)
    return out


def fitted_metric(spark: SparkSession, path: str) -> DataFrame:
    """The best fitted model's R2 as the metric (metrica, valor) of the evaluation's rules."""
    return metrics_of(spark, path).agg(F.lit("mejor_r2").alias("metrica"), r6(F.max("r2")).alias("valor"))
