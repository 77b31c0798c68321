"""The summary reports what was fitted and saved, and fits nothing itself."""

import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from vistaspark.ml import study as ST
from vistaspark.plans.q_ml import features
from vistaspark.sources.sinks import scratch_path


@pytest.fixture(scope="module")
def fitted(spark, tables):
    path = scratch_path(spark, "study")
    ST.fit_study(tables.cargos, features(tables), path, trees=5, depth=3, iters=3)
    return path


def test_summary_reports_the_saved_study(spark, tables, fitted, monkeypatch):
    def refuse(*_):
        raise AssertionError("the summary must not fit")

    monkeypatch.setattr(Estimator, "fit", refuse)
    insights = spark.createDataFrame([(i, f"r{i}", f"t{i}") for i in range(7)], "prioridad int, regla string, texto string")
    rows = ST.study_summary(spark, fitted, tables.cargos, features(tables), insights).collect()
    got = {(r.seccion, r.clave): r.valor for r in rows}
    metrics = {r.modelo: r.r2 for r in ST.metrics_of(spark, fitted).collect()}
    assert set(metrics) == {"lineal", "random_forest", "gbt"}
    best = max(metrics, key=lambda m: (metrics[m], m))
    assert got["modelo", "mejor_modelo"] == best == ST.best_name(spark, fitted)
    assert float(got["modelo", "r2_prueba"]) == pytest.approx(metrics[best], abs=0.01)
    assert float(got["resumen", "filas"].replace(",", "")) == tables.cargos.count()
    sizes = [float(v.replace(",", "")) for (s, k), v in got.items() if s == "segmentos" and k != "identificados"]
    assert len(sizes) == float(got["segmentos", "identificados"]) == 3 and sum(sizes) == features(tables).na.drop(subset=["edad", "visitas"]).count()
    assert [k for s, k in got if s == "hallazgos"] == [f"r{i}" for i in range(5)]


def test_loaded_models_predict_as_fitted(spark, tables, fitted):
    """The linear pipeline read back equals its own coefficients; segments keep their names."""
    model = ST.load_model(fitted, "lineal")
    out = model.transform(tables.cargos.limit(50))
    assert out.where(F.col("prediction").isNull()).count() == 0
    names = {r.cluster: r.segmento for r in spark.read.parquet(f"{fitted}/segmentos").collect()}
    assert {(r.cluster, r.segmento) for r in ST.segments_of(spark, fitted, features(tables)).select("cluster", "segmento").distinct().collect()} == set(names.items())
    r2 = ST.fitted_metric(spark, fitted).first()
    assert r2.metrica == "mejor_r2" and r2.valor == pytest.approx(max(r.r2 for r in ST.metrics_of(spark, fitted).collect()), abs=1e-6)


def test_a_study_without_metrics(spark):
    path = scratch_path(spark, "study")
    spark.createDataFrame([("gbt", None)], "modelo string, r2 double").write.parquet(f"{path}/metricas")
    with pytest.raises(ValueError, match="no model"):
        ST.best_name(spark, path)
