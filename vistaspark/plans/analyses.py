"""End-to-end batch analyses: each phase is a result table written through S5 (one folder per
section under the run), so a user runs the whole study with one call or one command.

    python -m vistaspark.plans.analyses finance|clinical|unsupervised --root DIR --out DIR [--run RUN]

``--root`` is a folder of the star-schema parquet tables (bound to clinical roles by
``bind.Tables``). Every section is computed by Spark from those tables; nothing is collected
except the model fits' own summaries.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml import metrics as MM
from ..ml import models as MD
from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import rules as R
from ..operators import windows as W
from ..sources.sinks import write_results
from . import vitals
from .bind import Tables


def finance_sections(t: Tables) -> dict[str, Callable[[], DataFrame]]:
    """Descriptive, diagnostic, predictive and segmentation phases over the charges."""
    ch = FL.clean_charges(t.cargos)
    return {
        "limpieza": lambda: FL.cleaning_report(t.cargos, (F.col("cantidad") > 0) & (F.col("precio") > 0)
                                               & (F.col("subtotal") > 0)),
        "ingresos_por_tipo": lambda: A.revenue_by(ch, "tipo"),
        "top_servicios": lambda: A.top_by_sum(ch, "id_catalogo", k=10),
        "estadisticas": lambda: A.global_stats(ch, "subtotal"),
        "distribucion_montos": lambda: FL.amount_distribution(ch, "subtotal"),
        "correlaciones": lambda: A.corr_matrix(ch, ["cantidad", "precio", "subtotal"]),
        "modelos": lambda: MD.fit_regressors(ch, ["cantidad", "precio"], "subtotal", "id_atencion")[0],
        "segmentos": lambda: MD.cluster_means(MD.kmeans_segments(ch.select("cantidad", "precio", "subtotal"),
                                                                 ["cantidad", "precio", "subtotal"], 3),
                                              ["cantidad", "precio", "subtotal"]),
    }


def clinical_sections(t: Tables) -> dict[str, Callable[[], DataFrame]]:
    """Relapse risk, occupancy, demand, anomalies and findings."""
    from .q_rules import clinical_metrics, relapse

    return {
        "riesgo_recaida": lambda: R.relapse_summary(relapse(t)),
        "ocupacion": lambda: A.occupancy(t.camas),
        "demanda": lambda: A.demand(t.atencion.join(t.pacientes.select("Id_exp", "area"), "Id_exp"),
                                    ("especialidad", "area"), 10),
        "anomalias_examenes": lambda: W.sigma_outliers(t.cargos, "id_catalogo", "subtotal", 2.0)
        .groupBy("id_catalogo").agg(F.count(F.lit(1)).alias("atipicos")),
        "alertas_signos": lambda: A.alert_rates(vitals.with_pressure(t.signos), vitals.SINGLE, vitals.PRESSURES),
        "hallazgos": lambda: R.clinical_findings(t.spark, clinical_metrics(t), 10),
    }


def unsupervised_sections(t: Tables) -> dict[str, Callable[[], DataFrame]]:
    """Feature table, PCA, k sweep with its elbow, and cluster profiles."""
    from .q_ml import FEATURE_COLS, features

    def profiles() -> DataFrame:
        assigned = MD.kmeans_segments(features(t), FEATURE_COLS, 3)
        means = MD.cluster_means(assigned, FEATURE_COLS)
        return means.withColumn("perfil", R.cluster_profile(
            F.col("edad_promedio"), F.col("visitas_promedio"), F.col("estudios_promedio"),
            F.col("diagnosticos_promedio"), F.col("monto_promedio")))

    return {
        "caracteristicas": lambda: A.describe(features(t), FEATURE_COLS, method="rank"),
        "pca": lambda: MD.pca_summary(features(t), FEATURE_COLS, 3),
        "barrido_k": lambda: MD.kmeans_sweep(features(t), FEATURE_COLS),
        "codo": lambda: MM.elbow(MD.kmeans_sweep(features(t), FEATURE_COLS).select("k", "inercia")),
        "perfiles": profiles,
    }


ANALYSES = {"finance": finance_sections, "clinical": clinical_sections, "unsupervised": unsupervised_sections}


def run_analysis(spark: SparkSession, name: str, root: str, out: str, run_id: str = "r1",
                 fmt: str = "json") -> list[str]:
    """Compute every section of an analysis and write it under ``out/<name>/run_id=<run>``."""
    t = Tables(spark, root.rstrip("/"))
    written = []
    for section, build in ANALYSES[name](t).items():
        write_results(build(), f"{out.rstrip('/')}/{name}", run_id, section, fmt)
        written.append(section)
    return written


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("analysis", choices=sorted(ANALYSES))
    p.add_argument("--root", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--run", default="r1")
    p.add_argument("--format", default="json")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    print(run_analysis(spark, a.analysis, a.root, a.out, a.run, a.format))


if __name__ == "__main__":
    main()
