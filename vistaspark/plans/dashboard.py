"""Dashboard context (V23): every KPI, ranking, rate and statistic as (seccion, clave, valor) rows.

The charges are reduced to one row per catalogue item before they meet the catalogue; the study
ranking, the profile counts and the service means all start from that one small table, and the
sections read the same shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pct
from ..functions.text import classify, clip_label, contains_any, fold, fold_word
from ..operators import aggregates as A
from ..operators._common import money_sum, r6

RANKED = 7  # rows of a ranking before its own order and top-n apply
ALL_STUDIES = "Estudios registrados"  # the one profile when no study matches the keywords


@dataclass(frozen=True)
class DashboardFilters:
    """What a user of the dashboard can choose."""

    trend_months: int = 12
    area_top: int = 4
    exam_top: int = 7
    exam_desc: bool = True
    profile_top: int = 7
    profile_desc: bool = True
    amount_top: int = 7
    amount_desc: bool = True
    revenue_top: int = 5
    sign: str = "all"


def _rows(df: DataFrame, section: str, key: str | Column, value: str | Column) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    value = F.col(value) if isinstance(value, str) else value
    return df.select(F.lit(section).alias("seccion"), key.alias("clave"),
                     F.format_number(value.cast("double"), 2).alias("valor"))


def _long(row: DataFrame, section: str) -> DataFrame:
    """A one-row table as (seccion, clave, valor), one row for each column."""
    cols = row.columns
    stack = ", ".join(f"'{c}', CAST(`{c}` AS double)" for c in cols)
    return _rows(row.selectExpr(f"stack({len(cols)}, {stack}) AS (clave, v)"), section, "clave", "v")


def _reorder(df: DataFrame, value: str, key: str, desc: bool, n: int) -> DataFrame:
    return df.orderBy(F.desc(value) if desc else F.asc(value), F.asc(key)).limit(n)


def dashboard(patients: DataFrame, attentions: DataFrame, charges: DataFrame, catalogue: DataFrame, beds: DataFrame,
              signs: DataFrame, ages: DataFrame, diagnoses: DataFrame, words: Sequence[str], stems: Sequence[str],
              rules: Sequence[tuple[str, Sequence[str]]], default: str,
              ranges: Mapping[str, tuple[float | None, float | None]],
              pressures: Mapping[str, tuple[tuple[float, float], tuple[float, float]]], as_of: str,
              filters: DashboardFilters = DashboardFilters()) -> DataFrame:
    """V23. ``signs`` has a column for each sign of ``ranges`` and ``pressures``; ``ages`` (edad); ``diagnoses``
    (texto). Studies whose folded name holds one of ``words`` are ranked; when none does, all are.
    Amounts are those above zero. Months without an attention show 0."""
    f, spark = filters, patients.sparkSession
    one = lambda df: df.select(F.count(F.lit(1))).scalar()

    items = (charges.groupBy("id_catalogo").agg(
        F.count(F.lit(1)).alias("n"), money_sum(F.when(F.col("subtotal") > 0, F.col("subtotal"))).alias("monto"),
        F.count_if(F.col("subtotal") > 0).alias("cobros"))
        .join(catalogue.select("id_catalogo", "nombre"), "id_catalogo"))
    hit = contains_any(fold("nombre"), [fold_word(w) for w in words])
    by_name = items.groupBy("nombre").agg(F.sum("n").alias("n"), F.sum("monto").alias("monto"),
                                          F.sum("cobros").alias("cobros"))
    matches = items.select(F.count_if(hit)).scalar()
    studied = by_name.filter(hit | (matches == 0))
    top = studied.orderBy(F.desc("n"), F.asc("nombre")).limit(RANKED)
    profiles = (studied.groupBy(F.when(matches > 0, classify("nombre", rules, default)).otherwise(ALL_STUDIES).alias("perfil"))
                .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc("perfil")).limit(RANKED))
    services = by_name.filter("cobros > 0").select(
        clip_label("nombre", 48, "Sin descripción").alias("servicio"),
        r6(F.col("monto").cast("double") / F.col("cobros")).alias("media"))
    ocular_items = catalogue.filter(hit).select("id_catalogo")
    ocular = (charges.select("id_atencion", "id_catalogo").join(ocular_items, "id_catalogo", "left_semi")
              .join(attentions.select("id_atencion", "Id_exp"), "id_atencion"))

    paid = charges.filter("subtotal > 0")
    kpi = A.kpis(spark, {
        "pacientes": one(patients),
        "atenciones_abiertas": one(attentions.filter("status = 'ABIERTA'")),
        "estudios": top.select(F.sum("n")).scalar(),
        "pacientes_oculares": ocular.select(F.count_distinct("Id_exp")).scalar(),
        "ocupacion": beds.select(pct(F.count_if(F.col("ocupada") == 1), F.count(F.lit(1)))).scalar(),
        "cargo_promedio": paid.select(r6(F.avg("subtotal"))).scalar(),
    })
    folded = contains_any(fold("texto"), [fold_word(s) for s in stems])
    more = A.kpis(spark, {
        "media": paid.select(r6(F.avg("subtotal"))).scalar(),
        "edad_promedio": ages.select(r6(F.avg("edad"))).scalar(),
        "diagnosticos_oculares": diagnoses.select(F.count_if(folded)).scalar(),
    })
    area = attentions.select("Id_exp").join(patients.select("Id_exp", "area"), "Id_exp")
    pairs = attentions.select("Id_exp", "especialidad").join(patients.select("Id_exp", "area"), "Id_exp").select(
        F.concat_ws(" / ", "especialidad", "area").alias("clave"))
    kinds = (paid.groupBy(F.coalesce("tipo", F.lit("Sin clasificar")).alias("tipo"))
             .agg(money_sum("subtotal").alias("monto")).orderBy(F.desc("monto"), F.asc("tipo")).limit(f.revenue_top))
    chosen = lambda of: {k: v for k, v in of.items() if f.sign in ("all", k)}
    alerts = A.alert_rates(signs, chosen(ranges), chosen(pressures))
    months = A.monthly_trend(attentions, "fecha_ing", f.trend_months, as_of)

    sections = [
        _long(kpi, "kpi"),
        _long(A.iqr_summary(paid, "subtotal", method="rank"), "estadistica"),
        _long(more, "estadistica"),
        _rows(A.occupancy(beds), "ocupacion", "area", "porcentaje"),
        _rows(A.demand(pairs, ["clave"], 5), "demanda", "clave", "n"),
        _rows(A.share_top(area, "area", f.area_top), "area", "categoria", "n"),
        _rows(months, "tendencia", F.date_format("mes", "yyyy-MM"), "n"),
        _rows(_reorder(top, "n", "nombre", f.exam_desc, f.exam_top), "estudio", clip_label("nombre", 42, "Sin nombre"), "n"),
        _rows(_reorder(profiles, "n", "perfil", f.profile_desc, f.profile_top), "perfil", "perfil", "n"),
        _rows(kinds, "ingreso_tipo", clip_label("tipo", 30), "monto"),
        _rows(_reorder(services, "media", "servicio", f.amount_desc, f.amount_top), "servicio", "servicio", "media"),
        _rows(alerts, "alertas", "signo", "alertas"),
        _rows(alerts, "alertas_pct", "signo", "porcentaje"),
    ]
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out
