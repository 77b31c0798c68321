"""Scoring rules (R1-R10): the clinical logic, with every rule list held as data.

Rule tables are literal DataFrames whose size is fixed by code, so broadcasting them is
bounded; metrics are joined to them and filtered, never looped over on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_any, factor_list, fold, fold_word
from ._common import rule_table


# ---------------------------------------------------------------- R1 relapse risk
@dataclass(frozen=True)
class RelapseRules:
    """Which exams count as ocular / retina / glaucoma / cornea / systemic, and which
    diagnosis words mark an ocular diagnosis. Stems match the accent-folded, upper-cased
    text as literal substrings (the reference's substring rule)."""

    ocular_ids: tuple[int, ...]
    ocular_stems: tuple[str, ...]
    retina_ids: tuple[int, ...]
    retina_stems: tuple[str, ...]
    glaucoma_ids: tuple[int, ...]
    glaucoma_stems: tuple[str, ...]
    cornea_ids: tuple[int, ...]
    cornea_stems: tuple[str, ...]
    systemic_ids: tuple[int, ...]
    systemic_stems: tuple[str, ...]
    diagnosis_stems: tuple[str, ...]


# The clinical catalogue ids and word stems of the relapse-risk rule.
CLINICAL_RULES = RelapseRules(
    ocular_ids=tuple(range(1, 16)),
    ocular_stems=("oct", "tonometr", "fondo de ojo", "campimetr", "paquimetr", "topograf", "retinograf",
                  "angiograf", "gonioscop", "queratometr", "biomicroscop", "agudeza", "refracci",
                  "ultrasonido ocular"),
    retina_ids=(5, 7, 12, 13),
    retina_stems=("retin", "macul", "fondo de ojo", "angiograf"),
    glaucoma_ids=(3, 6, 8, 14),
    glaucoma_stems=("tonometr", "campimetr", "nervio", "gonioscop"),
    cornea_ids=(9, 10, 15),
    cornea_stems=("paquimetr", "topograf", "queratometr", "corneal"),
    systemic_ids=(17, 18, 21, 25),
    systemic_stems=("glucosa", "glicosilada", "lip", "quimica"),
    diagnosis_stems=("glau", "retin", "macul", "catar", "querat", "uve", "cornea", "ocular", "ojo"),
)

# Score points and level cut-offs.
LEVEL_HIGH, LEVEL_MEDIUM = 8, 4
PROFILE_LABELS = ("Retina/Mácula", "Glaucoma/Nervio óptico", "Córnea", "Sin perfil ocular dominante")
FACTOR_LABELS = ("Retina/Mácula", "Glaucoma/Nervio óptico", "Córnea", "Metabólico")


def _hit(ids: Sequence[int], stems: Sequence[str], id_col: Column, text: Column) -> Column:
    return F.coalesce(id_col.isin(list(ids)), F.lit(False)) | contains_any(text, [fold_word(s) for s in stems])


def _steps(c: Column, steps: Sequence[tuple[int, int]]) -> Column:
    out = None
    for lim, pts in steps:
        out = F.when(c >= lim, pts) if out is None else out.when(c >= lim, pts)
    return out.otherwise(0)


def exam_flags(df: DataFrame, rules: RelapseRules, id_col: str = "id_catalogo", name_col: str = "nombre_examen"
               ) -> DataFrame:
    """Family flags of exams (ocular / retina / glaucoma / cornea / systemic) from id and name."""
    d = df.withColumn("_cat", F.col(id_col).try_cast("int")).withColumn("_name", fold(name_col))
    cat, name = F.col("_cat"), F.col("_name")
    return d.withColumns({
        "_oc": _hit(rules.ocular_ids, rules.ocular_stems, cat, name),
        "_re": _hit(rules.retina_ids, rules.retina_stems, cat, name),
        "_gl": _hit(rules.glaucoma_ids, rules.glaucoma_stems, cat, name),
        "_co": _hit(rules.cornea_ids, rules.cornea_stems, cat, name),
        "_sy": _hit(rules.systemic_ids, rules.systemic_stems, cat, name),
    }).drop("_cat", "_name")


def relapse_risk(details: DataFrame, headers: DataFrame, attentions: DataFrame, diagnoses: DataFrame | None,
                 rules: RelapseRules, as_of: str, diag_text_cols: Sequence[str] = ("texto",),
                 catalogue: DataFrame | None = None) -> DataFrame:
    """Ocular-relapse risk score (0-15), level and main profile per patient.

    details: id_examen, id_catalogo, nombre_examen, estado, fecha_realizado
    headers: id_examen, id_atencion, fecha [, Id_exp] ; attentions: id_atencion, Id_exp
    diagnoses: id_atencion + text columns.
    catalogue: optional (id_catalogo, nombre_examen). When given, the exam families are decided
    once per catalogue item and joined to the details by id (the names come from it), instead
    of folding and matching the name on every detail row.

    Everything is partial aggregation per patient, then left joins of one-row-per-patient
    facts onto the patient base (no fan-out).
    """
    base = attentions.select("Id_exp").filter(F.col("Id_exp").isNotNull()).distinct()
    # rows outside the ocular and systemic families change no output: they go before the header join
    if catalogue is not None:
        flags = exam_flags(catalogue.select("id_catalogo", "nombre_examen"), rules)
        d = details.drop("nombre_examen").join(flags, "id_catalogo", "left").fillna(
            {"_oc": False, "_re": False, "_gl": False, "_co": False, "_sy": False})
        # ids alone still decide for items missing from the catalogue
        cat = F.col("id_catalogo").try_cast("int")
        for flag, ids in (("_oc", rules.ocular_ids), ("_re", rules.retina_ids), ("_gl", rules.glaucoma_ids),
                          ("_co", rules.cornea_ids), ("_sy", rules.systemic_ids)):
            d = d.withColumn(flag, F.col(flag) | F.coalesce(cat.isin(list(ids)), F.lit(False)))
    else:
        d = exam_flags(details, rules)
    # one join pass over the rest; a header that already carries the patient skips the attention join
    h = headers.select("id_examen", *(["Id_exp"] if "Id_exp" in headers.columns else ["id_atencion"]),
                       F.col("fecha").alias("fecha_examen"))
    d = d.filter(F.col("_oc") | F.col("_sy")).join(h, "id_examen", "left")
    if "Id_exp" not in headers.columns:
        d = d.join(attentions.select("id_atencion", "Id_exp"), "id_atencion", "left")
    d = d.filter(F.col("Id_exp").isNotNull())
    d = (
        d.withColumn("_state", F.upper(F.coalesce(F.col("estado"), F.lit(""))))
        .withColumn("_date", F.to_date(F.coalesce(F.col("fecha_realizado"), F.col("fecha_examen"))))
    )
    oc = F.col("_oc")
    # all per-patient exam facts in one partial aggregate (family counts are over ocular exams)
    facts = d.groupBy("Id_exp").agg(
        F.count_if(oc).alias("total_examenes_oculares"),
        F.count_distinct(F.when(oc, F.col("nombre_examen"))).alias("tipos_examenes_oculares"),
        F.count_if(oc & (F.col("_state") == "REALIZADO")).alias("examenes_realizados"),
        F.count_if(oc & (F.col("_state") == "PENDIENTE")).alias("examenes_pendientes"),
        F.count_if(oc & F.col("_re")).alias("estudios_retina"),
        F.count_if(oc & F.col("_gl")).alias("estudios_glaucoma"),
        F.count_if(oc & F.col("_co")).alias("estudios_corneales"),
        F.min(F.when(oc, F.col("_date"))).alias("primer_estudio"),
        F.max(F.when(oc, F.col("_date"))).alias("ultimo_estudio"),
        F.count_if(F.col("_sy")).alias("marcadores_sistemicos"),
    ).withColumn("examenes_repetidos", F.col("total_examenes_oculares") - F.col("tipos_examenes_oculares"))
    facts = facts.filter((F.col("total_examenes_oculares") > 0) | (F.col("marcadores_sistemicos") > 0))

    risk = base.join(facts, "Id_exp", "left")
    if diagnoses is not None:
        text = fold(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in diag_text_cols]))
        dhit = contains_any(text, [fold_word(s) for s in rules.diagnosis_stems])
        diag_facts = (  # one flag per diagnosis meets the attentions, not its text
            diagnoses.select("id_atencion", F.when(dhit, 1).otherwise(0).alias("_hit"))
            .join(attentions.select("id_atencion", "Id_exp"), "id_atencion", "left")
            .filter(F.col("Id_exp").isNotNull())
            .groupBy("Id_exp").agg(F.max("_hit").alias("diagnostico_ocular"),
                                   F.count(F.lit(1)).alias("total_diagnosticos"))
        )
        risk = risk.join(diag_facts, "Id_exp", "left")
    else:
        risk = risk.withColumn("diagnostico_ocular", F.lit(0)).withColumn("total_diagnosticos", F.lit(0))
    counts = ["total_examenes_oculares", "tipos_examenes_oculares", "examenes_realizados", "examenes_pendientes",
              "estudios_retina", "estudios_glaucoma", "estudios_corneales", "examenes_repetidos",
              "marcadores_sistemicos", "diagnostico_ocular", "total_diagnosticos"]
    risk = risk.select("Id_exp", "primer_estudio", "ultimo_estudio",
                       *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts])

    # fixed values: the points of the score
    r, g, c = F.col("estudios_retina"), F.col("estudios_glaucoma"), F.col("estudios_corneales")
    score = (
        _steps(F.col("total_examenes_oculares"), [(5, 3), (3, 2), (1, 1)])
        + _steps(r, [(2, 2), (1, 1)]) + _steps(g, [(2, 2), (1, 1)]) + _steps(c, [(2, 2), (1, 1)])
        + F.when(F.col("examenes_repetidos") >= 1, 2).otherwise(0)
        + F.when(F.col("examenes_pendientes") >= 3, 1).otherwise(0)
        + F.when(F.col("diagnostico_ocular") == 1, 2).otherwise(0)
        + F.when(F.col("marcadores_sistemicos") >= 2, 1).otherwise(0)
    )
    risk = risk.withColumn("score_recaida", score.cast("int"))
    s = F.col("score_recaida")
    return risk.withColumns({
        "nivel_riesgo_recaida": F.when(s >= LEVEL_HIGH, "ALTO").when(s >= LEVEL_MEDIUM, "MEDIO").otherwise("BAJO"),
        "perfil_principal": F.when((r >= g) & (r >= c) & (r > 0), PROFILE_LABELS[0])
        .when((g >= r) & (g >= c) & (g > 0), PROFILE_LABELS[1])
        .when(c > 0, PROFILE_LABELS[2]).otherwise(PROFILE_LABELS[3]),
        "factores_detectados": factor_list([
            (FACTOR_LABELS[0], r > 0), (FACTOR_LABELS[1], g > 0), (FACTOR_LABELS[2], c > 0),
            (FACTOR_LABELS[3], F.col("marcadores_sistemicos") > 0)]),
        "dias_desde_ultimo_estudio": F.datediff(F.lit(as_of).cast("date"), F.col("ultimo_estudio")),
    })


def relapse_summary(risk: DataFrame) -> DataFrame:
    """R1 output: patients per level with mean / sum of ocular exams (one aggregate)."""
    return risk.groupBy("nivel_riesgo_recaida").agg(
        F.count(F.lit(1)).alias("pacientes"),
        F.round(F.avg("total_examenes_oculares"), 6).alias("promedio_examenes"),
        F.sum("total_examenes_oculares").alias("total_examenes"),
        F.count_if(F.col("total_examenes_oculares") > 0).alias("con_examen_ocular"),
    )


# ---------------------------------------------------------------- R2-R5
# Lab limits (medium, high) per test: glucose pre-diabetic 100 / diabetic 126,
# HbA1c 5.7 / 6.5, blood chemistry 100 / 126, lipid profile 200 / 200 (normal < 200, high > 200).
LAB_LIMITS = {"Glucosa": (100.0, 126.0), "Hemoglobina Glicosilada": (5.7, 6.5), "Química Sanguínea": (100.0, 126.0),
              "Perfil Lipídico": (200.0, 200.0)}


def threshold_risk(labs: DataFrame, limits: Mapping[str, tuple[float, float]] = LAB_LIMITS, patient: str = "Id_exp",
                   test: str = "prueba", value: str = "valor") -> DataFrame:
    """R2: per patient and test: max value and level (>= high limit ALTO, >= medium MEDIO,
    else BAJO). The high/medium reading of the limits is ours (only outputs survive)."""
    spark = labs.sparkSession
    lim = rule_table(spark, [(k, float(m), float(h)) for k, (m, h) in limits.items()],
                     f"{test} string, limite_medio double, limite_alto double")
    mx = labs.groupBy(patient, test).agg(F.max(value).alias("valor_max"))
    j = mx.join(lim, test, "inner")
    return j.withColumn("nivel", F.when(F.col("valor_max") >= F.col("limite_alto"), "ALTO")
                        .when(F.col("valor_max") >= F.col("limite_medio"), "MEDIO").otherwise("BAJO"))


def bed_status(beds: DataFrame, occupancy: DataFrame, bed: str = "id_cama", flag: str = "ocupada",
               att: str = "id_atencion", since: str = "fecha_ing") -> DataFrame:
    """OCUPADA when an open attention holds the bed (the newest wins), else
    MANTENIMIENTO when flagged, else LIBRE. ``occupancy`` = open (bed, attention, since) rows;
    the newest per bed is a partial ``max_by`` aggregate."""
    occ = occupancy.groupBy(bed).agg(
        F.max_by(F.struct(F.col(att).alias("id_atencion"), F.col(since).alias("desde")),
                 F.struct(F.col(since), F.col(att))).alias("_o"))
    occ = occ.select(bed, F.col("_o.id_atencion").alias("id_atencion_actual"), F.col("_o.desde").alias("ocupada_desde"))
    j = beds.join(occ, bed, "left")
    return j.withColumn("estado_cama", F.when(F.col("id_atencion_actual").isNotNull(), "OCUPADA")
                        .when(F.coalesce(F.col(flag), F.lit(0)) == 1, "MANTENIMIENTO").otherwise("LIBRE"))


# Cluster-profile cut-offs and labels.
def cluster_profile(age: Column, visits: Column, exams: Column, diagnoses: Column, amount: Column) -> Column:
    """R4: 'age | frequency | complexity | spending' label from four scales."""
    a = F.when(age >= 65, "Adulto Mayor").when(age >= 40, "Adulto").otherwise("Joven")
    v = F.when(visits >= 5, "Alta Frecuencia").when(visits >= 2, "Frecuencia Media").otherwise("Baja Frecuencia")
    c = (F.when((diagnoses >= 3) & (exams >= 5), "Alta Complejidad")
         .when((diagnoses >= 1) & (exams >= 2), "Complejidad Media").otherwise("Complejidad Baja"))
    m = F.when(amount >= 500000, "Alto Gasto").when(amount >= 100000, "Gasto Medio").otherwise("Bajo Gasto")
    return F.concat_ws(" | ", a, v, c, m)


def segment_name(visits: Column, age: Column) -> Column:
    """Visits > 2 ALTA FRECUENCIA, else age > 50 ADULTO MAYOR, else BAJA FRECUENCIA."""
    return F.when(visits > 2, "ALTA FRECUENCIA").when(age > 50, "ADULTO MAYOR").otherwise("BAJA FRECUENCIA")


# ---------------------------------------------------------------- R6-R10 rule tables
RULE_SCHEMA = "regla string, metrica string, op string, umbral double, grupo string, prioridad int, texto string"


def apply_rules(metrics: DataFrame, rules: DataFrame, limit: int | None = None) -> DataFrame:
    """Fire rules on a metrics table (metrica, valor): broadcast rule table join + filter.

    Rules in the same ``grupo`` are exclusive: only the first fired (lowest ``prioridad``)
    is kept, as an if/elif chain would. ``{v}`` in a text is replaced by the value.
    Optionally keep the first ``limit`` findings by priority.
    """
    j = metrics.join(F.broadcast(rules), "metrica", "inner")
    v, u, op = F.col("valor"), F.col("umbral"), F.col("op")
    fired = j.filter(
        F.when(op == ">", v > u).when(op == ">=", v >= u).when(op == "<", v < u).when(op == "<=", v <= u)
        .when(op == "==", v == u).otherwise(F.lit(False))
    )
    first = fired.groupBy("grupo").agg(F.min_by(F.struct("regla", "metrica", "valor", "prioridad", "texto"),
                                                F.struct("prioridad", "regla")).alias("_r"))
    out = first.select("grupo", "_r.*").withColumn(
        "texto", F.replace(F.col("texto"), F.lit("{v}"), F.format_number(F.col("valor"), 2)))
    if limit is not None:
        out = out.orderBy("prioridad", "regla").limit(limit)
    return out


def metrics_table(spark: SparkSession, metrics: Mapping[str, Column]) -> DataFrame:
    """Named scalar metrics (scalar subqueries) as a long (metrica, valor) table."""
    wide = spark.range(1).select(*[c.cast("double").alias(k) for k, c in metrics.items()])
    stack = ", ".join(f"'{k}', `{k}`" for k in metrics)
    return wide.selectExpr(f"stack({len(metrics)}, {stack}) AS (metrica, valor)")


# Clinical findings (R6). (rule, metric, op, threshold, group, priority, text)
CLINICAL_FINDINGS = (
    ("ocupacion_critica", "ocupacion_pct", ">", 80.0, "ocupacion", 1, "Ocupación crítica: {v}% - activar plan de contingencia"),
    ("ocupacion_alta", "ocupacion_pct", ">", 70.0, "ocupacion", 2, "Ocupación alta: {v}% - optimizar egresos"),
    ("signos_anomalos", "anomalias_signos", ">", 0.0, "signos", 3, "{v} registros de signos vitales fuera de rango"),
    ("examenes_atipicos", "anomalias_examenes", ">", 0.0, "examenes", 4, "Auditar {v} exámenes con valores atípicos"),
    ("adultos_mayores", "adultos_mayores", ">", 5.0, "geriatria", 5, "Programa geriátrico para {v} adultos mayores"),
    ("alta_frecuencia", "alta_frecuencia", ">", 2.0, "frecuencia", 6, "Manejo crónico para {v} pacientes de alta frecuencia"),
    ("riesgo_ocular", "riesgo_alto_ocular", ">", 0.0, "ocular", 0, "{v} pacientes con alto riesgo de recaída ocular"),
)

# Finance evaluation.
FINANCE_FINDINGS = (
    ("r2_excelente", "mejor_r2", ">=", 0.9, "modelo", 1, "Modelo excelente (R2 = {v})"),
    ("r2_bueno", "mejor_r2", ">=", 0.7, "modelo", 2, "Modelo bueno (R2 = {v})"),
    ("r2_bajo", "mejor_r2", "<", 0.7, "modelo", 3, "Modelo mejorable (R2 = {v})"),
    ("ticket_bajo", "porcentaje_ticket_bajo", ">", 50.0, "ticket", 4, "Más de la mitad de los cargos son de ticket bajo ({v}%)"),
    ("segmento_premium", "max_media_segmento", ">", 400.0, "segmento", 5, "Existe un segmento de gasto medio alto ({v})"),
    ("corr_fuerte", "corr_cantidad_subtotal", ">", 0.8, "correlacion", 6, "Cantidad y subtotal muy correlacionados ({v})"),
    ("corr_debil", "corr_cantidad_subtotal", "<", 0.3, "correlacion", 7, "Cantidad y subtotal poco correlacionados ({v})"),
)


def clinical_findings(spark: SparkSession, metrics: DataFrame, limit: int = 10) -> DataFrame:
    """Clinical findings fired by the metrics, at most ``limit`` by priority."""
    return apply_rules(metrics, rule_table(spark, CLINICAL_FINDINGS, RULE_SCHEMA), limit)


def finance_findings(spark: SparkSession, metrics: DataFrame) -> DataFrame:
    """Finance evaluation sentences fired by the metrics."""
    return apply_rules(metrics, rule_table(spark, FINANCE_FINDINGS, RULE_SCHEMA))


def kdd_findings(band_revenue: DataFrame, band: str = "banda", amount: str = "total",
                 services: DataFrame | None = None, service: str = "servicio") -> DataFrame:
    """The most profitable band (``max_by``) and the most frequent service as sentences."""
    best = band_revenue.agg(F.max_by(F.col(band), F.struct(F.col(amount), F.col(band))).alias("valor"),
                            F.max(amount).cast("double").alias("monto"))
    out = best.select(F.lit("banda_mas_rentable").alias("hallazgo"), "valor",
                      F.format_string("La banda %s genera el mayor ingreso (%.2f)", F.col("valor"), F.col("monto"))
                      .alias("texto"))
    if services is not None:
        top = services.agg(F.max_by(F.col(service).cast("string"), F.struct(F.col("n"), F.col(service))).alias("valor"),
                           F.max("n").alias("n"))
        out = out.unionByName(top.select(F.lit("servicio_mas_frecuente").alias("hallazgo"), "valor",
                                         F.format_string("El servicio %s es el más frecuente (%d)", F.col("valor"),
                                                         F.col("n")).alias("texto")))
    return out


def role_guidance(rankings: Mapping[str, DataFrame]) -> DataFrame:
    """For each ranking (label, n) the argmax label, as one guidance row per topic."""
    out = None
    for topic, df in rankings.items():
        one = df.agg(F.max_by(F.col("etiqueta").cast("string"), F.struct(F.col("n"), F.col("etiqueta"))).alias("foco"),
                     F.max("n").cast("long").alias("n")).select(F.lit(topic).alias("tema"), "foco", "n")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("texto", F.format_string("Prioridad en %s: %s (%d)", F.col("tema"), F.col("foco"), F.col("n")))


def executive_summary(spark: SparkSession, metrics: Mapping[str, Column], models: DataFrame,
                      insights: DataFrame, n_insights: int = 5) -> DataFrame:
    """Headline numbers, best model by R2 only, and the first insights, as one table
    of (seccion, clave, valor) rows."""
    head = metrics_table(spark, metrics).select(F.lit("resumen").alias("seccion"), F.col("metrica").alias("clave"),
                                                F.format_number(F.col("valor"), 2).alias("valor"))
    best = models.agg(F.max_by(F.col("modelo"), F.struct(F.col("r2"), F.col("modelo"))).alias("valor")).select(
        F.lit("modelo").alias("seccion"), F.lit("mejor_modelo").alias("clave"), "valor")
    ins = insights.orderBy("prioridad", "regla").limit(n_insights).select(
        F.lit("hallazgos").alias("seccion"), F.col("regla").alias("clave"), F.col("texto").alias("valor"))
    return head.unionByName(best).unionByName(ins)

