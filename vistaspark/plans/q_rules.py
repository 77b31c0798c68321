"""Driver bindings for the scoring rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import classify
from ..operators import aggregates as A
from ..operators import rules as R
from ..operators.rules import RelapseRules
from . import vitals
from .bind import AS_OF_ORDERS, with_roles
from .q_aggregates import BIRTH_SQL, PROFILE_DEFAULT, PROFILE_RULES, age_sql, alert_sql, birth_dates, profile_case_sql
from .q_joins import PATIENT_FACTS_SQL, patient_facts
from .registry import query
from .sqlkit import contains_any, fold as sql_fold, money, pct, r6

# Binding parameters: catalogue words and ids of the star schema stand in for exam stems.
STAR_RULES = RelapseRules(
    ocular_ids=tuple(range(1, 16)), ocular_stems=("ring", "gear", "bolt", "plate"),
    retina_ids=(5, 7, 12, 13), retina_stems=("ring",),
    glaucoma_ids=(3, 6, 8, 14), glaucoma_stems=("bolt",),
    cornea_ids=(9, 10, 15), cornea_stems=("gear",),
    systemic_ids=(17, 18, 21, 25), systemic_stems=("widget", "anvil"),
    diagnosis_stems=("eau", "tion"),
)


def relapse_inputs(t):
    det = t.cargos.select(F.col("id_atencion").alias("id_examen"), "id_catalogo", "estado",
                          F.col("fecha").alias("fecha_realizado"))
    # the exam header of this binding is the attention itself, so it carries the patient
    headers = t.atencion.select(F.col("id_atencion").alias("id_examen"), "id_atencion", "Id_exp",
                                F.col("fecha_ing").alias("fecha"))
    atts = t.atencion.select("id_atencion", "Id_exp")
    diags = t.diagnosticos.select(F.col("id_diagnostico").alias("id_atencion"), "texto")
    return det, headers, atts, diags


def relapse(t):
    det, headers, atts, diags = relapse_inputs(t)
    cat = t.catalogo.select("id_catalogo", F.col("nombre").alias("nombre_examen"))
    return R.relapse_risk(det, headers, atts, diags, STAR_RULES, AS_OF_ORDERS, catalogue=cat)


def _hit_sql(ids, stems) -> str:
    return (f"(COALESCE(cat IN ({', '.join(str(i) for i in ids)}), FALSE) OR "
            f"{contains_any('nm', [s.upper() for s in stems])})")


def _steps_sql(c: str, steps) -> str:
    return "CASE " + " ".join(f"WHEN {c} >= {lim} THEN {pts}" for lim, pts in steps) + " ELSE 0 END"


_COUNTS = ["total_examenes_oculares", "tipos_examenes_oculares", "examenes_realizados", "examenes_pendientes",
           "estudios_retina", "estudios_glaucoma", "estudios_corneales", "examenes_repetidos",
           "marcadores_sistemicos", "diagnostico_ocular", "total_diagnosticos"]
S = STAR_RULES
RELAPSE_SQL = f"""
{with_roles('cargos', 'catalogo', 'atencion', 'diagnosticos')},
det AS (SELECT d.id_atencion AS id_examen, d.id_catalogo, d.estado, d.fecha AS fecha_realizado, c.nombre AS nombre_examen
        FROM cargos d LEFT JOIN catalogo c USING (id_catalogo)),
d AS (SELECT det.*, h.fecha_examen, a.Id_exp, TRY_CAST(det.id_catalogo AS INTEGER) AS cat, {sql_fold('det.nombre_examen')} AS nm,
             upper(COALESCE(det.estado, '')) AS st, CAST(COALESCE(det.fecha_realizado, h.fecha_examen) AS DATE) AS dt
      FROM det LEFT JOIN (SELECT id_atencion AS id_examen, id_atencion, fecha_ing AS fecha_examen FROM atencion) h USING (id_examen)
      LEFT JOIN (SELECT id_atencion, Id_exp FROM atencion) a ON h.id_atencion = a.id_atencion
      WHERE a.Id_exp IS NOT NULL),
oc AS (SELECT Id_exp, COUNT(*) AS total_examenes_oculares, COUNT(DISTINCT nombre_examen) AS tipos_examenes_oculares,
              COUNT(*) FILTER (WHERE st = 'REALIZADO') AS examenes_realizados,
              COUNT(*) FILTER (WHERE st = 'PENDIENTE') AS examenes_pendientes,
              COUNT(*) FILTER (WHERE {_hit_sql(S.retina_ids, S.retina_stems)}) AS estudios_retina,
              COUNT(*) FILTER (WHERE {_hit_sql(S.glaucoma_ids, S.glaucoma_stems)}) AS estudios_glaucoma,
              COUNT(*) FILTER (WHERE {_hit_sql(S.cornea_ids, S.cornea_stems)}) AS estudios_corneales,
              MIN(dt) AS primer_estudio, MAX(dt) AS ultimo_estudio
       FROM d WHERE {_hit_sql(S.ocular_ids, S.ocular_stems)} GROUP BY Id_exp),
sy AS (SELECT Id_exp, COUNT(*) AS marcadores_sistemicos FROM d WHERE {_hit_sql(S.systemic_ids, S.systemic_stems)} GROUP BY Id_exp),
dg AS (SELECT a.Id_exp,
              MAX(CASE WHEN {contains_any(sql_fold("concat_ws(' ', COALESCE(x.texto, ''))"), [s.upper() for s in S.diagnosis_stems])}
                  THEN 1 ELSE 0 END) AS diagnostico_ocular, COUNT(*) AS total_diagnosticos
       FROM (SELECT id_diagnostico AS id_atencion, texto FROM diagnosticos) x
       LEFT JOIN (SELECT id_atencion, Id_exp FROM atencion) a USING (id_atencion) WHERE a.Id_exp IS NOT NULL GROUP BY a.Id_exp),
base AS (SELECT DISTINCT Id_exp FROM atencion WHERE Id_exp IS NOT NULL),
r0 AS (SELECT base.Id_exp, oc.primer_estudio, oc.ultimo_estudio, oc.total_examenes_oculares, oc.tipos_examenes_oculares,
              oc.examenes_realizados, oc.examenes_pendientes, oc.estudios_retina, oc.estudios_glaucoma,
              oc.estudios_corneales, oc.total_examenes_oculares - oc.tipos_examenes_oculares AS examenes_repetidos,
              sy.marcadores_sistemicos, dg.diagnostico_ocular, dg.total_diagnosticos
       FROM base LEFT JOIN oc USING (Id_exp) LEFT JOIN sy USING (Id_exp) LEFT JOIN dg USING (Id_exp)),
r AS (SELECT Id_exp, primer_estudio, ultimo_estudio, {', '.join(f'CAST(COALESCE({c}, 0) AS BIGINT) AS {c}' for c in _COUNTS)} FROM r0),
s AS (SELECT *, CAST({_steps_sql('total_examenes_oculares', [(5, 3), (3, 2), (1, 1)])}
                 + {_steps_sql('estudios_retina', [(2, 2), (1, 1)])} + {_steps_sql('estudios_glaucoma', [(2, 2), (1, 1)])}
                 + {_steps_sql('estudios_corneales', [(2, 2), (1, 1)])}
                 + CASE WHEN examenes_repetidos >= 1 THEN 2 ELSE 0 END + CASE WHEN examenes_pendientes >= 3 THEN 1 ELSE 0 END
                 + CASE WHEN diagnostico_ocular = 1 THEN 2 ELSE 0 END + CASE WHEN marcadores_sistemicos >= 2 THEN 1 ELSE 0 END
                 AS INTEGER) AS score_recaida FROM r),
risk AS (SELECT *,
       CASE WHEN score_recaida >= 8 THEN 'ALTO' WHEN score_recaida >= 4 THEN 'MEDIO' ELSE 'BAJO' END AS nivel_riesgo_recaida,
       CASE WHEN estudios_retina >= estudios_glaucoma AND estudios_retina >= estudios_corneales AND estudios_retina > 0
              THEN 'Retina/Mácula'
            WHEN estudios_glaucoma >= estudios_retina AND estudios_glaucoma >= estudios_corneales AND estudios_glaucoma > 0
              THEN 'Glaucoma/Nervio óptico'
            WHEN estudios_corneales > 0 THEN 'Córnea' ELSE 'Sin perfil ocular dominante' END AS perfil_principal,
       concat_ws(', ', CASE WHEN estudios_retina > 0 THEN 'Retina/Mácula' END,
                       CASE WHEN estudios_glaucoma > 0 THEN 'Glaucoma/Nervio óptico' END,
                       CASE WHEN estudios_corneales > 0 THEN 'Córnea' END,
                       CASE WHEN marcadores_sistemicos > 0 THEN 'Metabólico' END) AS factores_detectados,
       CAST(date_diff('day', ultimo_estudio, DATE '{AS_OF_ORDERS}') AS INTEGER) AS dias_desde_ultimo_estudio
FROM s)"""


@query("r1_relapse_risk", sql=RELAPSE_SQL + "\nSELECT * FROM risk")
def r1(t):
    return relapse(t)


@query("r1_relapse_summary", sql=RELAPSE_SQL + f"""
SELECT nivel_riesgo_recaida, COUNT(*) AS pacientes, {r6('AVG(total_examenes_oculares)')} AS promedio_examenes,
       CAST(SUM(total_examenes_oculares) AS BIGINT) AS total_examenes,
       COUNT(*) FILTER (WHERE total_examenes_oculares > 0) AS con_examen_ocular
FROM risk GROUP BY nivel_riesgo_recaida""")
def r1s(t):
    return R.relapse_summary(relapse(t))


# binding: event values as lab results, limits (medium, high) per test
LAB_LIMITS = {"click": (100.0, 126.0), "view": (5.7, 6.5), "signup": (100.0, 126.0), "purchase": (180.0, 200.0)}


@query("r2_threshold_risk", sql=f"""
{with_roles('signos')},
m AS (SELECT id_usuario AS Id_exp, signo AS prueba, MAX(valor) AS valor_max FROM signos GROUP BY 1, 2),
l AS (SELECT * FROM (VALUES {', '.join(f"('{k}', CAST({m} AS DOUBLE), CAST({h} AS DOUBLE))" for k, (m, h) in LAB_LIMITS.items())})
      AS v(prueba, limite_medio, limite_alto))
SELECT m.prueba, m.Id_exp, m.valor_max, l.limite_medio, l.limite_alto,
       CASE WHEN valor_max >= limite_alto THEN 'ALTO' WHEN valor_max >= limite_medio THEN 'MEDIO' ELSE 'BAJO' END AS nivel
FROM m JOIN l USING (prueba)
""")
def r2(t):
    labs = t.signos.select(F.col("id_usuario").alias("Id_exp"), F.col("signo").alias("prueba"), "valor")
    return R.threshold_risk(labs, LAB_LIMITS)


def bed_occupancy(t):
    """Binding: the open attentions whose lines name a supplier occupy that supplier's bed. Several
    lines may repeat a pair: ``bed_status`` takes the newest attention of a bed all the same."""
    open_att = t.atencion.filter("status = 'ABIERTA'").select("id_atencion", "fecha_ing")
    return t.cargos.select(F.col("id_medico").alias("id_cama"), "id_atencion").join(open_att, "id_atencion")


BED_SQL = """
occ AS (SELECT DISTINCT d.id_medico AS id_cama, d.id_atencion, a.fecha_ing FROM cargos d
        JOIN atencion a USING (id_atencion) WHERE a.status = 'ABIERTA'),
cur AS (SELECT id_cama, id_atencion AS id_atencion_actual, fecha_ing AS ocupada_desde FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY id_cama ORDER BY fecha_ing DESC, id_atencion DESC) AS rn FROM occ)
        WHERE rn = 1),
bs AS (SELECT c.*, cur.id_atencion_actual, cur.ocupada_desde,
              CASE WHEN cur.id_atencion_actual IS NOT NULL THEN 'OCUPADA'
                   WHEN COALESCE(c.ocupada, 0) = 1 THEN 'MANTENIMIENTO' ELSE 'LIBRE' END AS estado_cama
       FROM camas c LEFT JOIN cur USING (id_cama))"""


@query("r3_bed_status", sql=f"""
{with_roles('camas', 'cargos', 'atencion')}, {BED_SQL}
SELECT * FROM bs
""")
def r3(t):
    return R.bed_status(t.camas, bed_occupancy(t))


def patient_features_basic(t):
    """age (calendar rule from first attention), visits, studies, amount, diagnoses per patient."""
    visits, amount = patient_facts(t)
    b = birth_dates(t).select("Id_exp", R_age("fecnac").alias("edad"))
    diags = (t.diagnosticos.select(F.col("id_diagnostico").alias("id_atencion"))
             .join(t.atencion.select("id_atencion", "Id_exp"), "id_atencion")
             .groupBy("Id_exp").agg(F.count(F.lit(1)).alias("diagnosticos")))
    base = t.pacientes.select("Id_exp")
    out = base.join(b, "Id_exp", "left").join(visits, "Id_exp", "left").join(amount, "Id_exp", "left") \
        .join(diags, "Id_exp", "left")
    return out.select("Id_exp", "edad",
                      F.coalesce("visitas", F.lit(0)).cast("long").alias("visitas"),
                      F.coalesce("estudios", F.lit(0)).cast("long").alias("estudios"),
                      F.coalesce(F.col("monto").cast("double"), F.lit(0.0)).alias("monto"),
                      F.coalesce("diagnosticos", F.lit(0)).cast("long").alias("diagnosticos"))


def R_age(c):
    from ..functions.dates import age_calendar
    return age_calendar(c, AS_OF_ORDERS)


FEATURES_SQL = f"""
{PATIENT_FACTS_SQL},
b AS (SELECT Id_exp, {age_sql('fecnac', "DATE '2001-12-01'")} AS edad FROM ({BIRTH_SQL})),
dx AS (SELECT a.Id_exp, COUNT(*) AS diagnosticos FROM diagnosticos x JOIN atencion a ON x.id_diagnostico = a.id_atencion
       GROUP BY a.Id_exp),
feat AS (SELECT p.Id_exp, b.edad, CAST(COALESCE(v.visitas, 0) AS BIGINT) AS visitas,
                CAST(COALESCE(m.estudios, 0) AS BIGINT) AS estudios, COALESCE(CAST(m.monto AS DOUBLE), 0.0) AS monto,
                CAST(COALESCE(dx.diagnosticos, 0) AS BIGINT) AS diagnosticos
         FROM pacientes p LEFT JOIN b USING (Id_exp) LEFT JOIN v USING (Id_exp) LEFT JOIN m USING (Id_exp)
         LEFT JOIN dx USING (Id_exp))"""


@query("r4_cluster_profile", sql=f"""
{with_roles('pacientes', 'atencion', 'cargos', 'diagnosticos')}, {FEATURES_SQL}
SELECT Id_exp, concat_ws(' | ',
  CASE WHEN edad >= 65 THEN 'Adulto Mayor' WHEN edad >= 40 THEN 'Adulto' ELSE 'Joven' END,
  CASE WHEN visitas >= 5 THEN 'Alta Frecuencia' WHEN visitas >= 2 THEN 'Frecuencia Media' ELSE 'Baja Frecuencia' END,
  CASE WHEN diagnosticos >= 3 AND estudios >= 5 THEN 'Alta Complejidad'
       WHEN diagnosticos >= 1 AND estudios >= 2 THEN 'Complejidad Media' ELSE 'Complejidad Baja' END,
  CASE WHEN monto >= 500000 THEN 'Alto Gasto' WHEN monto >= 100000 THEN 'Gasto Medio' ELSE 'Bajo Gasto' END) AS perfil
FROM feat
""")
def r4(t):
    f = patient_features_basic(t)
    return f.select("Id_exp", R.cluster_profile(F.col("edad"), F.col("visitas"), F.col("estudios"),
                                                F.col("diagnosticos"), F.col("monto")).alias("perfil"))


@query("r5_segment_name", sql=f"""
{with_roles('pacientes', 'atencion', 'cargos', 'diagnosticos')}, {FEATURES_SQL}
SELECT Id_exp, CASE WHEN visitas > 2 THEN 'ALTA FRECUENCIA' WHEN edad > 50 THEN 'ADULTO MAYOR'
                    ELSE 'BAJA FRECUENCIA' END AS segmento FROM feat
""")
def r5(t):
    f = patient_features_basic(t)
    return f.select("Id_exp", R.segment_name(F.col("visitas"), F.col("edad")).alias("segmento"))


def clinical_metrics(t):
    from ..operators.filters import out_of_range
    from ..operators.windows import sigma_outliers
    f = patient_features_basic(t)
    risk = relapse(t)
    one = lambda df: df.select(F.count(F.lit(1))).scalar()
    from ..functions.numbers import pct as pct_
    # both patient segments come from one pass over the feature table
    seg = f.agg(F.struct(F.count_if((F.col("visitas") <= 2) & (F.col("edad") > 50)).alias("mayores"),
                         F.count_if(F.col("visitas") > 2).alias("frecuentes"))).scalar()
    return R.metrics_table(t.spark, {
        "ocupacion_pct": t.camas.select(pct_(F.count_if(F.col("ocupada") == 1), F.count(F.lit(1)))).scalar(),
        "anomalias_signos": one(out_of_range(vitals.wide(t.signos), vitals.RANGES)),
        "anomalias_examenes": one(sigma_outliers(t.cargos, "id_catalogo", "subtotal", 2.0)),
        "adultos_mayores": seg["mayores"],
        "alta_frecuencia": seg["frecuentes"],
        "riesgo_alto_ocular": risk.select(F.count_if(F.col("nivel_riesgo_recaida") == "ALTO")).scalar(),
    })


def _rules_values_sql(rows) -> str:
    vals = ", ".join("('" + "', '".join([r[0], r[1], r[2]]) + f"', {r[3]}, '{r[4]}', {r[5]}, '{r[6]}')" for r in rows)
    return f"SELECT * FROM (VALUES {vals}) AS v(regla, metrica, op, umbral, grupo, prioridad, texto)"


def _fired_ctes(metrics_cte: str, rules_rows) -> str:
    return f"""
rules AS ({_rules_values_sql(rules_rows)}),
fired AS (SELECT r.*, m.valor FROM {metrics_cte} m JOIN rules r USING (metrica)
          WHERE CASE r.op WHEN '>' THEN m.valor > r.umbral WHEN '>=' THEN m.valor >= r.umbral
                          WHEN '<' THEN m.valor < r.umbral WHEN '<=' THEN m.valor <= r.umbral
                          WHEN '==' THEN m.valor = r.umbral ELSE FALSE END),
fr1 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY grupo ORDER BY prioridad, regla) AS rn FROM fired)
        WHERE rn = 1),
ins AS (SELECT grupo, regla, metrica, valor, prioridad, replace(texto, '{{v}}', format('{{:,.2f}}', valor)) AS texto
        FROM fr1)"""


def _fire_sql(metrics_cte: str, rules_rows, limit: int | None) -> str:
    lim = f"ORDER BY prioridad, regla LIMIT {limit}" if limit else ""
    return _fired_ctes(metrics_cte, rules_rows) + f"\nSELECT * FROM ins {lim}"


def _clinical_metrics_sql() -> str:
    from .q_filters import _oor_sql
    # RELAPSE_SQL starts with its own WITH clause; reuse its CTE body after the roles
    relapse_ctes = RELAPSE_SQL.split("det AS (", 1)[1]
    return f"""
{with_roles('pacientes', 'atencion', 'cargos', 'diagnosticos', 'catalogo', 'camas', 'signos')}, {FEATURES_SQL},
det AS ({relapse_ctes},
w AS ({vitals.wide_sql()}),
st AS (SELECT id_catalogo, AVG(subtotal) AS media, STDDEV_SAMP(subtotal) AS sd FROM cargos GROUP BY id_catalogo),
mt AS (
  SELECT 'ocupacion_pct' AS metrica, CAST((SELECT {pct("COUNT(*) FILTER (WHERE ocupada = 1)", "COUNT(*)")} FROM camas) AS DOUBLE) AS valor
  UNION ALL SELECT 'anomalias_signos', CAST((SELECT COUNT(*) FROM w WHERE {_oor_sql()}) AS DOUBLE)
  UNION ALL SELECT 'anomalias_examenes', CAST((SELECT COUNT(*) FROM cargos d JOIN st USING (id_catalogo)
                  WHERE st.sd IS NOT NULL AND ABS(d.subtotal - st.media) > 2.0 * st.sd) AS DOUBLE)
  UNION ALL SELECT 'adultos_mayores', CAST((SELECT COUNT(*) FROM feat WHERE visitas <= 2 AND edad > 50) AS DOUBLE)
  UNION ALL SELECT 'alta_frecuencia', CAST((SELECT COUNT(*) FROM feat WHERE visitas > 2) AS DOUBLE)
  UNION ALL SELECT 'riesgo_alto_ocular', CAST((SELECT COUNT(*) FROM risk WHERE nivel_riesgo_recaida = 'ALTO') AS DOUBLE))"""


@query("r6_clinical_findings", sql=_clinical_metrics_sql() + "," + _fire_sql("mt", R.CLINICAL_FINDINGS, 10))
def r6q(t):
    return R.clinical_findings(t.spark, clinical_metrics(t), 10)


def finance_metrics(t):
    c = t.cargos
    from ..functions.numbers import pct as pct_
    best_r2 = c.select(F.regr_r2("subtotal", "cantidad")).scalar()
    seg_mean = c.groupBy("tipo").agg(F.avg("subtotal").alias("m")).select(F.max("m")).scalar()
    corr = c.select(F.try_divide(F.covar_samp("cantidad", "subtotal"),
                                 F.stddev_samp("cantidad") * F.stddev_samp("subtotal"))).scalar()
    return R.metrics_table(t.spark, {
        "mejor_r2": F.round(best_r2, 6),
        "porcentaje_ticket_bajo": c.select(pct_(F.count_if(F.col("subtotal") < 20000), F.count(F.lit(1)))).scalar(),
        "max_media_segmento": F.round(seg_mean, 6),
        "corr_cantidad_subtotal": F.round(corr, 6),
    })


FINANCE_METRICS_SQL = f"""
{with_roles('cargos')},
mt AS (
  SELECT 'mejor_r2' AS metrica, (SELECT ROUND(regr_r2(subtotal, cantidad), 6) FROM cargos) AS valor
  UNION ALL SELECT 'porcentaje_ticket_bajo', (SELECT {pct("COUNT(*) FILTER (WHERE subtotal < 20000)", "COUNT(*)")} FROM cargos)
  UNION ALL SELECT 'max_media_segmento', (SELECT ROUND(MAX(m), 6) FROM (SELECT AVG(subtotal) AS m FROM cargos GROUP BY tipo))
  UNION ALL SELECT 'corr_cantidad_subtotal', (SELECT ROUND(COVAR_SAMP(cantidad, subtotal) /
                   NULLIF(STDDEV_SAMP(cantidad) * STDDEV_SAMP(subtotal), 0), 6) FROM cargos))"""


@query("r7_finance_findings", sql=FINANCE_METRICS_SQL + "," + _fire_sql("mt", R.FINANCE_FINDINGS, None))
def r7(t):
    return R.finance_findings(t.spark, finance_metrics(t))


@query("r8_kdd_findings", sql=f"""
{with_roles('cargos')},
b AS (SELECT CASE WHEN precio IS NULL THEN NULL WHEN precio < 1000.0 THEN 'Bajo' WHEN precio < 1500.0 THEN 'Medio'
                  ELSE 'Alto' END AS banda, {money('subtotal')} AS total FROM cargos GROUP BY 1),
s AS (SELECT id_catalogo AS servicio, COUNT(*) AS n FROM cargos GROUP BY 1),
bb AS (SELECT banda, total FROM b ORDER BY total DESC, banda DESC LIMIT 1),
ss AS (SELECT servicio, n FROM s ORDER BY n DESC, servicio DESC LIMIT 1)
SELECT 'banda_mas_rentable' AS hallazgo, banda AS valor,
       printf('La banda %s genera el mayor ingreso (%.2f)', banda, CAST(total AS DOUBLE)) AS texto FROM bb
UNION ALL
SELECT 'servicio_mas_frecuente', CAST(servicio AS VARCHAR), printf('El servicio %s es el más frecuente (%d)', CAST(servicio AS VARCHAR), n) FROM ss
""")
def r8(t):
    from ..operators.filters import band
    from ..operators._common import money_sum
    c = t.cargos
    bands = c.groupBy(band("precio", (1000.0, 1500.0)).alias("banda")).agg(money_sum("subtotal").alias("total"))
    services = A.value_counts(c, "id_catalogo").withColumnRenamed("id_catalogo", "servicio")
    return R.kdd_findings(bands, services=services)


@query("r9_role_guidance", sql=f"""
{with_roles('cargos', 'catalogo', 'pacientes', 'atencion', 'signos')}, w AS ({vitals.with_pressure_sql()}),
ex AS (SELECT c.nombre, COUNT(*) AS n FROM cargos d JOIN catalogo c USING (id_catalogo) GROUP BY 1),
rk AS (
  SELECT 'perfil' AS tema, {profile_case_sql(sql_fold('nombre'))} AS etiqueta, CAST(SUM(n) AS BIGINT) AS n FROM ex GROUP BY 2
  UNION ALL SELECT 'alerta', signo, alertas FROM ({alert_sql()})
  UNION ALL SELECT 'estudio', nombre, n FROM ex
  UNION ALL SELECT 'area', p.area, COUNT(*) FROM atencion a JOIN pacientes p USING (Id_exp) GROUP BY p.area
  UNION ALL SELECT 'mes', strftime(fecha_ing, '%Y-%m'), COUNT(*) FROM atencion GROUP BY 2),
best AS (SELECT tema, etiqueta AS foco, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tema ORDER BY n DESC, etiqueta DESC) AS rn FROM rk) WHERE rn = 1)
SELECT tema, foco, n, printf('Prioridad en %s: %s (%d)', tema, foco, n) AS texto FROM best
""")
def r9(t):
    cnt = lambda df, c: df.groupBy(F.col(c).alias("etiqueta")).agg(F.count(F.lit(1)).alias("n"))
    # charges are counted per item before they meet the catalogue
    items = A.value_counts(t.cargos, "id_catalogo").join(t.catalogo.select("id_catalogo", "nombre"), "id_catalogo")
    exams = items.groupBy(F.col("nombre").alias("etiqueta")).agg(F.sum("n").alias("n"))
    profiles = exams.groupBy(classify("etiqueta", PROFILE_RULES, PROFILE_DEFAULT).alias("etiqueta")).agg(F.sum("n").alias("n"))
    alerts = A.alert_rates(vitals.with_pressure(t.signos), vitals.SINGLE, vitals.PRESSURES).select(F.col("signo").alias("etiqueta"), F.col("alertas").alias("n"))
    area = t.atencion.select("Id_exp").join(t.pacientes.select("Id_exp", "area"), "Id_exp")
    month = t.atencion.select(F.date_format("fecha_ing", "yyyy-MM").alias("mes"))
    return R.role_guidance({"perfil": profiles, "alerta": alerts, "estudio": exams, "area": cnt(area, "area"),
                            "mes": cnt(month, "mes")})


@query("r10_executive_summary", sql=FINANCE_METRICS_SQL + "," + _fired_ctes("mt", R.FINANCE_FINDINGS) + f"""
SELECT 'resumen' AS seccion, 'filas' AS clave, format('{{:,.2f}}', CAST((SELECT COUNT(*) FROM cargos) AS DOUBLE)) AS valor
UNION ALL SELECT 'resumen', 'ingreso', format('{{:,.2f}}', CAST((SELECT {money('subtotal')} FROM cargos) AS DOUBLE))
UNION ALL SELECT 'modelo', 'mejor_modelo', (SELECT modelo FROM (VALUES
      ('lineal_cantidad', (SELECT ROUND(regr_r2(subtotal, cantidad), 6) FROM cargos)),
      ('lineal_precio', (SELECT ROUND(regr_r2(subtotal, precio), 6) FROM cargos))) AS m(modelo, r2)
      ORDER BY r2 DESC, modelo DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'hallazgos', regla, texto FROM ins ORDER BY prioridad, regla LIMIT 5)
""")
def r10(t):
    c = t.cargos
    from ..operators._common import money_sum
    models = t.spark.range(1).select(F.explode(F.array(
        F.struct(F.lit("lineal_cantidad").alias("modelo"), F.round(c.select(F.regr_r2("subtotal", "cantidad")).scalar(), 6).alias("r2")),
        F.struct(F.lit("lineal_precio").alias("modelo"), F.round(c.select(F.regr_r2("subtotal", "precio")).scalar(), 6).alias("r2")),
    )).alias("m")).select("m.*")
    insights = R.finance_findings(t.spark, finance_metrics(t))
    return R.executive_summary(t.spark, {
        "filas": c.select(F.count(F.lit(1))).scalar(),
        "ingreso": c.select(money_sum("subtotal")).scalar(),
    }, models, insights, 5)
