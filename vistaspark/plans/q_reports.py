"""Driver bindings for the report views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as AR
from ..functions.dates import age_calendar
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import rules as R
from ..operators import windows as W
from ..operators.filters import in_or_blank
from . import reports, vitals
from .bind import AS_OF_ORDERS, with_roles
from .dashboard import DashboardFilters, dashboard
from .q_aggregates import BIRTH_SQL, OCULAR_WORDS, PROFILE_DEFAULT, PROFILE_RULES, age_sql, alert_sql, birth_dates, profile_case_sql
from .q_joins import LINE_ORDER
from .q_rules import BED_SQL, STAR_RULES, bed_occupancy
from .registry import query
from .sqlkit import contains_any, fold as sql_fold, money, pct, r6

ROLES_ALL = ("atencion", "pacientes", "cargos", "catalogo", "camas")


# ---------------------------------------------------------------- shared bindings
def att_area(t):
    return t.atencion.join(t.pacientes.select("Id_exp", "area"), "Id_exp", "left")


def pat_age(t):
    return reports.with_age(t.pacientes, birth_dates(t), AS_OF_ORDERS)


def bed_states(t):
    return R.bed_status(t.camas, bed_occupancy(t))


def beds_of_att(t):
    return reports.bed_of_attention(bed_states(t))


def first_doctor(t):
    fd = J.first_match(t.atencion.select("id_atencion"), t.cargos, "id_atencion", LINE_ORDER, ["id_medico"], how="inner")
    return fd.withColumnRenamed("id_medico", "medico_principal")


SHARED_SQL = f"""
aa AS (SELECT a.*, p.area FROM atencion a LEFT JOIN pacientes p USING (Id_exp)),
pa AS (SELECT p.*, b.fecnac, {age_sql('b.fecnac', "DATE '2001-12-01'")} AS edad FROM pacientes p
       LEFT JOIN ({BIRTH_SQL}) b USING (Id_exp)),
{BED_SQL},
bo AS (SELECT id_atencion_actual AS id_atencion, MIN(id_cama) AS id_cama FROM cur GROUP BY 1),
fd AS (SELECT id_atencion, id_medico AS medico_principal FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY id_atencion ORDER BY linea, id_catalogo, id_medico, subtotal) AS rn
         FROM cargos) WHERE rn = 1)"""
PRE = with_roles(*ROLES_ALL) + "," + SHARED_SQL


@query("v1_open_by_area", sql=f"""
{PRE}
SELECT a.id_atencion, a.Id_exp, a.area, a.fecha_ing, p.nombre, p.edad, c.numero AS num_cama
FROM aa a JOIN pa p USING (Id_exp) LEFT JOIN bo USING (id_atencion) LEFT JOIN camas c ON bo.id_cama = c.id_cama
WHERE a.status = 'ABIERTA' AND a.area = 'BUILDING'
""")
def v1(t):
    return reports.open_by_area(att_area(t), pat_age(t), beds_of_att(t), t.camas, "BUILDING")


@query("v2_patient_documents", sql=f"""
{with_roles('atencion', 'pacientes')}
SELECT a.Id_exp, p.nombre, a.id_atencion, a.status, strftime(a.fecha_ing, '%d/%m/%Y') AS fecha
FROM atencion a JOIN pacientes p USING (Id_exp)
""")
def v2(t):
    return reports.patient_documents(t.atencion, t.pacientes)


@query("v3_discharges", sql=f"""
{with_roles('atencion', 'pacientes')}
SELECT a.id_atencion, a.Id_exp, a.fecha_ing AS fecha_alta, CAST(a.monto AS DECIMAL(18,2)) AS total_cuenta,
       trim(concat_ws(' ', p.area, p.nombre)) AS paciente
FROM atencion a LEFT JOIN pacientes p USING (Id_exp) WHERE a.status = 'CERRADA'
""")
def v3(t):
    return reports.discharges(t.atencion, t.pacientes)


@query("v4_account_lines", sql=f"""
{with_roles('cargos', 'atencion')},
g AS (SELECT d.id_atencion, d.linea, CAST(GROUPING(d.id_atencion, d.linea) AS INTEGER) AS nivel, {money('d.subtotal')} AS subtotal
      FROM cargos d WHERE d.id_atencion IN (SELECT id_atencion FROM atencion WHERE status = 'ABIERTA')
      GROUP BY ROLLUP (d.id_atencion, d.linea))
SELECT id_atencion, linea, nivel, subtotal,
       CAST(ROUND(subtotal * CAST(0.16 AS DECIMAL(4,2)), 2) AS DECIMAL(38,2)) AS iva,
       CAST(subtotal + CAST(ROUND(subtotal * CAST(0.16 AS DECIMAL(4,2)), 2) AS DECIMAL(38,2)) AS DECIMAL(38,2)) AS total
FROM g
""")
def v4(t):
    open_ids = t.atencion.filter("status = 'ABIERTA'").select("id_atencion")
    return A.accounts_with_total(t.cargos.join(open_ids, "id_atencion", "left_semi"), "id_atencion", "linea")


@query("v5_bed_board", sql=f"""
{PRE}
SELECT bs.area AS seccion, bs.id_cama, bs.numero, bs.estado_cama, bs.id_atencion_actual, p.nombre AS paciente
FROM bs LEFT JOIN atencion a ON bs.id_atencion_actual = a.id_atencion LEFT JOIN pacientes p ON a.Id_exp = p.Id_exp
""")
def v5(t):
    return reports.bed_board(bed_states(t), t.atencion, t.pacientes)


OUTPATIENT, EMERGENCY, WARD = "BUILDING", "ASIA", "EUROPE"  # areas of attentions, and of beds


def _bed_section_sql(name: str, area: str) -> str:
    return f"""SELECT '{name}' AS seccion, c.id_cama, c.numero, CASE WHEN o.id_atencion IS NULL THEN 'LIBRE' ELSE 'OCUPADA' END AS estatus,
       o.id_atencion, p.Id_exp, p.nombre AS paciente, o.id_atencion IS NOT NULL AS tiene_atencion
FROM camas c LEFT JOIN occ o USING (id_cama) LEFT JOIN atencion a ON a.id_atencion = o.id_atencion LEFT JOIN pacientes p ON p.Id_exp = a.Id_exp
WHERE c.area = '{area}'"""


@query("v5_bed_sections", sql=f"""
{PRE}
SELECT 'consulta' AS seccion, CAST(NULL AS BIGINT) AS id_cama, 'Consulta ' || CAST(a.id_atencion AS VARCHAR) AS numero, 'OCUPADA' AS estatus,
       a.id_atencion, p.Id_exp, p.nombre AS paciente, TRUE AS tiene_atencion
FROM aa a JOIN pacientes p USING (Id_exp) WHERE a.status = 'ABIERTA' AND a.area = '{OUTPATIENT}'
UNION ALL {_bed_section_sql('urgencias', EMERGENCY)}
UNION ALL {_bed_section_sql('hospitalizado', WARD)}
""")
def v5_sections(t):
    from .q_rules import bed_occupancy

    return reports.bed_sections(att_area(t), t.pacientes, t.camas, bed_occupancy(t), OUTPATIENT, EMERGENCY, WARD)


@query("v6_patient_sheet", sql=f"""
{PRE}
SELECT a.id_atencion, a.Id_exp, a.fecha_ing, a.especialidad, p.nombre, p.area, fd.medico_principal, bo.id_cama
FROM atencion a JOIN pacientes p USING (Id_exp) LEFT JOIN fd USING (id_atencion) LEFT JOIN bo USING (id_atencion)
WHERE a.status = 'ABIERTA'
""")
def v6(t):
    return reports.patient_sheet(t.atencion, t.pacientes, first_doctor(t), beds_of_att(t))


@query("v7_attention_doctors", sql=f"""
{with_roles('cargos', 'camas')}
SELECT DISTINCT d.id_atencion, d.id_medico, c.numero AS medico FROM cargos d JOIN camas c ON d.id_medico = c.id_cama
""")
def v7(t):
    pairs = t.cargos.select("id_atencion", "id_medico").distinct()
    return J.inner(pairs, t.camas.select(F.col("id_cama").alias("id_medico"), F.col("numero").alias("medico")),
                   "id_medico")


@query("v8_study_results", sql=f"""
{with_roles('cargos', 'catalogo', 'atencion', 'pacientes')},
d AS (SELECT d.id_atencion, d.linea, c.nombre AS examen, c.tipo AS tipo_examen, d.estado
      FROM cargos d JOIN catalogo c USING (id_catalogo)),
n AS (SELECT id_atencion, tipo_examen,
             string_agg(CAST(linea AS VARCHAR) || ':' || examen || ':' || estado, ';' ORDER BY linea, examen, estado) AS detalles
      FROM d GROUP BY id_atencion, tipo_examen)
SELECT n.*, a.Id_exp, p.nombre AS paciente FROM n LEFT JOIN atencion a USING (id_atencion)
LEFT JOIN pacientes p ON a.Id_exp = p.Id_exp
""")
def v8(t):
    r = reports.study_results(t.cargos, t.catalogo, t.atencion, t.pacientes)
    return r.withColumn("detalles", F.array_join(F.transform("detalles", lambda x: F.concat_ws(
        ":", x["linea"].cast("string"), x["examen"], x["estado"])), ";"))


@query("v9_exam_details_by_type", sql=f"""
{with_roles('cargos', 'catalogo')}
SELECT d.id_atencion, d.linea, d.id_catalogo, c.nombre AS examen, d.estado, d.fecha
FROM cargos d JOIN catalogo c USING (id_catalogo) WHERE c.tipo = 'PROMO'
""")
def v9(t):
    cat = t.catalogo.filter("tipo = 'PROMO'").select("id_catalogo", F.col("nombre").alias("examen"))
    return J.inner(t.cargos.select("id_atencion", "linea", "id_catalogo", "estado", "fecha"), cat, "id_catalogo")


@query("v10_budget_lines", sql=f"""
{with_roles('cargos', 'catalogo', 'atencion')},
l AS (SELECT d.id_atencion, d.linea, d.id_catalogo, d.cantidad FROM cargos d
      WHERE d.id_atencion IN (SELECT id_atencion FROM atencion WHERE status = 'ABIERTA')),
j AS (SELECT l.*, c.nombre AS servicio, c.precio AS precio_lista,
             CAST(CAST(c.precio AS DECIMAL(18,2)) * CAST(l.cantidad AS DECIMAL(18,2)) AS DECIMAL(38,2)) AS subtotal
      FROM l JOIN catalogo c USING (id_catalogo))
SELECT *, CAST(ROUND(subtotal * CAST(0.16 AS DECIMAL(4,2)), 2) AS DECIMAL(38,2)) AS iva,
       CAST(subtotal + CAST(ROUND(subtotal * CAST(0.16 AS DECIMAL(4,2)), 2) AS DECIMAL(38,2)) AS DECIMAL(38,2)) AS total
FROM j
""")
def v10(t):
    open_ids = t.atencion.filter("status = 'ABIERTA'").select("id_atencion")
    lines = t.cargos.select("id_atencion", "linea", "id_catalogo", "cantidad").join(open_ids, "id_atencion", "left_semi")
    return reports.budget_lines(lines, t.catalogo)


@query("v11_cash_cut", sql=f"""
{with_roles('atencion', 'pacientes')},
p AS (SELECT a.id_atencion, a.fecha_ing, a.especialidad, CAST(a.monto AS DECIMAL(18,2)) AS deposito, c.nombre AS pagador
      FROM atencion a JOIN pacientes c USING (Id_exp)
      WHERE a.fecha_ing >= DATE '1999-03-01' AND a.fecha_ing < DATE '1999-04-01'
        AND (a.especialidad IS NULL OR a.especialidad NOT IN ('4-NOT SPECIFIED', '5-LOW')))
SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY fecha_ing, id_atencion) AS BIGINT) AS n,
       CAST(SUM(deposito) OVER (ORDER BY fecha_ing, id_atencion ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS DECIMAL(38,2)) AS acumulado
FROM p
""")
def v11(t):
    pay = t.atencion.select("id_atencion", "Id_exp", "fecha_ing", "especialidad",
                            F.col("monto").cast("decimal(18,2)").alias("deposito")).join(
        t.pacientes.select("Id_exp", F.col("nombre").alias("pagador")), "Id_exp").drop("Id_exp")
    out = W.cash_cut(pay, "fecha_ing", "1999-03-01", "1999-04-01", "deposito", "id_atencion",
                     excluded=("4-NOT SPECIFIED", "5-LOW"), method="especialidad")
    return out.withColumn("acumulado", F.col("acumulado").cast("decimal(38,2)"))


@query("v12_exam_worklist", sql=f"""
{with_roles('cargos', 'catalogo', 'atencion', 'pacientes')},
d AS (SELECT d.id_atencion, d.linea, d.estado, c.nombre AS examen FROM cargos d JOIN catalogo c USING (id_catalogo)),
g AS (SELECT id_atencion,
             CASE WHEN bool_or(upper(trim(estado)) = 'PENDIENTE') THEN 'PENDIENTE'
                  WHEN bool_or(upper(trim(estado)) = 'CANCELADO') THEN 'CANCELADO' ELSE 'REALIZADO' END AS estado_general,
             COUNT(*) AS n_detalles, string_agg(examen, ', ' ORDER BY linea, examen) AS examenes
      FROM d GROUP BY id_atencion)
SELECT g.*, a.Id_exp, p.nombre AS paciente FROM g LEFT JOIN atencion a USING (id_atencion)
LEFT JOIN pacientes p ON a.Id_exp = p.Id_exp
""")
def v12(t):
    return reports.exam_worklist(t.cargos, t.catalogo, t.atencion, t.pacientes)


@query("v13_diagnosis_history", sql=f"""
{PRE}
SELECT x.id_diagnostico, a.id_atencion, a.Id_exp, x.lang, fd.medico_principal
FROM (SELECT id_diagnostico, lang FROM diagnosticos) x JOIN atencion a ON x.id_diagnostico = a.id_atencion
LEFT JOIN fd USING (id_atencion)
""".replace(f"{with_roles(*ROLES_ALL)}", with_roles(*ROLES_ALL, 'diagnosticos')))
def v13(t):
    d = t.diagnosticos.select("id_diagnostico", "lang").withColumn("id_atencion", F.col("id_diagnostico"))
    return d.join(t.atencion.select("id_atencion", "Id_exp"), "id_atencion").join(first_doctor(t), "id_atencion", "left")


@query("v14_vitals_with_patient", sql=f"""
{with_roles('signos', 'pacientes')}
SELECT s.id_signo, s.fecha, s.signo, s.valor, s.id_usuario AS Id_exp, p.nombre
FROM signos s JOIN pacientes p ON s.id_usuario = p.Id_exp
""")
def v14(t):
    s = t.signos.select("id_signo", "fecha", "signo", "valor", F.col("id_usuario").alias("Id_exp"))
    return J.inner(s, t.pacientes.select("Id_exp", "nombre"), "Id_exp").orderBy(F.desc("fecha"), F.desc("id_signo"))


@query("v14_diagnoses_of_attention", sql=f"""
{with_roles('diagnosticos', 'atencion', 'pacientes')}
SELECT x.id_diagnostico, a.id_atencion, a.Id_exp, p.nombre, x.lang, x.fuente
FROM diagnosticos x JOIN atencion a ON x.id_diagnostico = a.id_atencion JOIN pacientes p USING (Id_exp)
""")
def v14_diagnoses(t):
    d = t.diagnosticos.select("id_diagnostico", F.col("id_diagnostico").alias("id_atencion"), "lang", "fuente")
    j = J.inner(d, t.atencion.select("id_atencion", "Id_exp"), "id_atencion")
    return J.inner(j, t.pacientes.select("Id_exp", "nombre"), "Id_exp").orderBy(F.desc("id_diagnostico"))


@query("v14_prescriptions_of_attention", sql=f"""
{with_roles('cargos', 'catalogo', 'atencion', 'pacientes')}
SELECT d.id_atencion, a.Id_exp, p.nombre, d.linea, c.nombre AS medicamento, d.cantidad, d.fecha
FROM cargos d JOIN catalogo c USING (id_catalogo) JOIN atencion a USING (id_atencion) JOIN pacientes p USING (Id_exp)
WHERE d.estado = 'PENDIENTE'
""")
def v14_prescriptions(t):
    """Binding: lines still to be done, with the item to give."""
    d = t.cargos.filter("estado = 'PENDIENTE'").select("id_atencion", "linea", "id_catalogo", "cantidad", "fecha")
    j = J.inner(d, t.catalogo.select("id_catalogo", F.col("nombre").alias("medicamento")), "id_catalogo").drop("id_catalogo")
    j = J.inner(j, t.atencion.select("id_atencion", "Id_exp"), "id_atencion")
    return J.inner(j, t.pacientes.select("Id_exp", "nombre"), "Id_exp")


@query("v14_notes_of_attention", sql=f"""
{with_roles('atencion', 'pacientes')}
SELECT n.conv_id AS id_atencion, a.Id_exp, p.nombre, n.turn AS orden, n.role AS autor, n.text AS nota
FROM conversations n JOIN atencion a ON n.conv_id = a.id_atencion JOIN pacientes p USING (Id_exp)
""")
def v14_notes(t):
    """Binding: the turns of a conversation are the notes of the attention of its number, newest first."""
    notes = t.conversations.select(F.col("conv_id").alias("id_atencion"), F.col("turn").alias("orden"), F.col("role").alias("autor"),
                                   F.col("text").alias("nota"))
    return reports.notes_of_attention(notes, t.atencion, t.pacientes)


@query("v15_service_catalogue", sql=f"""
{with_roles('catalogo', 'cargos', 'camas')},
pr AS (SELECT id_catalogo, MIN(id_medico) AS id_proveedor FROM cargos GROUP BY id_catalogo)
SELECT c.id_catalogo, c.nombre, c.tipo, c.precio, pr.id_proveedor, m.numero AS proveedor
FROM catalogo c LEFT JOIN pr USING (id_catalogo) LEFT JOIN camas m ON pr.id_proveedor = m.id_cama
""")
def v15(t):
    providers = t.cargos.groupBy("id_catalogo").agg(F.min("id_medico").alias("id_proveedor"))
    names = t.camas.select(F.col("id_cama").alias("id_proveedor"), F.col("numero").alias("proveedor"))
    return J.left(J.left(t.catalogo.select("id_catalogo", "nombre", "tipo", "precio"), providers, "id_catalogo"),
                  names, "id_proveedor")


@query("v16_active_accounts", sql=f"""
{PRE},
tot AS (SELECT id_atencion, {money('subtotal')} AS subtotal FROM cargos GROUP BY id_atencion),
j AS (SELECT a.id_atencion, a.Id_exp, p.nombre AS paciente, bo.id_cama, fd.medico_principal,
             COALESCE(tot.subtotal, CAST(0 AS DECIMAL(38,2))) AS subtotal
      FROM atencion a JOIN pacientes p USING (Id_exp) LEFT JOIN bo USING (id_atencion) LEFT JOIN fd USING (id_atencion)
      LEFT JOIN tot USING (id_atencion) WHERE a.status = 'ABIERTA')
SELECT *, CAST(ROUND(subtotal * CAST(0.16 AS DECIMAL(4,2)), 2) AS DECIMAL(38,2)) AS iva,
       CAST(subtotal + CAST(ROUND(subtotal * CAST(0.16 AS DECIMAL(4,2)), 2) AS DECIMAL(38,2)) AS DECIMAL(38,2)) AS total
FROM j
""")
def v16(t):
    return reports.active_accounts(t.atencion, t.pacientes, t.cargos, beds_of_att(t), first_doctor(t))


@query("v17_census", sql=f"""
{PRE},
dm AS (SELECT m.id_atencion, string_agg(c.numero, ', ' ORDER BY c.numero) AS medicos
       FROM (SELECT DISTINCT id_atencion, id_medico FROM cargos) m JOIN camas c ON m.id_medico = c.id_cama GROUP BY 1)
SELECT bs.area, bs.id_cama, bs.numero, bs.estado_cama, bs.id_atencion_actual, a.Id_exp, a.fecha_ing,
       pa.nombre AS paciente, pa.edad, dm.medicos,
       CAST(CASE WHEN date_diff('day', a.fecha_ing, DATE '2001-12-01') >= 0 THEN date_diff('day', a.fecha_ing, DATE '2001-12-01') END
         AS INTEGER) AS dias_estancia
FROM bs LEFT JOIN atencion a ON bs.id_atencion_actual = a.id_atencion LEFT JOIN pa ON a.Id_exp = pa.Id_exp
LEFT JOIN dm ON bs.id_atencion_actual = dm.id_atencion
""")
def v17(t):
    from .q_joins import doctors_per_attention

    docs = t.camas.select(F.col("id_cama").alias("id_medico"), F.col("numero").alias("medico"))
    ex = J.join_any(doctors_per_attention(t), "medicos", docs, "id_medico", "id_atencion").drop("medicos")
    names = A.names_joined(ex.filter(F.col("medico").isNotNull()), "id_atencion", "medico").withColumnRenamed(
        "nombres", "medicos")
    return reports.census(bed_states(t), t.atencion, pat_age(t), names, AS_OF_ORDERS)


@query("v18_nursing_worklist", sql=f"""
{with_roles('atencion', 'pacientes')},
f AS (SELECT a.*, p.nombre FROM atencion a LEFT JOIN pacientes p USING (Id_exp)
      WHERE a.especialidad IN ('1-URGENT', '2-HIGH') OR a.especialidad IS NULL OR a.especialidad = '')
SELECT *, (SELECT COUNT(*) FROM f) AS total_filas, CAST(CEIL((SELECT COUNT(*) FROM f) / 25.0) AS BIGINT) AS paginas
FROM f ORDER BY fecha_ing DESC, id_atencion LIMIT 25 OFFSET 25
""")
def v18(t):
    f = W.page(t.atencion.filter(in_or_blank("especialidad", ["1-URGENT", "2-HIGH"])), ["-fecha_ing"], "id_atencion", 2, 25)
    return J.left(f, t.pacientes.select("Id_exp", "nombre"), "Id_exp")


def _study_list_sql(kind: str, state: str) -> str:
    return f"""
{with_roles('cargos', 'catalogo', 'atencion', 'pacientes')},
d AS (SELECT d.id_atencion, d.linea, c.nombre AS examen FROM cargos d JOIN catalogo c USING (id_catalogo)
      WHERE c.tipo = '{kind}' AND upper(trim(d.estado)) = '{state}'),
g AS (SELECT id_atencion, string_agg(examen, ', ' ORDER BY linea, examen) AS examenes, COUNT(*) AS n FROM d GROUP BY 1)
SELECT g.*, a.Id_exp, p.nombre AS paciente FROM g JOIN atencion a USING (id_atencion) JOIN pacientes p USING (Id_exp)
"""


def _study_list(t, kind: str, state: str):
    """Attentions with studies of a type in a state: names, number and patient."""
    from ..operators.filters import status_is

    d = t.cargos.filter(status_is("estado", state)).select("id_atencion", "linea", "id_catalogo").join(
        t.catalogo.filter(F.col("tipo") == kind).select("id_catalogo", F.col("nombre").alias("examen")), "id_catalogo")
    names = A.names_joined(d, "id_atencion", "examen", order="linea").withColumnRenamed("nombres", "examenes")
    n = d.groupBy("id_atencion").agg(F.count(F.lit(1)).alias("n"))
    a = t.atencion.select("id_atencion", "Id_exp").join(t.pacientes.select("Id_exp", F.col("nombre").alias("paciente")),
                                                        "Id_exp")
    return names.join(n, "id_atencion").join(a, "id_atencion")


@query("v19_study_requests", sql=_study_list_sql("PROMO", "PENDIENTE"))
def v19(t):
    return _study_list(t, "PROMO", "PENDIENTE")


@query("v19_study_results", sql=_study_list_sql("PROMO", "REALIZADO"))
def v19_results(t):
    return _study_list(t, "PROMO", "REALIZADO")


@query("v19_other_requests", sql=_study_list_sql("ECONOMY", "PENDIENTE"))
def v19_other_requests(t):
    return _study_list(t, "ECONOMY", "PENDIENTE")


@query("v19_other_results", sql=_study_list_sql("ECONOMY", "REALIZADO"))
def v19_other_results(t):
    return _study_list(t, "ECONOMY", "REALIZADO")


# the files and remarks of a study's results: its item's brand, and the item's name where it was cancelled
RESULT_FILE = "CASE WHEN linea % 3 = 0 THEN NULL ELSE marca END"
RESULT_REMARK = "CASE WHEN estado = 'CANCELADO' THEN nombre ELSE ' ' END"


def _header_sql(kind: str) -> str:
    return f"""
{PRE},
d AS (SELECT d.id_atencion, {RESULT_FILE} AS archivo, {RESULT_REMARK} AS observacion, c.nombre AS estudio,
             ROW_NUMBER() OVER (PARTITION BY d.id_atencion ORDER BY linea, id_catalogo, id_medico, subtotal) AS r
      FROM cargos d JOIN catalogo c USING (id_catalogo) WHERE c.tipo = '{kind}'),
fi AS (SELECT id_atencion, string_agg(archivo, ',' ORDER BY r) AS archivos
       FROM (SELECT id_atencion, archivo, MIN(r) AS r FROM d WHERE archivo IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT id_atencion, string_agg(estudio, ', ' ORDER BY r) AS estudios, COALESCE(arg_min(observacion, r) FILTER (trim(observacion) <> ''), '') AS observaciones
      FROM d GROUP BY 1)
SELECT h.id_atencion AS id_examen, a.Id_exp, p.nombre || ' ' || p.area AS paciente, c.numero AS habitacion, h.estudios,
       COALESCE(fi.archivos, '') AS archivos, h.observaciones
FROM h JOIN atencion a USING (id_atencion) JOIN pacientes p USING (Id_exp) LEFT JOIN fi USING (id_atencion)
LEFT JOIN bo ON bo.id_atencion = h.id_atencion LEFT JOIN camas c ON c.id_cama = bo.id_cama
"""


def _headers(t, kind: str):
    details = t.cargos.join(t.catalogo.filter(F.col("tipo") == kind).select("id_catalogo", "nombre", "marca"), "id_catalogo").select(
        "id_atencion", *LINE_ORDER, F.expr(RESULT_FILE).alias("archivo"), F.expr(RESULT_REMARK).alias("observacion"), F.col("nombre").alias("estudio"))
    rooms = beds_of_att(t).join(t.camas.select("id_cama", F.col("numero").alias("habitacion")), "id_cama").select("id_atencion", "habitacion")
    return reports.edit_headers(details, LINE_ORDER, t.atencion, t.pacientes, rooms)


@query("v19_edit_header", sql=_header_sql("PROMO"))
def v19_header(t):
    return _headers(t, "PROMO")


@query("v19_other_edit_header", sql=_header_sql("ECONOMY"))
def v19_other_header(t):
    return _headers(t, "ECONOMY")


@query("v20_result_files", sql=f"""
{with_roles('cargos', 'catalogo')},
d AS (SELECT d.id_atencion, d.linea, c.nombre FROM cargos d JOIN catalogo c USING (id_catalogo)),
f AS (SELECT id_atencion, nombre, MIN(linea) AS primera FROM d GROUP BY 1, 2)
SELECT id_atencion, string_agg(nombre, '|' ORDER BY primera, nombre) AS archivos FROM f GROUP BY id_atencion
""")
def v20(t):
    d = t.cargos.select("id_atencion", "linea", "id_catalogo").join(t.catalogo.select("id_catalogo", "nombre"),
                                                                     "id_catalogo")
    # stored form: a comma-joined file list with repeats and blanks
    lists = d.groupBy("id_atencion").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("linea", "nombre"))),
                                                                  lambda x: x["nombre"]), " , ,").alias("archivo_resultado"))
    return lists.select("id_atencion", F.array_join(AR.split_clean("archivo_resultado", ","), "|").alias("archivos"))


@query("v21_recent_logs", sql=f"""
{with_roles('signos')}
SELECT id_signo, fecha, id_usuario, signo FROM signos ORDER BY fecha DESC, id_signo DESC LIMIT 10
""")
def v21(t):
    return W.latest(t.signos.select("id_signo", "fecha", "id_usuario", "signo"), "fecha", "id_signo", 10)


@query("v21_latest_per_user", sql=f"""
{with_roles('signos')}
SELECT id_usuario, arg_max(id_signo, (fecha, id_signo)) AS id_signo, MAX(fecha) AS fecha FROM signos GROUP BY id_usuario
""")
def v21b(t):
    return t.signos.groupBy("id_usuario").agg(
        F.max_by("id_signo", F.struct("fecha", "id_signo")).alias("id_signo"), F.max("fecha").alias("fecha"))


@query("v21_user_list", sql=f"""
{with_roles('signos', 'pacientes')}
SELECT u.id_usuario, p.nombre FROM (SELECT DISTINCT id_usuario FROM signos) u LEFT JOIN pacientes p
ON u.id_usuario = p.Id_exp
""")
def v21c(t):
    users = t.signos.select("id_usuario").distinct()
    return users.join(t.pacientes.select(F.col("Id_exp").alias("id_usuario"), "nombre"), "id_usuario", "left")


def _fmt_sql(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def _clip_sql(x: str, n: int, blank: str) -> str:
    x = f"COALESCE(NULLIF({x}, ''), '{blank}')"
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n - 3}) || '...' ELSE {x} END)"


def _long_sql(section: str, row: str, cols) -> str:
    return " UNION ALL ".join(f"SELECT '{section}', '{c}', {_fmt_sql(f'(SELECT {c} FROM {row})')}" for c in cols)


_HIT = contains_any(sql_fold("nombre"), [w.upper() for w in OCULAR_WORDS])
_DX_HIT = contains_any(sql_fold("texto"), [w.upper() for w in STAR_RULES.diagnosis_stems])


def dashboard_sql(f: DashboardFilters, last: str) -> str:
    """Twin of the dashboard for its filters; ``last`` is the first day of the last month."""
    signs = [*vitals.SINGLE, *vitals.PRESSURES] if f.sign == "all" else [f.sign]
    way = lambda desc: "DESC" if desc else "ASC"
    return f"""
{with_roles('pacientes', 'atencion', 'cargos', 'catalogo', 'camas', 'signos', 'diagnosticos')}, w AS ({vitals.with_pressure_sql()}),
paid AS (SELECT * FROM cargos WHERE subtotal > 0),
names AS (SELECT c.nombre, COUNT(*) AS n, COUNT(*) FILTER (WHERE subtotal > 0) AS cobros,
                 {money('CASE WHEN subtotal > 0 THEN subtotal END')} AS monto
          FROM cargos d JOIN catalogo c USING (id_catalogo) GROUP BY 1),
hits AS (SELECT COUNT(*) AS k FROM names WHERE {_HIT}),
st AS (SELECT * FROM names WHERE {_HIT} OR (SELECT k FROM hits) = 0),
top AS (SELECT nombre, n FROM st ORDER BY n DESC, nombre LIMIT 7),
est AS (SELECT {_clip_sql('nombre', 42, 'Sin nombre')} AS clave, n FROM top ORDER BY n {way(f.exam_desc)}, nombre LIMIT {f.exam_top}),
prof AS (SELECT CASE WHEN (SELECT k FROM hits) > 0 THEN {profile_case_sql(sql_fold('nombre'))} ELSE 'Estudios registrados' END AS clave,
                SUM(n) AS n FROM st GROUP BY 1 ORDER BY n DESC, clave LIMIT 7),
per AS (SELECT * FROM prof ORDER BY n {way(f.profile_desc)}, clave LIMIT {f.profile_top}),
svc AS (SELECT {_clip_sql('nombre', 48, 'Sin descripción')} AS clave, {r6('CAST(monto AS DOUBLE) / cobros')} AS v
        FROM names WHERE cobros > 0 ORDER BY v {way(f.amount_desc)}, clave LIMIT {f.amount_top}),
tip AS (SELECT COALESCE(tipo, 'Sin clasificar') AS clave, {money('subtotal')} AS v FROM paid GROUP BY 1
        ORDER BY v DESC, clave LIMIT {f.revenue_top}),
al AS (SELECT * FROM ({alert_sql()}) WHERE signo IN ({', '.join(f"'{x}'" for x in signs)})),
occ AS (SELECT CASE WHEN GROUPING(area) = 1 THEN 'TOTAL' ELSE COALESCE(area, 'Sin dato') END AS area,
               {pct("COUNT(*) FILTER (WHERE COALESCE(ocupada, 0) = 1)", "COUNT(*)")} AS porcentaje
        FROM camas GROUP BY ROLLUP (area)),
dem AS (SELECT a.especialidad || ' / ' || p.area AS clave, COUNT(*) AS n FROM atencion a JOIN pacientes p USING (Id_exp)
        GROUP BY 1 ORDER BY n DESC, clave LIMIT 5),
ar0 AS (SELECT COALESCE(p.area, 'Sin dato') AS clave, COUNT(*) AS n FROM atencion a JOIN pacientes p USING (Id_exp) GROUP BY 1),
ar1 AS (SELECT * FROM ar0 ORDER BY n DESC, clave LIMIT {f.area_top - 1}),
ar AS (SELECT * FROM ar1 UNION ALL
       SELECT 'Otros', (SELECT SUM(n) FROM ar0) - (SELECT SUM(n) FROM ar1)
       WHERE (SELECT SUM(n) FROM ar0) > (SELECT SUM(n) FROM ar1)),
ms AS (SELECT CAST(unnest(generate_series(DATE '{last}' - INTERVAL {f.trend_months - 1} MONTH, DATE '{last}', INTERVAL 1 MONTH))
              AS DATE) AS mes),
mc AS (SELECT CAST(date_trunc('month', fecha_ing) AS DATE) AS mes, COUNT(*) AS n FROM atencion GROUP BY 1),
mon AS (SELECT strftime(ms.mes, '%Y-%m') AS clave, COALESCE(mc.n, 0) AS n FROM ms LEFT JOIN mc USING (mes)),
ages AS (SELECT {age_sql('fecnac', f"DATE '{AS_OF_ORDERS}'")} AS edad FROM ({BIRTH_SQL})),
q AS (SELECT COUNT(subtotal) AS n, quantile_cont(subtotal, 0.25) AS q1, quantile_cont(subtotal, 0.5) AS mediana,
             quantile_cont(subtotal, 0.75) AS q3 FROM paid),
sta AS (SELECT n, {r6('q1')} AS q1, {r6('mediana')} AS mediana, {r6('q3')} AS q3, {r6('q3 - q1')} AS iqr,
               {r6('q3 + 1.5 * (q3 - q1)')} AS limite_superior,
               (SELECT COUNT(*) FROM paid, q WHERE subtotal > q3 + 1.5 * (q3 - q1)) AS atipicos,
               (SELECT {r6('AVG(subtotal)')} FROM paid) AS media, (SELECT {r6('AVG(edad)')} FROM ages) AS edad_promedio,
               (SELECT COUNT(*) FROM diagnosticos WHERE {_DX_HIT}) AS diagnosticos_oculares FROM q),
kpi AS (SELECT (SELECT COUNT(*) FROM pacientes) AS pacientes,
               (SELECT COUNT(*) FROM atencion WHERE status = 'ABIERTA') AS atenciones_abiertas,
               (SELECT SUM(n) FROM top) AS estudios,
               (SELECT COUNT(DISTINCT a.Id_exp) FROM cargos d JOIN atencion a USING (id_atencion)
                JOIN catalogo c USING (id_catalogo) WHERE {_HIT}) AS pacientes_oculares,
               (SELECT {pct("COUNT(*) FILTER (WHERE ocupada = 1)", "COUNT(*)")} FROM camas) AS ocupacion,
               (SELECT {r6('AVG(subtotal)')} FROM paid) AS cargo_promedio)
SELECT 'ocupacion' AS seccion, area AS clave, {_fmt_sql('porcentaje')} AS valor FROM occ
UNION ALL {_long_sql('kpi', 'kpi', ('pacientes', 'atenciones_abiertas', 'estudios', 'pacientes_oculares', 'ocupacion', 'cargo_promedio'))}
UNION ALL {_long_sql('estadistica', 'sta', ('n', 'q1', 'mediana', 'q3', 'iqr', 'limite_superior', 'atipicos', 'media',
                                            'edad_promedio', 'diagnosticos_oculares'))}
UNION ALL SELECT 'demanda', clave, {_fmt_sql('n')} FROM dem
UNION ALL SELECT 'area', clave, {_fmt_sql('n')} FROM ar
UNION ALL SELECT 'tendencia', clave, {_fmt_sql('n')} FROM mon
UNION ALL SELECT 'estudio', clave, {_fmt_sql('n')} FROM est
UNION ALL SELECT 'perfil', clave, {_fmt_sql('n')} FROM per
UNION ALL SELECT 'ingreso_tipo', {_clip_sql('clave', 30, 'Sin dato')}, {_fmt_sql('v')} FROM tip
UNION ALL SELECT 'servicio', clave, {_fmt_sql('v')} FROM svc
UNION ALL SELECT 'alertas', signo, {_fmt_sql('alertas')} FROM al
UNION ALL SELECT 'alertas_pct', signo, {_fmt_sql(pct('alertas', 'validos'))} FROM al
"""


def _dashboard(t, filters: DashboardFilters):
    ages = birth_dates(t).select(age_calendar("fecnac", AS_OF_ORDERS).alias("edad"))
    return dashboard(t.pacientes, t.atencion, t.cargos, t.catalogo, t.camas, vitals.with_pressure(t.signos), ages, t.diagnosticos,
                     OCULAR_WORDS, STAR_RULES.diagnosis_stems, PROFILE_RULES, PROFILE_DEFAULT, vitals.SINGLE,
                     vitals.PRESSURES, AS_OF_ORDERS, filters)


@query("v23_dashboard", sql=dashboard_sql(DashboardFilters(), "2001-12-01"))
def v23(t):
    return _dashboard(t, DashboardFilters())


#: Another choice of every filter.
NARROW = DashboardFilters(trend_months=6, area_top=3, exam_top=3, exam_desc=False, profile_top=3, profile_desc=False,
                          amount_top=5, amount_desc=False, revenue_top=3, sign="temp")


@query("v23_dashboard_filtered", sql=dashboard_sql(NARROW, "2001-12-01"))
def v23_filtered(t):
    return _dashboard(t, NARROW)


@query("v24_beds_sorted", sql=f"""
{with_roles('camas')}
SELECT id_cama, numero, area FROM camas ORDER BY numero, id_cama
""")
def v24(t):
    return t.camas.select("id_cama", "numero", "area").orderBy("numero", "id_cama")


@query("v24_catalogue_sorted", sql=f"""
{with_roles('catalogo')}
SELECT id_catalogo, nombre, tipo FROM catalogo ORDER BY nombre, id_catalogo
""")
def v24b(t):
    return t.catalogo.select("id_catalogo", "nombre", "tipo").orderBy("nombre", "id_catalogo")


@query("v25_badge_counts", sql=f"""
{PRE},
st AS (SELECT id_atencion, CASE WHEN bool_or(estado = 'PENDIENTE') THEN 'PENDIENTE'
                                WHEN bool_or(estado = 'CANCELADO') THEN 'CANCELADO' ELSE 'REALIZADO' END AS e
       FROM cargos GROUP BY id_atencion)
SELECT 'camas_por_area' AS insignia, area AS clave, COUNT(*) AS n FROM bs GROUP BY area
UNION ALL SELECT 'estudios_por_estado', e, COUNT(*) FROM st GROUP BY e
UNION ALL SELECT 'camas_ocupadas', 'TOTAL', COUNT(*) FILTER (WHERE estado_cama = 'OCUPADA') FROM bs
""")
def v25(t):
    bs = bed_states(t)
    by_area = bs.groupBy(F.col("area").alias("clave")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "insignia", F.lit("camas_por_area"))
    st = A.rollup_status(t.cargos, "id_atencion", "estado").groupBy(F.col("estado_general").alias("clave")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("insignia", F.lit("estudios_por_estado"))
    occ = bs.agg(F.count_if(F.col("estado_cama") == "OCUPADA").alias("n")).select(
        F.lit("camas_ocupadas").alias("insignia"), F.lit("TOTAL").alias("clave"), "n")
    return by_area.unionByName(st).unionByName(occ)


@query("v22_open_attention_report", sql=f"""
{with_roles('atencion', 'pacientes', 'cargos')},
tot AS (SELECT id_atencion, {money('subtotal')} AS total_cuenta FROM cargos GROUP BY id_atencion)
SELECT a.id_atencion, a.Id_exp AS expediente, p.area, a.especialidad, a.fecha_ing, p.nombre AS paciente,
       COALESCE(t.total_cuenta, CAST(0 AS DECIMAL(38,2))) AS total_cuenta
FROM atencion a JOIN pacientes p ON a.Id_exp = p.Id_exp
LEFT JOIN tot t ON a.id_atencion = t.id_atencion
WHERE a.status = 'ABIERTA'
""")
def v22(t):
    return reports.open_attention_report(t.atencion, t.pacientes, t.cargos)


@query("v24_staff_sorted", sql=f"""
{with_roles('camas')}
SELECT id_cama AS id_medico, numero AS medico, nacion FROM camas ORDER BY nacion, numero, id_cama
""")
def v24c(t):
    return t.camas.select(F.col("id_cama").alias("id_medico"), F.col("numero").alias("medico"), "nacion").orderBy(
        "nacion", "medico", "id_medico")


@query("v24_diagnosis_catalogue", sql=f"""
{with_roles('diagnosticos')}
SELECT DISTINCT lang, fuente FROM diagnosticos ORDER BY lang, fuente
""")
def v24d(t):
    return t.diagnosticos.select("lang", "fuente").distinct().orderBy("lang", "fuente")
