"""Driver bindings for joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .bind import with_roles
from .registry import query
from .sqlkit import money, r6


# line numbers repeat inside an order, so a total order over lines needs these columns
LINE_ORDER = ["linea", "id_catalogo", "id_medico", "subtotal"]


@query("j1_inner", sql=f"""
{with_roles('cargos', 'atencion')}
SELECT d.id_atencion, d.linea, d.subtotal, a.Id_exp, a.status, a.fecha_ing
FROM cargos d JOIN atencion a USING (id_atencion)
""")
def j1(t):
    return J.inner(t.cargos.select("id_atencion", "linea", "subtotal"),
                   t.atencion.select("id_atencion", "Id_exp", "status", "fecha_ing"), "id_atencion")


@query("j2_left", sql=f"""
{with_roles('cargos', 'atencion')}
SELECT a.id_atencion, a.Id_exp, a.status, d.linea, d.subtotal
FROM atencion a LEFT JOIN cargos d USING (id_atencion)
""")
def j2(t):
    return J.left(t.atencion.select("id_atencion", "Id_exp", "status"),
                  t.cargos.select("id_atencion", "linea", "subtotal"), "id_atencion")


@query("j3_left_filtered", sql=f"""
{with_roles('cargos', 'atencion')}
SELECT a.id_atencion, a.status, d.linea, d.estado
FROM atencion a LEFT JOIN (SELECT * FROM cargos WHERE estado = 'PENDIENTE') d USING (id_atencion)
""")
def j3(t):
    return J.left_filtered(t.atencion.select("id_atencion", "status"),
                           t.cargos.select("id_atencion", "linea", "estado"), "id_atencion",
                           F.col("estado") == "PENDIENTE")


@query("j4_nest", sql=f"""
{with_roles('cargos', 'atencion')}
SELECT a.id_atencion, a.status,
       COALESCE((SELECT string_agg(CAST(d.linea AS VARCHAR) || ':' || d.estado, ';' ORDER BY d.linea, d.estado)
                 FROM cargos d WHERE d.id_atencion = a.id_atencion), '') AS lineas,
       (SELECT COUNT(*) FROM cargos d WHERE d.id_atencion = a.id_atencion) AS n_lineas
FROM atencion a
""")
def j4(t):
    n = J.nest(t.atencion.select("id_atencion", "status"), t.cargos.select("id_atencion", "linea", "estado"),
               "id_atencion", as_="items", order=["linea", "estado"])
    return n.select("id_atencion", "status", F.array_join(
        F.transform("items", lambda x: F.concat(x["linea"].cast("string"), F.lit(":"), x["estado"])), ";"
    ).alias("lineas"), F.size("items").cast("long").alias("n_lineas"))


@query("j4_reduce_matches", sql=f"""
{with_roles('cargos', 'atencion')},
g AS (SELECT id_atencion, COUNT(*) AS n, {money('subtotal')} AS suma, AVG(subtotal) AS promedio FROM cargos GROUP BY id_atencion)
SELECT a.id_atencion, COALESCE(g.n, 0) AS n, COALESCE(g.suma, CAST(0 AS DECIMAL(38,2))) AS suma,
       {r6('COALESCE(g.promedio, 0.0)')} AS promedio
FROM atencion a LEFT JOIN g USING (id_atencion)
""")
def j4b(t):
    r = J.reduce_matches(t.atencion.select("id_atencion"), t.cargos, "id_atencion", "subtotal")
    return r.withColumn("promedio", F.round("promedio", 6))


def doctors_per_attention(t):
    """Binding: an attention's doctors = the distinct suppliers of its lines (an array key)."""
    return t.cargos.groupBy("id_atencion").agg(F.array_sort(F.collect_set("id_medico")).alias("medicos"))


@query("j5_join_any", sql=f"""
{with_roles('cargos', 'camas')},
m AS (SELECT DISTINCT id_atencion, id_medico FROM cargos)
SELECT m.id_atencion, m.id_medico, c.numero AS medico FROM m LEFT JOIN camas c ON m.id_medico = c.id_cama
""")
def j5(t):
    docs = t.camas.select(F.col("id_cama").alias("id_medico"), F.col("numero").alias("medico"))
    return J.join_any(doctors_per_attention(t), "medicos", docs, "id_medico", "id_atencion").select(
        "id_atencion", "id_medico", "medico")


@query("j6_first_match", sql=f"""
{with_roles('cargos', 'atencion')},
f AS (SELECT id_atencion, id_catalogo, subtotal FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY id_atencion ORDER BY linea, id_catalogo, id_medico, subtotal) AS rn
        FROM cargos) WHERE rn = 1)
SELECT a.id_atencion, a.status, f.id_catalogo, f.subtotal FROM atencion a LEFT JOIN f USING (id_atencion)
""")
def j6(t):
    return J.first_match(t.atencion.select("id_atencion", "status"), t.cargos, "id_atencion",
                         LINE_ORDER, ["id_catalogo", "subtotal"])


@query("j7_study_chain", sql=f"""
{with_roles('cargos', 'atencion', 'pacientes', 'catalogo', 'camas')}
SELECT d.id_atencion, d.linea, c.nombre AS examen, c.tipo AS tipo_examen, a.fecha_ing, p.nombre AS paciente,
       p.area, m.numero AS medico, m.area AS area_medico
FROM cargos d JOIN atencion a USING (id_atencion) JOIN pacientes p ON a.Id_exp = p.Id_exp
LEFT JOIN catalogo c ON d.id_catalogo = c.id_catalogo LEFT JOIN camas m ON d.id_medico = m.id_cama
""")
def j7(t):
    from .reports import study_chain
    return study_chain(t.cargos, t.atencion, t.pacientes, t.catalogo, t.camas)


@query("j8_orphans", sql=f"""
{with_roles('cargos', 'atencion')}
SELECT a.* FROM atencion a WHERE NOT EXISTS (SELECT 1 FROM cargos d WHERE d.id_atencion = a.id_atencion)
""")
def j8(t):
    return J.orphans(t.atencion, t.cargos, "id_atencion")


PATIENT_FACTS_SQL = f"""
v AS (SELECT Id_exp, COUNT(*) AS visitas FROM atencion GROUP BY Id_exp),
m AS (SELECT a.Id_exp, {money('d.subtotal')} AS monto, COUNT(*) AS estudios
      FROM cargos d JOIN atencion a USING (id_atencion) GROUP BY a.Id_exp)"""


def patient_facts(t):
    visits = t.atencion.groupBy("Id_exp").agg(F.count(F.lit(1)).alias("visitas"))
    from ..operators._common import money_sum
    per_attention = t.cargos.groupBy("id_atencion").agg(money_sum("subtotal").alias("monto"), F.count(F.lit(1)).alias("estudios"))
    amount = (per_attention.join(t.atencion.select("id_atencion", "Id_exp"), "id_atencion")
              .groupBy("Id_exp").agg(F.sum("monto").cast("decimal(38,2)").alias("monto"), F.sum("estudios").alias("estudios")))
    return visits, amount


@query("j9_assemble", sql=f"""
{with_roles('pacientes', 'atencion', 'cargos')}, {PATIENT_FACTS_SQL}
SELECT p.Id_exp, p.nombre, COALESCE(v.visitas, 0) AS visitas, COALESCE(m.monto, CAST(0 AS DECIMAL(38,2))) AS monto,
       COALESCE(m.estudios, 0) AS estudios
FROM pacientes p LEFT JOIN v USING (Id_exp) LEFT JOIN m USING (Id_exp)
""")
def j9(t):
    visits, amount = patient_facts(t)
    out = J.assemble(t.pacientes.select("Id_exp", "nombre"), [visits, amount], "Id_exp",
                     fill={"visitas": 0, "estudios": 0})
    return out.withColumn("monto", F.coalesce("monto", F.lit(0).cast("decimal(38,2)")))


@query("j10_enrich_charges", sql=f"""
{with_roles('cargos', 'atencion', 'pacientes')}
SELECT d.*, a.Id_exp, a.status, a.especialidad, a.fecha_ing, p.nombre, p.area
FROM cargos d LEFT JOIN atencion a USING (id_atencion) LEFT JOIN pacientes p ON a.Id_exp = p.Id_exp
""")
def j10(t):
    return J.enrich_charges(t.cargos, t.pacientes, t.atencion)


def _requests(t):
    """Binding: study requests = (attention, catalogue item, quantity) from the lines."""
    return t.cargos.select(F.col("id_atencion").alias("id_examen"), "id_catalogo", "cantidad")


@query("j11_expand_orders_header", sql=f"""
{with_roles('cargos', 'catalogo')},
det AS (SELECT d.id_atencion AS id_examen,
               CAST(CAST(c.precio AS DECIMAL(18,2)) * COALESCE(d.cantidad, 1) AS DECIMAL(18,2)) AS subtotal
        FROM cargos d JOIN catalogo c USING (id_catalogo))
SELECT id_examen, {money('subtotal')} AS subtotal_total, COUNT(*) AS n_detalles FROM det GROUP BY id_examen
""")
def j11(t):
    _, _, header = J.expand_orders(_requests(t), t.catalogo)
    return header


@query("j11_expand_orders_detail", sql=f"""
{with_roles('cargos', 'catalogo')}
SELECT d.id_atencion AS id_examen, d.id_catalogo, c.nombre AS descripcion, d.cantidad, c.precio,
       CAST(CAST(c.precio AS DECIMAL(18,2)) * COALESCE(d.cantidad, 1) AS DECIMAL(18,2)) AS subtotal
FROM cargos d JOIN catalogo c USING (id_catalogo)
""")
def j11b(t):
    _, charges, _ = J.expand_orders(_requests(t), t.catalogo)
    return charges
