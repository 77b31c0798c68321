"""Driver bindings for the batch jobs (B1-B12). Change sets are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as B
from ..operators import joins as J
from ..operators._common import money_sum
from ..operators.filters import drop_prefixes
from ..sources import sinks as S
from .bind import AS_OF_ORDERS, with_roles
from .q_reports import PRE, bed_states
from .q_scalars import _ts_text_spark, _ts_text_sql, parse_ts_sql
from .registry import query
from .sqlkit import money


def _snap(c, status):
    return c.filter(F.col("linestatus") == status).groupBy("id_atencion").agg(
        money_sum("subtotal").alias("total"), F.count(F.lit(1)).alias("n_lineas"))


SNAP_SQL = f"""
t AS (SELECT id_atencion, {money('subtotal')} AS total, COUNT(*) AS n_lineas FROM cargos WHERE linestatus = 'F' GROUP BY 1),
u AS (SELECT id_atencion, {money('subtotal')} AS total, COUNT(*) AS n_lineas FROM cargos WHERE linestatus = 'O' GROUP BY 1)"""


@query("b1_upsert", sql=f"""
{with_roles('cargos')}, {SNAP_SQL}
SELECT id_atencion, CASE WHEN u.id_atencion IS NOT NULL THEN COALESCE(u.total, t.total) ELSE t.total END AS total,
       CASE WHEN u.id_atencion IS NOT NULL THEN COALESCE(u.n_lineas, t.n_lineas) ELSE t.n_lineas END AS n_lineas
FROM t FULL OUTER JOIN u USING (id_atencion)
""")
def b1(t):
    return B.upsert(_snap(t.cargos, "F"), _snap(t.cargos, "O"), "id_atencion")


def _diag_versions(t):
    d = t.diagnosticos
    target = d.filter(F.col("lang").isin("en", "de")).select(
        F.col("id_diagnostico").alias("id_atencion"), (F.col("id_diagnostico") * 10).alias("id_diag"),
        F.lit("2001-01-01").cast("date").alias("fecha_registro"), F.col("lang").alias("diagnostico"))
    updates = d.filter(F.col("lang").isin("de", "fr")).select(
        F.col("id_diagnostico").alias("id_atencion"), (F.col("id_diagnostico") * 10 + 1).alias("id_diag"),
        F.lit("2001-06-01").cast("date").alias("fecha_registro"), F.upper("lang").alias("diagnostico"))
    return target, updates


@query("b11_upsert_protected", sql=f"""
{with_roles('diagnosticos')},
t AS (SELECT id_diagnostico AS id_atencion, id_diagnostico * 10 AS id_diag, DATE '2001-01-01' AS fecha_registro,
             lang AS diagnostico FROM diagnosticos WHERE lang IN ('en', 'de')),
u AS (SELECT id_diagnostico AS id_atencion, id_diagnostico * 10 + 1 AS id_diag, DATE '2001-06-01' AS fecha_registro,
             upper(lang) AS diagnostico FROM diagnosticos WHERE lang IN ('de', 'fr'))
SELECT id_atencion,
       CASE WHEN t.id_atencion IS NOT NULL THEN t.id_diag ELSE u.id_diag END AS id_diag,
       CASE WHEN t.id_atencion IS NOT NULL THEN t.fecha_registro ELSE u.fecha_registro END AS fecha_registro,
       CASE WHEN u.id_atencion IS NOT NULL THEN COALESCE(u.diagnostico, t.diagnostico) ELSE t.diagnostico END AS diagnostico
FROM t FULL OUTER JOIN u USING (id_atencion)
""")
def b11(t):
    target, updates = _diag_versions(t)
    return B.upsert(target, updates, "id_atencion", protected=("id_diag", "fecha_registro"))


def _to_close(t):
    """Binding: open attentions whose every line is finished (linestatus F) are closed."""
    done = t.cargos.groupBy("id_atencion").agg(F.bool_and(F.col("linestatus") == "F").alias("ok")).filter("ok")
    return t.atencion.filter("status = 'ABIERTA'").select("id_atencion").join(done, "id_atencion", "left_semi")


CLOSE_SQL = """
k AS (SELECT a.id_atencion FROM atencion a JOIN (SELECT id_atencion FROM cargos GROUP BY 1 HAVING bool_and(linestatus = 'F')) d
      USING (id_atencion) WHERE a.status = 'ABIERTA')"""


def _close(t):
    bs = bed_states(t)
    return B.close_accounts(t.atencion, t.camas, t.cargos, _to_close(t), AS_OF_ORDERS, bs)


@query("b2_close_attentions", sql=f"""
{with_roles('atencion', 'cargos')}, {CLOSE_SQL}
SELECT id_atencion, Id_exp, CASE WHEN id_atencion IN (SELECT id_atencion FROM k) THEN 'CERRADA' ELSE status END AS status,
       estado_origen, fecha_ing, especialidad, monto FROM atencion
""")
def b2a(t):
    return _close(t)[0]


@query("b2_discharges", sql=f"""
{with_roles('atencion', 'cargos')}, {CLOSE_SQL},
tot AS (SELECT id_atencion, {money('subtotal')} AS total_cuenta FROM cargos GROUP BY 1)
SELECT a.Id_exp, a.id_atencion, DATE '{AS_OF_ORDERS}' AS fecha_alta, COALESCE(tot.total_cuenta, CAST(0 AS DECIMAL(38,2))) AS total_cuenta
FROM atencion a JOIN k USING (id_atencion) LEFT JOIN tot USING (id_atencion)
""")
def b2b(t):
    return _close(t)[1]


@query("b2_free_beds", sql=f"""
{PRE}, {CLOSE_SQL}
SELECT id_cama, numero, id_nacion, nacion, area,
       CASE WHEN id_cama IN (SELECT bs.id_cama FROM bs JOIN k ON bs.id_atencion_actual = k.id_atencion) THEN 0 ELSE ocupada END
         AS ocupada, saldo
FROM camas
""")
def b2c(t):
    return _close(t)[2]


@query("b3_register_studies", sql=f"""
{with_roles('cargos', 'catalogo')},
det AS (SELECT d.id_atencion AS id_examen,
               CAST(CAST(c.precio AS DECIMAL(18,2)) * COALESCE(d.cantidad, 1) AS DECIMAL(18,2)) AS subtotal
        FROM cargos d JOIN catalogo c USING (id_catalogo) WHERE d.estado = 'PENDIENTE')
SELECT id_examen, {money('subtotal')} AS subtotal_total, COUNT(*) AS n_detalles FROM det GROUP BY id_examen
""")
def b3(t):
    req = t.cargos.filter("estado = 'PENDIENTE'").select(F.col("id_atencion").alias("id_examen"), "id_catalogo", "cantidad")
    return J.expand_orders(req, t.catalogo)[2]


def _results(t):
    promo = t.catalogo.filter("tipo = 'PROMO'").select("id_catalogo")
    r = t.cargos.filter("estado = 'PENDIENTE'").join(promo, "id_catalogo", "left_semi")
    return r.groupBy("id_atencion", "id_catalogo").agg(
        F.date_add(F.min("fecha"), 3).alias("fecha_resultado"),
        F.concat(F.lit("res_"), F.col("id_atencion").cast("string"), F.lit("_"), F.col("id_catalogo").cast("string"),
                 F.lit(".pdf")).alias("archivo_resultado"))


@query("b4_apply_results", sql=f"""
{with_roles('cargos', 'catalogo')},
r AS (SELECT id_atencion, id_catalogo, MIN(fecha) + INTERVAL 3 DAY AS fecha_resultado,
             'res_' || CAST(id_atencion AS VARCHAR) || '_' || CAST(id_catalogo AS VARCHAR) || '.pdf' AS archivo_resultado
      FROM cargos WHERE estado = 'PENDIENTE' AND id_catalogo IN (SELECT id_catalogo FROM catalogo WHERE tipo = 'PROMO')
      GROUP BY id_atencion, id_catalogo)
SELECT d.id_atencion, d.id_catalogo, d.linea, CASE WHEN r.id_atencion IS NOT NULL THEN 'REALIZADO' ELSE d.estado END AS estado,
       r.archivo_resultado, CAST(r.fecha_resultado AS DATE) AS fecha_realizado
FROM cargos d LEFT JOIN r USING (id_atencion, id_catalogo)
""")
def b4(t):
    det = t.cargos.select("id_atencion", "id_catalogo", "linea", "estado")
    return B.apply_results(det, _results(t))


@query("b5_assign_ids", sql=f"""
{with_roles('diagnosticos', 'atencion')}
SELECT id_diagnostico, lang, (SELECT MAX(id_atencion) FROM atencion) + ROW_NUMBER() OVER (ORDER BY id_diagnostico) AS nuevo_id
FROM diagnosticos
""")
def b5(t):
    mx = t.atencion.select(F.max("id_atencion")).scalar()
    return B.assign_ids(t.diagnosticos.select("id_diagnostico", "lang"), mx, ["id_diagnostico"])


@query("b6_append_log", sql=f"""
{with_roles('signos')}
SELECT id_signo, fecha, id_usuario, signo FROM signos
WHERE NOT COALESCE(starts_with(signo, 'view'), FALSE) UNION ALL
SELECT id_signo, fecha, id_usuario, signo FROM signos
WHERE NOT COALESCE(starts_with(signo, 'view'), FALSE) AND fecha > TIMESTAMP '2024-01-20 00:00:00'
""")
def b6(t):
    path = S.scratch_path(t.spark, "logs")
    logs = drop_prefixes(t.signos.select("id_signo", "fecha", "id_usuario", "signo"), "signo", ["view"])
    B.append_log(logs, path, 1)
    B.append_log(S.changed_since(logs, "fecha", "2024-01-20 00:00:00"), path, 2)  # a second batch
    B.append_log(S.changed_since(logs, "fecha", "2024-01-20 00:00:00"), path, 2)  # replayed: no duplicates
    return t.spark.read.parquet(path).drop("lote")


@query("b7_repair_dates", sql=f"""
{with_roles('atencion')}, x AS (SELECT id_atencion, {_ts_text_sql()} AS fecha_txt, {_ts_text_sql()} AS alta_txt FROM atencion)
SELECT id_atencion, CAST({parse_ts_sql('fecha_txt')} AS DATE) AS fecha_txt, CAST({parse_ts_sql('alta_txt')} AS DATE) AS alta_txt
FROM x
""")
def b7(t):
    x = t.atencion.select("id_atencion", _ts_text_spark().alias("fecha_txt"), _ts_text_spark().alias("alta_txt"))
    return B.repair_dates(x, ["fecha_txt", "alta_txt"])


def _delete_r(t):
    det = t.cargos.select("id_atencion", "linea", "id_catalogo", "tipo")
    return B.delete_where(det, t.atencion.select("id_atencion", "Id_exp"), F.col("tipo") == "R")


@query("b8_remaining_details", sql=f"""
{with_roles('cargos')}
SELECT id_atencion, linea, id_catalogo, tipo FROM cargos WHERE tipo <> 'R' OR tipo IS NULL
""")
def b8a(t):
    return _delete_r(t)[0]


@query("b8_remaining_headers", sql=f"""
{with_roles('cargos', 'atencion')}
SELECT id_atencion, Id_exp FROM atencion WHERE id_atencion NOT IN (
  SELECT id_atencion FROM cargos GROUP BY id_atencion HAVING bool_and(tipo = 'R'))
""")
def b8b(t):
    return _delete_r(t)[1]


def _admit(t):
    from pyspark.sql import Window

    # at most five doctors per patient: a top-5 window (planned as a WindowGroupLimit, so a
    # patient with many lines keeps only five rows per task before the shuffle)
    pairs = (t.cargos.select("id_atencion", F.col("id_medico").cast("string").alias("id_medico"))
             .join(t.atencion.select("id_atencion", "Id_exp"), "id_atencion").select("Id_exp", "id_medico").distinct())
    top5 = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("Id_exp").orderBy("id_medico"))).filter("_r <= 5")
    docs = top5.groupBy("Id_exp").agg(F.array_sort(F.collect_list("id_medico")).alias("medicos"))
    req = t.pacientes.filter("saldo < 0").select("Id_exp").join(docs, "Id_exp", "left")
    free = t.camas.filter("ocupada = 0")
    mx = t.atencion.select(F.max("id_atencion")).scalar()
    return B.admit(req, free, mx, AS_OF_ORDERS, ["Id_exp"])


ADMIT_SQL = f"""
req AS (SELECT Id_exp, ROW_NUMBER() OVER (ORDER BY Id_exp) AS n FROM pacientes WHERE saldo < 0),
fb AS (SELECT id_cama, ROW_NUMBER() OVER (ORDER BY id_cama) AS n FROM camas WHERE ocupada = 0),
mx AS (SELECT MAX(id_atencion) AS m FROM atencion)"""


@query("b9_admit_attentions", sql=f"""
{with_roles('pacientes', 'camas', 'atencion')}, {ADMIT_SQL}
SELECT CAST((SELECT m FROM mx) + req.n AS BIGINT) AS id_atencion, req.Id_exp, 'ABIERTA' AS status,
       DATE '{AS_OF_ORDERS}' AS fecha_ing, fb.id_cama
FROM req LEFT JOIN fb USING (n)
""")
def b9a(t):
    return _admit(t)[0]


@query("b9_admit_doctors", sql=f"""
{with_roles('pacientes', 'camas', 'atencion', 'cargos')}, {ADMIT_SQL},
d AS (SELECT a.Id_exp, list_sort(list_distinct(list(CAST(c.id_medico AS VARCHAR)))) AS medicos
      FROM cargos c JOIN atencion a USING (id_atencion) GROUP BY a.Id_exp),
x AS (SELECT CAST((SELECT m FROM mx) + req.n AS BIGINT) AS id_atencion, d.medicos FROM req LEFT JOIN d USING (Id_exp))
SELECT id_atencion, unnest(medicos[1:5]) AS id_medico FROM x
""")
def b9b(t):
    return _admit(t)[1]


@query("b9_beds_taken", sql=f"""
{with_roles('pacientes', 'camas', 'atencion')}, {ADMIT_SQL}
SELECT fb.id_cama, 1 AS ocupada FROM req JOIN fb USING (n)
""")
def b9c(t):
    return _admit(t)[2]


def _admitted(t) -> str:
    """Every indebted patient's request for admission, as a new patient with a relative, in one commit."""
    from pyspark.sql import Window

    pairs = (t.cargos.select("id_atencion", F.col("id_medico").cast("string").alias("id_medico"))
             .join(t.atencion.select("id_atencion", "Id_exp"), "id_atencion").select("Id_exp", "id_medico").distinct())
    top5 = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("Id_exp").orderBy("id_medico"))).filter("_r <= 5")
    docs = top5.groupBy("Id_exp").agg(F.array_sort(F.collect_list("id_medico")).alias("medicos"))
    req = t.pacientes.filter("saldo < 0").join(docs, "Id_exp", "left").select(
        F.col("Id_exp").alias("solicitud"), "nombre", "area", F.lit("GENERAL").alias("especialidad"), "medicos",
        F.concat(F.lit("Familiar de "), "nombre").alias("fam_nombre"), F.expr("CASE id_nacion % 3 WHEN 0 THEN 'MADRE' WHEN 1 THEN 'PADRE' ELSE 'OTRO' END").alias("parentesco"),
        F.concat(F.lit("55-"), F.col("Id_exp").cast("string")).alias("telefono"))
    outputs = B.admit_all(req, t.camas.filter("ocupada = 0"), t.pacientes.agg(F.max("Id_exp")).first()[0], t.atencion.agg(F.max("id_atencion")).first()[0],
                          AS_OF_ORDERS, ["solicitud"])
    path = S.scratch_path(t.spark, "admisiones")
    S.publish(t.spark, outputs, path, AS_OF_ORDERS)
    return path


ADMITTED_SQL = f"""
{with_roles('pacientes', 'camas', 'atencion', 'cargos')}, {ADMIT_SQL},
n AS (SELECT p.*, req.n, (SELECT MAX(Id_exp) FROM pacientes) + req.n AS nuevo, (SELECT m FROM mx) + req.n AS id_atencion FROM req JOIN pacientes p USING (Id_exp))"""


@query("b9_admit_patients", sql=f"""
{ADMITTED_SQL}
SELECT CAST(nuevo AS BIGINT) AS Id_exp, Id_exp AS solicitud, nombre, area FROM n
""")
def b9_patients(t):
    return S.read_published(t.spark, _admitted(t), "pacientes").drop("corrida")


@query("b9_admit_relatives", sql=f"""
{ADMITTED_SQL}
SELECT CAST(nuevo AS BIGINT) AS Id_exp, 'Familiar de ' || nombre AS nombre, CASE id_nacion % 3 WHEN 0 THEN 'MADRE' WHEN 1 THEN 'PADRE' ELSE 'OTRO' END AS parentesco,
       '55-' || CAST(Id_exp AS VARCHAR) AS telefono FROM n
""")
def b9_relatives(t):
    return S.read_published(t.spark, _admitted(t), "familiares").drop("corrida")


@query("b9_admit_commit", sql=f"""
{ADMITTED_SQL},
d AS (SELECT a.Id_exp, LEAST(COUNT(DISTINCT c.id_medico), 5) AS k FROM cargos c JOIN atencion a USING (id_atencion) GROUP BY 1)
SELECT CAST(1 AS BIGINT) AS version, '{AS_OF_ORDERS}' AS corrida, unnest(['pacientes', 'familiares', 'atencion', 'atencion_medicos', 'camas']) AS tabla,
       unnest([(SELECT COUNT(*) FROM n), (SELECT COUNT(*) FROM n), (SELECT COUNT(*) FROM n),
               (SELECT CAST(SUM(k) AS BIGINT) FROM n JOIN d USING (Id_exp)), (SELECT COUNT(*) FROM n JOIN fb USING (n))]) AS filas
""")
def b9_commit(t):
    """The manifest of the admission: all five outputs under one version."""
    return S.published(t.spark, _admitted(t)).drop("carpeta")


def _urgent_changes(t):
    urgent = t.atencion.filter("status = 'ABIERTA' AND especialidad = '1-URGENT'").select("id_atencion")
    return urgent.withColumn("id_medico", F.lit(0).cast("long"))


@query("b10_reassign_doctors", sql=f"""
{with_roles('cargos', 'atencion')},
ad AS (SELECT DISTINCT id_atencion, id_medico FROM cargos),
ch AS (SELECT id_atencion, CAST(0 AS BIGINT) AS id_medico FROM atencion WHERE status = 'ABIERTA' AND especialidad = '1-URGENT')
SELECT * FROM ad WHERE id_atencion NOT IN (SELECT id_atencion FROM ch) UNION ALL SELECT * FROM ch
""")
def b10(t):
    ad = t.cargos.select("id_atencion", "id_medico").distinct()
    return B.reassign(ad, _urgent_changes(t))


@query("b10_bed_moves", sql=f"""
{PRE},
mv AS (SELECT bs.id_cama AS cama_anterior, bs.id_cama + 1 AS cama_nueva FROM bs JOIN atencion a
       ON bs.id_atencion_actual = a.id_atencion WHERE a.especialidad = '1-URGENT'),
ch AS (SELECT id_cama, MAX(v) AS v FROM (SELECT cama_anterior AS id_cama, 0 AS v FROM mv
                                        UNION ALL SELECT cama_nueva, 1 FROM mv) GROUP BY id_cama)
SELECT c.id_cama, c.numero, c.id_nacion, c.nacion, c.area, COALESCE(ch.v, c.ocupada) AS ocupada, c.saldo
FROM camas c LEFT JOIN ch USING (id_cama)
""")
def b10b(t):
    bs = bed_states(t)
    urgent = t.atencion.filter("especialidad = '1-URGENT'").select(F.col("id_atencion").alias("id_atencion_actual"))
    moves = bs.join(urgent, "id_atencion_actual").select(F.col("id_cama").alias("cama_anterior"),
                                                         (F.col("id_cama") + 1).alias("cama_nueva"))
    return B.bed_moves(t.camas, moves)


@query("b12_insert_absent", sql=f"""
{with_roles('catalogo')}
SELECT * FROM catalogo WHERE tamano <= 25
UNION ALL SELECT * FROM catalogo WHERE tamano >= 20 AND id_catalogo NOT IN (SELECT id_catalogo FROM catalogo WHERE tamano <= 25)
""")
def b12a(t):
    c = t.catalogo
    return B.insert_absent(c.filter("tamano <= 25"), c.filter("tamano >= 20"), "id_catalogo")


@query("b12_delete_unused", sql=f"""
{PRE}
SELECT * FROM camas WHERE id_cama NOT IN (
  SELECT id_cama FROM camas WHERE saldo < 0 AND id_cama NOT IN (SELECT id_cama FROM cur))
""")
def b12b(t):
    from .q_rules import bed_occupancy
    from ..operators.rules import bed_status
    used = bed_status(t.camas, bed_occupancy(t)).filter(F.col("id_atencion_actual").isNotNull()).select("id_cama")
    return B.keep_unused_deletions(t.camas, t.camas.filter("saldo < 0"), used, "id_cama")
