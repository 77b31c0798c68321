"""Driver bindings for scans, sources and sinks.

Sink bindings write into a fresh folder under the session's ``spark.checkpoint.dir`` and
return the data read back, so the check covers the full write -> read round trip.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregates as A
from ..sources import backups as B
from ..sources import sinks as S
from ..sources import tables as TB
from . import vitals
from .bind import with_roles
from .registry import query
from .sqlkit import money, r6

S1_NAMES = ("customer", "orders", "lineitem", "part", "supplier", "historia_clinica")


@query("s1_load_tables", sql="""
SELECT 'customer' AS tabla, COUNT(*) AS filas, TRUE AS cargada FROM customer
UNION ALL SELECT 'orders', COUNT(*), TRUE FROM orders
UNION ALL SELECT 'lineitem', COUNT(*), TRUE FROM lineitem
UNION ALL SELECT 'part', COUNT(*), TRUE FROM part
UNION ALL SELECT 'supplier', COUNT(*), TRUE FROM supplier
UNION ALL SELECT 'historia_clinica', CAST(NULL AS BIGINT), FALSE
""")
def s1(t):
    tables, missing = TB.load_tables(t.spark, t.root, S1_NAMES)
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("tabla"), F.count(F.lit(1)).alias("filas"), F.lit(True).alias("cargada"))
        out = one if out is None else out.unionByName(one)
    for name in missing:
        one = t.spark.range(1).select(F.lit(name).alias("tabla"), F.lit(None).cast("long").alias("filas"),
                                      F.lit(False).alias("cargada"))
        out = out.unionByName(one)
    return out


@query("s2_recent", sql=f"""
{with_roles('signos')}
SELECT id_signo, fecha, signo, valor FROM signos ORDER BY fecha DESC, id_signo DESC LIMIT 700
""")
def s2(t):
    return TB.recent(t.signos, "fecha", "id_signo", 700, ["id_signo", "fecha", "signo", "valor"])


PACIENTES_DECLARED = T.StructType([
    T.StructField("Id_exp", T.LongType()), T.StructField("nombre", T.StringType()),
    T.StructField("area", T.StringType()), T.StructField("tel", T.StringType()),
    T.StructField("fecnac", T.DateType()), T.StructField("saldo", T.DecimalType(18, 2)),
])


@query("s3_conform", sql=f"""
{with_roles('pacientes')}
SELECT Id_exp, nombre, area, CAST(NULL AS VARCHAR) AS tel, CAST(NULL AS DATE) AS fecnac,
       TRY_CAST(saldo AS DECIMAL(18,2)) AS saldo
FROM pacientes
""")
def s3(t):
    return TB.conform(t.pacientes, PACIENTES_DECLARED)


@query("s4_ragged_union", sql=f"""
{with_roles('pacientes', 'camas')}
SELECT Id_exp, COALESCE(area, '') AS area, CAST(NULL AS BIGINT) AS id_cama, COALESCE(nombre, '') AS nombre,
       '' AS numero FROM pacientes
UNION ALL SELECT NULL, COALESCE(area, ''), id_cama, '', COALESCE(numero, '') FROM camas
""")
def s4(t):
    return TB.ragged_union([t.pacientes.select("Id_exp", "nombre", "area"), t.camas.select("id_cama", "numero", "area")])


@query("s5_write_results", sql=f"""
{with_roles('cargos')}
SELECT tipo, COUNT(*) AS n_registros, CAST({money('subtotal')} AS DOUBLE) AS total, {r6('AVG(subtotal)')} AS promedio,
       MAX(subtotal) AS maximo, MIN(subtotal) AS minimo, 'r1' AS run_id, 'descriptivo' AS section
FROM cargos GROUP BY tipo
""")
def s5(t):
    path = S.scratch_path(t.spark, "results")
    S.write_results(A.revenue_by(t.cargos, "tipo"), path, "r1", "descriptivo")
    back = t.spark.read.json(f"{path}/run_id=r1")
    return back.select("tipo", "n_registros", F.col("total").cast("double").alias("total"), "promedio", "maximo",
                       "minimo", "run_id", "section")


@query("s6_write_extract", sql=f"""
{with_roles('signos')}, w AS ({vitals.wide_sql()})
SELECT id_signo, id_usuario, fc, fr, temp, spo2, ta_sis FROM w WHERE COALESCE(fc > 100.0, FALSE) OR COALESCE(fc < 60.0, FALSE)
""")
def s6(t):
    w = vitals.wide(t.signos).drop("fecha")
    path = S.scratch_path(t.spark, "extract")
    S.write_extract(w, (F.col("fc") > 100.0) | (F.col("fc") < 60.0), path, "csv")
    return t.spark.read.option("header", True).schema(w.schema).csv(path)


ATENCION_SCHEMA = T.StructType([
    T.StructField("id_atencion", T.LongType()), T.StructField("Id_exp", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("estado_origen", T.StringType()),
    T.StructField("fecha_ing", T.DateType()), T.StructField("especialidad", T.StringType()),
    T.StructField("monto", T.DoubleType()),
])


@query("s7_s9_export_restore", sql=f"""
{with_roles('atencion')}
SELECT * FROM atencion
""")
def s7(t):
    path = S.scratch_path(t.spark, "backup")
    paths = S.export_tables({"atencion": t.atencion}, path, "json")
    return S.restore_tables(t.spark, paths, {"atencion": ATENCION_SCHEMA}, "json")["atencion"]


@query("s7_s9_export_restore_csv", sql=f"""
{with_roles('catalogo')}
SELECT * FROM catalogo
""")
def s7csv(t):
    schema = T.StructType([
        T.StructField("id_catalogo", T.LongType()), T.StructField("nombre", T.StringType()),
        T.StructField("marca", T.StringType()), T.StructField("tipo", T.StringType()),
        T.StructField("tamano", T.IntegerType()), T.StructField("precio", T.DoubleType()),
    ])
    path = S.scratch_path(t.spark, "backup-csv")
    paths = S.export_tables({"catalogo": t.catalogo}, path, "csv")
    return S.restore_tables(t.spark, paths, {"catalogo": schema}, "csv")["catalogo"]


@query("s8_changed_since", sql=f"""
{with_roles('signos')}
SELECT * FROM signos WHERE fecha > TIMESTAMP '2024-01-25 00:00:00'
""")
def s8(t):
    return S.changed_since(t.signos, "fecha", "2024-01-25 00:00:00")


@query("s8_change_summary", sql=f"""
{with_roles('signos', 'atencion')}
SELECT 'signos' AS tabla, COUNT(*) FILTER (WHERE fecha > TIMESTAMP '2001-06-01 00:00:00') AS cambios,
       MAX(fecha) AS nueva_marca FROM signos
UNION ALL
SELECT 'atencion', COUNT(*) FILTER (WHERE CAST(fecha_ing AS TIMESTAMP) > TIMESTAMP '2001-06-01 00:00:00'),
       MAX(CAST(fecha_ing AS TIMESTAMP)) FROM atencion
""")
def s8b(t):
    return S.change_summary({"signos": (t.signos, "fecha"), "atencion": (t.atencion, "fecha_ing")},
                            "2001-06-01 00:00:00")


# S8 copies: the tables as they were at four times. signos keeps RETAINED days (older rows are deleted),
# usuarios is one row for each user (rows change), atencion does not change after the full copy.
RETAINED = 12
COPIES = [(B.FULL, dt.datetime(2024, 1, 13), None), (B.INCREMENTAL, dt.datetime(2024, 1, 18), 1),
          (B.INCREMENTAL, dt.datetime(2024, 1, 22), 2), (B.DIFFERENTIAL, dt.datetime(2024, 1, 27), 1)]


def tables_at(t, now: dt.datetime) -> dict[str, B.Source]:
    at = F.lit(now).cast("timestamp_ntz")
    seen = t.signos.where(F.col("fecha") <= at)
    users = seen.groupBy("id_usuario").agg(F.count(F.lit(1)).alias("acciones"), F.max("fecha").alias("ultima"))
    return {"signos": B.Source(seen.where(F.col("fecha") > F.lit(now - dt.timedelta(days=RETAINED)).cast("timestamp_ntz")), ["id_signo"], "fecha"),
            "usuarios": B.Source(users, ["id_usuario"], "ultima"),
            "atencion": B.Source(t.atencion, ["id_atencion"], "fecha_ing")}


def copied(t, *names: str) -> B.BackupStore:
    """The four copies of the named tables (all if none is named)."""
    store = B.BackupStore(t.spark, S.scratch_path(t.spark, "copies"))
    for kind, now, _ in COPIES:
        tables = tables_at(t, now)
        store.copy({n: tables[n] for n in names or tables}, kind, now)
    return store


def _ts(x: dt.datetime) -> str:
    return f"TIMESTAMP '{x:%Y-%m-%d %H:%M:%S}'"


def state_sql(name: str, now: dt.datetime) -> str:
    old = now - dt.timedelta(days=RETAINED)
    return {"signos": f"SELECT * FROM signos WHERE fecha <= {_ts(now)} AND fecha > {_ts(old)}",
            "usuarios": f"SELECT id_usuario, COUNT(*) AS acciones, MAX(fecha) AS ultima FROM signos WHERE fecha <= {_ts(now)} GROUP BY id_usuario",
            "atencion": "SELECT * FROM atencion"}[name]


def control_sql() -> str:
    """The control rows from the tables' states alone: what the base's mark and keys leave over."""
    parts = []
    for name, key, stamp in (("signos", "id_signo", "fecha"), ("usuarios", "id_usuario", "ultima"), ("atencion", "id_atencion", "fecha_ing")):
        for version, (kind, now, base) in enumerate(COPIES, 1):
            here, there = state_sql(name, now), state_sql(name, COPIES[base - 1][1]) if base else None
            mark = f"(SELECT CAST(MAX({stamp}) AS TIMESTAMP) FROM ({there}))" if base else "CAST(NULL AS TIMESTAMP)"
            late = f"CAST({stamp} AS TIMESTAMP) > {mark} OR {key} NOT IN (SELECT {key} FROM ({there}))" if base else "TRUE"
            gone = f"(SELECT COUNT(*) FROM ({there}) WHERE {key} NOT IN (SELECT {key} FROM ({here})))" if base else "0"
            parts.append(f"""SELECT CAST({version} AS INTEGER) AS version, '{kind}' AS tipo, {_ts(now)} AS copiada, '{name}' AS tabla, '{key}' AS llaves,
       CAST({base or 'NULL'} AS INTEGER) AS base, {mark} AS desde, (SELECT COUNT(*) FROM ({here}) WHERE {late}) AS filas,
       CAST({gone} AS BIGINT) AS bajas, (SELECT CAST(MAX({stamp}) AS TIMESTAMP) FROM ({here})) AS nueva_marca""")
    return "\nUNION ALL\n".join(parts)


CHANGED = "tabla, base, desde, filas, bajas, nueva_marca"


@query("s8_control", sql=f"{with_roles('signos', 'atencion')}, control AS ({control_sql()}) SELECT * FROM control")
def s8_control(t):
    return copied(t).control()


@query("s8_differential", sql=f"""
{with_roles('signos', 'atencion')}, control AS ({control_sql()})
SELECT {CHANGED} FROM control WHERE tipo = 'diferencial' AND filas + bajas > 0
""")
def s8_differential(t):
    """Tables that changed since the last full copy."""
    return copied(t).control().where(f"tipo = '{B.DIFFERENTIAL}' AND filas + bajas > 0").selectExpr(*CHANGED.split(", "))


@query("s8_incremental", sql=f"""
{with_roles('signos', 'atencion')}, control AS ({control_sql()})
SELECT version, {CHANGED} FROM control WHERE tipo = 'incremental' AND filas + bajas > 0
""")
def s8_incremental(t):
    """Tables that changed since the last copy of any kind, copy by copy."""
    return copied(t).control().where(f"tipo = '{B.INCREMENTAL}' AND filas + bajas > 0").selectExpr("version", *CHANGED.split(", "))


_NOW, _BASE = COPIES[3][1], COPIES[0][1]


@query("s8_delta_export", sql=f"""
{with_roles('signos')}, ahora AS ({state_sql('signos', _NOW)}), antes AS ({state_sql('signos', _BASE)})
SELECT id_signo, fecha, id_usuario, signo, valor, props, 'U' AS _op FROM ahora WHERE fecha > (SELECT MAX(fecha) FROM antes)
UNION ALL
SELECT id_signo, NULL, NULL, NULL, NULL, NULL, 'D' FROM antes WHERE id_signo NOT IN (SELECT id_signo FROM ahora)
""")
def s8_delta_export(t):
    """The rows and tombstones of the differential copy of signos, read from the store."""
    store = copied(t, "signos")
    return store.delta_rows("signos", store.last([B.DIFFERENTIAL]))


@query("s8_s9_replay", sql=f"""
{with_roles('signos')}
SELECT 3 AS version, * FROM ({state_sql('signos', COPIES[2][1])})
UNION ALL
SELECT 4, * FROM ({state_sql('signos', _NOW)})
""")
def s8_replay(t):
    """signos restored from the store: full plus two incremental copies, and full plus the differential one."""
    store = copied(t, "signos")
    return store.restore("signos", 3).select(F.lit(3).alias("version"), "*").unionByName(
        store.restore("signos", 4).select(F.lit(4).alias("version"), "*"))


@query("s10_retain_latest", sql=f"""
{with_roles('signos')}
SELECT id_signo, fecha, id_usuario, signo, valor, props FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY signo ORDER BY fecha DESC, id_signo DESC) AS rn FROM signos) WHERE rn <= 4
""")
def s10(t):
    return S.retain_latest(t.signos, "signo", "fecha", "id_signo", 4)


CARGOS_SCHEMA = T.StructType([
    T.StructField("id_atencion", T.LongType()), T.StructField("linea", T.IntegerType()),
    T.StructField("cantidad", T.DoubleType()), T.StructField("subtotal", T.DecimalType(18, 2)),
    T.StructField("estado", T.StringType()), T.StructField("fecha", T.DateType()),
])


@query("s9_restore_tables", sql=f"""
{with_roles('cargos')}
SELECT id_atencion, linea, cantidad, CAST(subtotal AS DECIMAL(18,2)) AS subtotal, estado, fecha FROM cargos
""")
def s9(t):
    src = t.cargos.select("id_atencion", "linea", "cantidad", F.col("subtotal").cast("decimal(18,2)").alias("subtotal"),
                          "estado", "fecha")
    path = S.scratch_path(t.spark, "restore")
    paths = S.export_tables({"cargos": src}, path, "csv")
    return S.restore_tables(t.spark, paths, {"cargos": CARGOS_SCHEMA}, "csv")["cargos"]
