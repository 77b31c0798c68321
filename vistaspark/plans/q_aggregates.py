"""Driver bindings for the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import age_calendar
from ..functions.text import classify, fold
from ..operators import aggregates as A
from ..operators.filters import band
from . import vitals
from .bind import AS_OF_ORDERS, with_roles
from .registry import query
from .sqlkit import contains_any, fold as sql_fold, money, pct, r6

# Binding parameters (catalogue words stand in for exam keywords).
PROFILE_RULES = (
    ("Retina y macula", ("RING", "PLATE")),
    ("Glaucoma", ("BOLT", "ROD")),
    ("Cornea", ("GEAR",)),
    ("Catarata", ("WIDGET",)),
    ("Vision y refraccion", ("GIZMO",)),
)
PROFILE_DEFAULT = "Otros estudios"
OCULAR_WORDS = ("ring", "gear")


def profile_case_sql(x: str) -> str:
    parts = " ".join(
        f"WHEN {contains_any(x, [w.upper() for w in words])} THEN '{label}'" for label, words in PROFILE_RULES
    )
    return f"CASE {parts} ELSE '{PROFILE_DEFAULT}' END"


@query("a1_revenue_by", sql=f"""
{with_roles('cargos')}
SELECT tipo, COUNT(*) AS n_registros, {money('subtotal')} AS total, {r6('AVG(subtotal)')} AS promedio,
       MAX(subtotal) AS maximo, MIN(subtotal) AS minimo
FROM cargos GROUP BY tipo
""")
def a1(t):
    return A.revenue_by(t.cargos, "tipo")


@query("a2_top_by_sum", sql=f"""
{with_roles('cargos')}
SELECT id_catalogo, {money('subtotal')} AS total, COUNT(*) AS n_registros
FROM cargos GROUP BY id_catalogo ORDER BY total DESC, id_catalogo LIMIT 10
""")
def a2(t):
    return A.top_by_sum(t.cargos, "id_catalogo", k=10)


@query("a3_global_stats", sql=f"""
{with_roles('cargos')}
SELECT COALESCE({r6('AVG(subtotal)')}, 0.0) AS media, COALESCE({r6('STDDEV_SAMP(subtotal)')}, 0.0) AS desviacion,
       COALESCE({money('subtotal')}, CAST(0 AS DECIMAL(38,2))) AS total, COUNT(subtotal) AS n
FROM cargos
""")
def a3(t):
    return A.global_stats(t.cargos, "subtotal")


def _profile_sql(role: str, cat: str, price: str) -> str:
    return (
        f"SELECT '{role}' AS tabla, COUNT(*) AS filas, COUNT(DISTINCT {cat}) AS distintos, "
        f"string_agg(DISTINCT {cat}, ',' ORDER BY {cat}) AS valores, "
        f"MIN({price}) AS precio_min, MAX({price}) AS precio_max FROM {role}"
    )


@query("a4_profile_tables", sql=f"""
{with_roles('cargos', 'atencion', 'pacientes', 'catalogo')}
{_profile_sql('cargos', 'estado', 'precio')} UNION ALL {_profile_sql('atencion', 'status', 'monto')}
UNION ALL {_profile_sql('pacientes', 'area', 'saldo')} UNION ALL {_profile_sql('catalogo', 'tipo', 'precio')}
""")
def a4(t):
    return A.profile_tables([
        (t.cargos, "cargos", "estado", "precio"), (t.atencion, "atencion", "status", "monto"),
        (t.pacientes, "pacientes", "area", "saldo"), (t.catalogo, "catalogo", "tipo", "precio"),
    ])


@query("a5_count_where", sql=f"""
{with_roles('cargos')}
SELECT id_atencion, COUNT(*) AS total,
       COUNT(*) FILTER (WHERE estado = 'REALIZADO') AS realizados,
       COUNT(*) FILTER (WHERE estado = 'PENDIENTE') AS pendientes,
       COUNT(*) FILTER (WHERE estado = 'CANCELADO') AS cancelados
FROM cargos GROUP BY id_atencion
""")
def a5(t):
    e = F.col("estado")
    return A.count_where(t.cargos, "id_atencion", {
        "realizados": e == "REALIZADO", "pendientes": e == "PENDIENTE", "cancelados": e == "CANCELADO"})


@query("a6_repeats", sql=f"""
{with_roles('cargos')}
SELECT id_medico, COUNT(*) AS n, COUNT(DISTINCT id_catalogo) AS distintos,
       COUNT(*) - COUNT(DISTINCT id_catalogo) AS repetidos
FROM cargos GROUP BY id_medico
""")
def a6(t):
    return A.repeats(t.cargos, "id_medico", "id_catalogo")


@query("a7_first_last_date", sql=f"""
{with_roles('cargos')}
SELECT id_medico, MIN(fecha) AS primer_estudio, MAX(fecha) AS ultimo_estudio FROM cargos GROUP BY id_medico
""")
def a7(t):
    return t.cargos.groupBy("id_medico").agg(F.min("fecha").alias("primer_estudio"),
                                             F.max("fecha").alias("ultimo_estudio"))


@query("a8_open_account_totals", sql=f"""
{with_roles('atencion', 'cargos')},
tot AS (SELECT id_atencion, {money('subtotal')} AS total_cuenta FROM cargos GROUP BY id_atencion)
SELECT a.*, COALESCE(t.total_cuenta, CAST(0 AS DECIMAL(38,2))) AS total_cuenta
FROM atencion a LEFT JOIN tot t USING (id_atencion) WHERE a.status = 'ABIERTA'
""")
def a8(t):
    return A.open_account_totals(t.atencion, t.cargos)


@query("a9_product_totals", sql=f"""
{with_roles('cargos')}
SELECT id_catalogo, SUM(cantidad) AS cantidad_total, {r6('AVG(precio)')} AS precio_promedio,
       COUNT(*) AS n_ventas, {r6('SUM(precio * cantidad)')} AS ingreso
FROM cargos GROUP BY id_catalogo
""")
def a9(t):
    return A.product_totals(t.cargos, "id_catalogo", "cantidad", "precio")


@query("a10_rollup_status", sql=f"""
{with_roles('cargos')}
SELECT id_atencion,
       CASE WHEN bool_or(upper(trim(estado)) = 'PENDIENTE') THEN 'PENDIENTE'
            WHEN bool_or(upper(trim(estado)) = 'CANCELADO') THEN 'CANCELADO' ELSE 'REALIZADO' END AS estado_general,
       COUNT(*) AS n_detalles
FROM cargos GROUP BY id_atencion
""")
def a10(t):
    return A.rollup_status(t.cargos, "id_atencion", "estado")


@query("a12_nest_details", sql=f"""
{with_roles('cargos')}
SELECT id_atencion, string_agg(CAST(linea AS VARCHAR) || ':' || estado, ';' ORDER BY linea, estado) AS detalles
FROM cargos GROUP BY id_atencion
""")
def a12(t):
    nested = A.nest_details(t.cargos, "id_atencion", ["linea"], ["estado"])
    return nested.select("id_atencion", F.array_join(
        F.transform("detalles", lambda x: F.concat(x["linea"].cast("string"), F.lit(":"), x["estado"])), ";"
    ).alias("detalles"))


@query("a13_names_joined", sql=f"""
{with_roles('cargos', 'catalogo')}
SELECT d.id_atencion, string_agg(c.nombre, ', ' ORDER BY d.linea, c.nombre) AS nombres
FROM cargos d JOIN catalogo c USING (id_catalogo) GROUP BY d.id_atencion
""")
def a13(t):
    j = t.cargos.select("id_atencion", "linea", "id_catalogo").join(t.catalogo.select("id_catalogo", "nombre"),
                                                                     "id_catalogo")
    return A.names_joined(j, "id_atencion", "nombre", order="linea")


@query("a14_pending_by_type", sql=f"""
{with_roles('cargos', 'catalogo')},
j AS (SELECT d.id_atencion, c.tipo FROM cargos d JOIN catalogo c USING (id_catalogo)
      WHERE upper(trim(d.estado)) = 'PENDIENTE')
SELECT tipo, COUNT(DISTINCT id_atencion) AS pendientes FROM j GROUP BY tipo
UNION ALL SELECT 'TOTAL' AS tipo, COUNT(DISTINCT id_atencion) AS pendientes FROM j
""")
def a14(t):
    return A.pending_by_type(t.cargos, t.catalogo)


@query("a15_duplicate_keys", sql=f"""
{with_roles('diagnosticos')},
d AS (SELECT texto, COUNT(*) AS veces FROM diagnosticos GROUP BY texto HAVING COUNT(*) > 1)
SELECT x.texto, x.id_diagnostico, d.veces FROM diagnosticos x JOIN d USING (texto)
""")
def a15(t):
    return A.duplicate_keys(t.diagnosticos, "texto", "id_diagnostico")


@query("a16_max_key", sql=f"""
{with_roles('atencion')}
SELECT CAST(COALESCE(MAX(id_atencion), 0) AS BIGINT) AS max_id FROM atencion
""")
def a16(t):
    return A.max_key(t.atencion, "id_atencion")


@query("a17_occupancy", sql=f"""
{with_roles('camas')},
g AS (SELECT area, GROUPING(area) AS g, COUNT(*) AS total,
             COUNT(*) FILTER (WHERE COALESCE(ocupada, 0) = 1) AS ocupadas
      FROM camas GROUP BY ROLLUP (area))
SELECT CASE WHEN g = 1 THEN 'TOTAL' ELSE COALESCE(area, 'Sin dato') END AS area, total, ocupadas,
       total - ocupadas AS libres, {pct('ocupadas', 'total')} AS porcentaje,
       {pct('ocupadas', 'total')} > 80.0 AS critica
FROM g
""")
def a17(t):
    return A.occupancy(t.camas)


@query("a18_demand", sql=f"""
{with_roles('atencion', 'pacientes')}
SELECT a.especialidad, p.area, COUNT(*) AS n
FROM atencion a JOIN pacientes p USING (Id_exp)
GROUP BY a.especialidad, p.area ORDER BY n DESC, a.especialidad, p.area LIMIT 10
""")
def a18(t):
    j = t.atencion.select("Id_exp", "especialidad").join(t.pacientes.select("Id_exp", "area"), "Id_exp")
    return A.demand(j, ("especialidad", "area"), 10)


@query("a19_value_counts", sql=f"""
{with_roles('cargos')}
SELECT id_catalogo, COUNT(*) AS n FROM cargos GROUP BY id_catalogo
""")
def a19(t):
    return A.value_counts(t.cargos, "id_catalogo")


# binding cut points for the price band (prices here are 900-2100 per unit)
BAND_CUTS = (1000.0, 1500.0)


@query("a20_revenue_by_band", sql=f"""
{with_roles('cargos')},
b AS (SELECT *, CASE WHEN precio IS NULL THEN NULL WHEN precio < 1000.0 THEN 'Bajo'
                     WHEN precio < 1500.0 THEN 'Medio' ELSE 'Alto' END AS banda FROM cargos)
SELECT banda, COUNT(*) AS n_registros, {money('subtotal')} AS total, {r6('AVG(subtotal)')} AS promedio,
       MAX(subtotal) AS maximo, MIN(subtotal) AS minimo
FROM b GROUP BY banda
""")
def a20_band(t):
    return A.revenue_by(t.cargos.withColumn("banda", band("precio", BAND_CUTS)), "banda")


@query("a20_revenue_by_month", sql=f"""
{with_roles('cargos')}
SELECT CAST(year(fecha) AS INTEGER) AS anio, CAST(month(fecha) AS INTEGER) AS mes, COUNT(*) AS n_registros, {money('subtotal')} AS total,
       {r6('AVG(subtotal)')} AS promedio, MAX(subtotal) AS maximo, MIN(subtotal) AS minimo
FROM cargos GROUP BY 1, 2
""")
def a20_month(t):
    c = t.cargos.withColumn("anio", F.year("fecha")).withColumn("mes", F.month("fecha"))
    return A.revenue_by(c, ["anio", "mes"])


@query("a21_type_stats", sql=f"""
{with_roles('cargos')}
SELECT tipo, {money('subtotal')} AS total, {r6('AVG(subtotal)')} AS promedio, COUNT(*) AS n,
       {r6('AVG(precio)')} AS precio_promedio, {r6('STDDEV_SAMP(precio)')} AS precio_std
FROM cargos GROUP BY tipo
""")
def a21(t):
    return A.type_stats(t.cargos, "tipo")


CORR_COLS = ("cantidad", "precio", "subtotal")


def _corr_sql() -> str:
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            parts.append(
                f"SELECT '{a}' AS var_a, '{b}' AS var_b, "
                f"ROUND(CASE WHEN STDDEV_SAMP({a}) * STDDEV_SAMP({b}) = 0 THEN NULL "
                f"ELSE COVAR_SAMP({a}, {b}) / (STDDEV_SAMP({a}) * STDDEV_SAMP({b})) END, 6) AS corr FROM cargos"
            )
    return " UNION ALL ".join(parts)


@query("a22_corr_matrix", sql=f"""
{with_roles('cargos')}
{_corr_sql()}
""")
def a22(t):
    return A.corr_matrix(t.cargos, CORR_COLS)


@query("a23_monthly_trend", sql=f"""
{with_roles('atencion')},
m AS (SELECT CAST(unnest(generate_series(DATE '2001-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS mes),
c AS (SELECT CAST(date_trunc('month', fecha_ing) AS DATE) AS mes, COUNT(*) AS n FROM atencion GROUP BY 1)
SELECT m.mes, CAST(COALESCE(c.n, 0) AS BIGINT) AS n FROM m LEFT JOIN c USING (mes)
""")
def a23(t):
    return A.monthly_trend(t.atencion, "fecha_ing", 12, AS_OF_ORDERS)


@query("a24_share_top", sql=f"""
{with_roles('pacientes')},
c AS (SELECT COALESCE(CAST(area AS VARCHAR), 'Sin dato') AS categoria, COUNT(*) AS n FROM pacientes GROUP BY 1),
top AS (SELECT * FROM c ORDER BY n DESC, categoria LIMIT 3),
tot AS (SELECT COUNT(*) AS t FROM pacientes),
u AS (SELECT categoria, n FROM top
      UNION ALL SELECT 'Otros', CAST((SELECT t FROM tot) - (SELECT COALESCE(SUM(n), 0) FROM top) AS BIGINT)
      WHERE (SELECT t FROM tot) - (SELECT COALESCE(SUM(n), 0) FROM top) > 0)
SELECT categoria, n, {pct('n', '(SELECT t FROM tot)')} AS porcentaje FROM u
""")
def a24(t):
    return A.share_top(t.pacientes, "area", n=4)


@query("a25_rank_items", sql=f"""
{with_roles('cargos', 'catalogo')},
j AS (SELECT c.nombre FROM cargos d JOIN catalogo c USING (id_catalogo)),
m AS (SELECT nombre, COUNT(*) AS n FROM j WHERE contains(nombre, 'ring') GROUP BY nombre ORDER BY n DESC, nombre LIMIT 7),
a AS (SELECT nombre, COUNT(*) AS n FROM j GROUP BY nombre ORDER BY n DESC, nombre LIMIT 7)
SELECT nombre, n, TRUE AS coincide FROM m
UNION ALL SELECT nombre, n, FALSE AS coincide FROM a WHERE (SELECT COUNT(*) FROM j WHERE contains(nombre, 'ring')) = 0
""")
def a25(t):
    j = t.cargos.select("id_catalogo").join(t.catalogo.select("id_catalogo", "nombre"), "id_catalogo")
    return A.rank_items(j, "nombre", F.col("nombre").contains("ring"), 7)


@query("a26_profile_counts", sql=f"""
{with_roles('cargos', 'catalogo')}
SELECT {profile_case_sql(sql_fold('c.nombre'))} AS perfil, COUNT(*) AS n
FROM cargos d JOIN catalogo c USING (id_catalogo) GROUP BY 1
""")
def a26(t):
    j = t.cargos.select("id_catalogo").join(t.catalogo.select("id_catalogo", "nombre"), "id_catalogo")
    return A.value_counts(j.withColumn("perfil", classify("nombre", PROFILE_RULES, PROFILE_DEFAULT)), "perfil")


@query("a27_patients_with", sql=f"""
{with_roles('cargos', 'catalogo', 'atencion')},
j AS (SELECT a.Id_exp, {contains_any(sql_fold('c.nombre'), [w.upper() for w in OCULAR_WORDS])} AS hit
      FROM cargos d JOIN atencion a USING (id_atencion) JOIN catalogo c USING (id_catalogo))
SELECT COUNT(DISTINCT CASE WHEN hit THEN Id_exp END) AS pacientes, COUNT(*) FILTER (WHERE hit) AS registros FROM j
""")
def a27(t):
    j = (t.cargos.select("id_atencion", "id_catalogo")
         .join(t.atencion.select("id_atencion", "Id_exp"), "id_atencion")
         .join(t.catalogo.select("id_catalogo", "nombre"), "id_catalogo"))
    return A.patients_with(j, "Id_exp", ["nombre"], OCULAR_WORDS)


@query("a28_revenue_share", sql=f"""
{with_roles('cargos')},
g AS (SELECT tipo, {money('subtotal')} AS monto, COUNT(*) AS n, {r6('AVG(subtotal)')} AS promedio_servicio
      FROM cargos GROUP BY tipo),
tot AS (SELECT {money('subtotal')} AS t FROM cargos)
SELECT g.*, {pct('monto', '(SELECT t FROM tot)')} AS porcentaje FROM g
""")
def a28(t):
    return A.revenue_share(t.cargos, "tipo")


def alert_sql() -> str:
    parts = []
    for name, (lo, hi) in vitals.SINGLE.items():
        conds = []
        if lo is not None:
            conds.append(f"{name} < {lo}")
        if hi is not None:
            conds.append(f"{name} > {hi}")
        parts.append(
            f"SELECT '{name}' AS signo, COUNT(*) FILTER (WHERE {name} IS NOT NULL AND ({' OR '.join(conds)})) AS alertas, "
            f"COUNT({name}) AS validos FROM w"
        )
    part = lambda name, i: f"CAST(NULLIF(regexp_extract({name}, '(\\d{{2,3}})\\s*/\\s*(\\d{{2,3}})', {i}), '') AS INTEGER)"
    for name, ((sis_lo, sis_hi), (dia_lo, dia_hi)) in vitals.PRESSURES.items():
        parts.append(
            f"SELECT '{name}' AS signo, COUNT(*) FILTER (WHERE sis NOT BETWEEN {sis_lo} AND {sis_hi} OR dia NOT BETWEEN {dia_lo} AND {dia_hi}) AS alertas, "
            f"COUNT(sis) AS validos FROM (SELECT {part(name, 1)} AS sis, {part(name, 2)} AS dia FROM w)"
        )
    return " UNION ALL ".join(parts)


@query("a29_alert_rates", sql=f"""
{with_roles('signos')}, w AS ({vitals.with_pressure_sql()}),
r AS ({alert_sql()})
SELECT signo, alertas, validos, {pct('alertas', 'validos')} AS porcentaje FROM r
""")
def a29(t):
    return A.alert_rates(vitals.with_pressure(t.signos), vitals.SINGLE, vitals.PRESSURES)


@query("a30_iqr_summary", sql=f"""
{with_roles('cargos')},
q AS (SELECT quantile_cont(subtotal, 0.25) AS q1, quantile_cont(subtotal, 0.5) AS q2,
             quantile_cont(subtotal, 0.75) AS q3 FROM cargos)
SELECT COUNT(subtotal) AS n, {r6('ANY_VALUE(q1)')} AS q1, {r6('ANY_VALUE(q2)')} AS mediana, {r6('ANY_VALUE(q3)')} AS q3,
       {r6('ANY_VALUE(q3 - q1)')} AS iqr, {r6('ANY_VALUE(q3 + 1.5 * (q3 - q1))')} AS limite_superior,
       COUNT(*) FILTER (WHERE subtotal > q3 + 1.5 * (q3 - q1)) AS atipicos
FROM cargos, q
""")
def a30(t):
    return A.iqr_summary(t.cargos, "subtotal", method="rank")


@query("a31_histogram", sql=f"""
{with_roles('cargos')},
s AS (SELECT COUNT(subtotal) AS n, CAST(MIN(subtotal) AS DOUBLE) AS lo, CAST(MAX(subtotal) AS DOUBLE) AS hi FROM cargos),
k AS (SELECT n, lo, hi, CASE WHEN hi = lo THEN 1 ELSE LEAST(GREATEST(CAST(FLOOR(SQRT(n)) AS INTEGER), 5), 10) END AS k FROM s),
w AS (SELECT *, (hi - lo) / k AS w FROM k),
b AS (SELECT CASE WHEN w.w > 0 THEN LEAST(CAST(FLOOR((subtotal - w.lo) / w.w) AS INTEGER), w.k - 1) ELSE 0 END AS bin,
             COUNT(*) AS n
      FROM cargos, w WHERE subtotal IS NOT NULL GROUP BY 1),
bins AS (SELECT CAST(unnest(range(0, k)) AS INTEGER) AS bin FROM w WHERE n > 0)
SELECT bins.bin, ROUND(w.lo + bins.bin * w.w, 6) AS desde, ROUND(w.lo + (bins.bin + 1) * w.w, 6) AS hasta,
       CAST(COALESCE(b.n, 0) AS BIGINT) AS n
FROM bins CROSS JOIN w LEFT JOIN b USING (bin)
""")
def a31(t):
    return A.histogram(t.cargos, "subtotal")


@query("a32_box_stats", sql=f"""
{with_roles('cargos')}
SELECT tipo, COUNT(subtotal) AS n, {r6('quantile_cont(subtotal, 0.0)')} AS minimo, {r6('quantile_cont(subtotal, 0.25)')} AS q1,
       {r6('quantile_cont(subtotal, 0.5)')} AS mediana, {r6('quantile_cont(subtotal, 0.75)')} AS q3,
       {r6('quantile_cont(subtotal, 1.0)')} AS maximo
FROM cargos GROUP BY tipo
""")
def a32(t):
    return A.box_stats(t.cargos, "tipo", "subtotal", method="rank")


def birth_dates(t):
    """Binding: a patient's birth date is the date of their first attention."""
    return t.atencion.groupBy("Id_exp").agg(F.min("fecha_ing").alias("fecnac"))


BIRTH_SQL = "SELECT Id_exp, MIN(fecha_ing) AS fecnac FROM atencion GROUP BY Id_exp"


def age_sql(b: str, a: str) -> str:
    return (f"CAST(CASE WHEN (year({a}) - year({b}) - CASE WHEN month({a}) < month({b}) OR (month({a}) = month({b}) "
            f"AND day({a}) < day({b})) THEN 1 ELSE 0 END) BETWEEN 0 AND 120 THEN "
            f"(year({a}) - year({b}) - CASE WHEN month({a}) < month({b}) OR (month({a}) = month({b}) "
            f"AND day({a}) < day({b})) THEN 1 ELSE 0 END) END AS INTEGER)")


@query("a33_mean_age", sql=f"""
{with_roles('atencion')}, b AS ({BIRTH_SQL}),
e AS (SELECT {age_sql('fecnac', "DATE '2001-12-01'")} AS edad FROM b)
SELECT {r6('AVG(edad)')} AS edad_promedio, COUNT(edad) AS n FROM e
""")
def a33(t):
    return A.mean_age(birth_dates(t).select(age_calendar("fecnac", AS_OF_ORDERS).alias("edad")))


@query("a34_kpis", sql=f"""
{with_roles('pacientes', 'atencion', 'cargos', 'catalogo', 'camas')}
SELECT (SELECT COUNT(*) FROM pacientes) AS pacientes,
       (SELECT COUNT(*) FROM atencion WHERE status = 'ABIERTA') AS atenciones_abiertas,
       (SELECT COUNT(*) FROM cargos) AS estudios,
       (SELECT COUNT(DISTINCT a.Id_exp) FROM cargos d JOIN atencion a USING (id_atencion) JOIN catalogo c USING (id_catalogo)
        WHERE {contains_any(sql_fold('c.nombre'), [w.upper() for w in OCULAR_WORDS])}) AS pacientes_oculares,
       (SELECT {pct("COUNT(*) FILTER (WHERE ocupada = 1)", "COUNT(*)")} FROM camas) AS ocupacion,
       (SELECT {r6('AVG(subtotal)')} FROM cargos) AS cargo_promedio
""")
def a34(t):
    ocular = (t.cargos.select("id_atencion", "id_catalogo")
              .join(t.atencion.select("id_atencion", "Id_exp"), "id_atencion")
              .join(t.catalogo.select("id_catalogo", "nombre"), "id_catalogo")
              .filter(A.contains_any(fold("nombre"), [w.upper() for w in OCULAR_WORDS])))
    from ..functions.numbers import pct as pct_
    return A.kpis(t.spark, {
        "pacientes": t.pacientes.select(F.count(F.lit(1))).scalar(),
        "atenciones_abiertas": t.atencion.filter("status = 'ABIERTA'").select(F.count(F.lit(1))).scalar(),
        "estudios": t.cargos.select(F.count(F.lit(1))).scalar(),
        "pacientes_oculares": ocular.select(F.count_distinct("Id_exp")).scalar(),
        "ocupacion": t.camas.select(pct_(F.count_if(F.col("ocupada") == 1), F.count(F.lit(1)))).scalar(),
        "cargo_promedio": t.cargos.select(F.round(F.avg("subtotal"), 6)).scalar(),
    })


def _describe_sql() -> str:
    parts = []
    for c in CORR_COLS:
        parts.append(
            f"SELECT '{c}' AS columna, COUNT({c}) AS n, {r6(f'AVG({c})')} AS media, {r6(f'STDDEV_SAMP({c})')} AS desviacion, "
            f"CAST(MIN({c}) AS DOUBLE) AS minimo, {r6(f'quantile_cont({c}, 0.25)')} AS q25, "
            f"{r6(f'quantile_cont({c}, 0.5)')} AS q50, {r6(f'quantile_cont({c}, 0.75)')} AS q75, "
            f"CAST(MAX({c}) AS DOUBLE) AS maximo FROM cargos"
        )
    return " UNION ALL ".join(parts)


@query("a35_describe", sql=f"""
{with_roles('cargos')}
{_describe_sql()}
""")
def a35(t):
    return A.describe(t.cargos, CORR_COLS, method="rank")


@query("a36_argmax_rows", sql=f"""
{with_roles('catalogo')}
(SELECT 'precio' AS columna, CAST(precio AS DOUBLE) AS valor, id_catalogo, nombre FROM catalogo
 WHERE precio IS NOT NULL ORDER BY precio DESC, id_catalogo LIMIT 1)
UNION ALL
(SELECT 'tamano' AS columna, CAST(tamano AS DOUBLE) AS valor, id_catalogo, nombre FROM catalogo
 WHERE tamano IS NOT NULL ORDER BY tamano DESC, id_catalogo LIMIT 1)
""")
def a36(t):
    return A.argmax_rows(t.catalogo, ["precio", "tamano"], "id_catalogo", keep=["nombre"])


@query("a37_top_category", sql=f"""
{with_roles('catalogo')}
SELECT tipo, COUNT(*) AS n FROM catalogo GROUP BY tipo ORDER BY n DESC, tipo LIMIT 1
""")
def a37(t):
    return A.top_category(t.catalogo, "tipo")


@query("a38_inventory_summary", sql=f"""
{with_roles('catalogo')}
SELECT CASE WHEN GROUPING(tipo) = 1 THEN 'TOTAL' ELSE tipo END AS tipo, COUNT(*) AS filas,
       CAST(SUM(tamano) AS BIGINT) AS stock_total, {r6('SUM(tamano * precio)')} AS valor_total,
       COUNT(DISTINCT tipo) AS categorias
FROM catalogo GROUP BY ROLLUP (tipo)
""")
def a38(t):
    return A.inventory_summary(t.catalogo, "tipo", "tamano", "precio")


@query("a39_accounts_with_total", sql=f"""
{with_roles('cargos')},
g AS (SELECT id_atencion, linea, CAST(GROUPING(id_atencion, linea) AS INTEGER) AS nivel, {money('subtotal')} AS subtotal
      FROM cargos GROUP BY ROLLUP (id_atencion, linea))
SELECT id_atencion, linea, nivel, subtotal,
       CAST(ROUND(subtotal * CAST(0.16 AS DECIMAL(4,2)), 2) AS DECIMAL(38,2)) AS iva,
       CAST(subtotal + CAST(ROUND(subtotal * CAST(0.16 AS DECIMAL(4,2)), 2) AS DECIMAL(38,2)) AS DECIMAL(38,2)) AS total
FROM g
""")
def a39(t):
    return A.accounts_with_total(t.cargos, "id_atencion", "linea")


@query("a11_first_values", sql=f"""
{with_roles('cargos', 'atencion')},
j AS (SELECT d.id_atencion, d.linea, d.id_catalogo, d.id_medico, d.subtotal, a.Id_exp, a.fecha_ing
      FROM cargos d JOIN atencion a USING (id_atencion))
SELECT id_atencion, Id_exp, fecha_ing, id_catalogo FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY id_atencion ORDER BY linea, id_catalogo, id_medico, subtotal) AS rn FROM j)
WHERE rn = 1
""")
def a11(t):
    j = t.cargos.select("id_atencion", "linea", "id_catalogo", "id_medico", "subtotal").join(
        t.atencion.select("id_atencion", "Id_exp", "fecha_ing"), "id_atencion")
    return A.first_values(j, "id_atencion", ["Id_exp", "fecha_ing", "id_catalogo"],
                          ["linea", "id_catalogo", "id_medico", "subtotal"])
