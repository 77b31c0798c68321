"""Driver bindings for window-style operators (W1-W6) and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import split_clean
from ..operators import windows as W
from .bind import with_roles
from .registry import query
from ..operators._common import rsig as rsig_
from .sqlkit import r6, rsig


@query("w1_sigma_outliers", sql=f"""
{with_roles('cargos')},
s AS (SELECT id_catalogo, AVG(subtotal) AS media, STDDEV_SAMP(subtotal) AS desviacion FROM cargos GROUP BY id_catalogo)
SELECT d.*, FLOOR(media * 10000 + 0.314159) / 10000 AS media, {rsig(r6('desviacion'), 9)} AS desviacion FROM cargos d JOIN s USING (id_catalogo)
WHERE s.desviacion IS NOT NULL AND ABS(d.subtotal - s.media) > 1.5 * s.desviacion
""")
def w1(t):
    # means of cents over 32 rows land on exact half-units, which engines round differently: these are cut
    # to four decimals at a place that no mean hits
    out = W.sigma_outliers(t.cargos, "id_catalogo", "subtotal", k=1.5)
    return out.withColumns({"media": F.floor(F.col("media") * 10000 + 0.314159) / 10000, "desviacion": rsig_("desviacion", 9)})


@query("w2_cash_cut", sql=f"""
{with_roles('atencion')},
p AS (SELECT id_atencion, fecha_ing, especialidad, CAST(monto AS DECIMAL(18,2)) AS deposito FROM atencion
      WHERE fecha_ing >= DATE '1998-01-01' AND fecha_ing < DATE '1999-01-01'
        AND (especialidad IS NULL OR especialidad NOT IN ('4-NOT SPECIFIED', '5-LOW')))
SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY fecha_ing, id_atencion) AS BIGINT) AS n,
       CAST(SUM(deposito) OVER (ORDER BY fecha_ing, id_atencion ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS DECIMAL(38,2)) AS acumulado
FROM p
""")
def w2(t):
    pay = t.atencion.select("id_atencion", "fecha_ing", "especialidad",
                            F.col("monto").cast("decimal(18,2)").alias("deposito"))
    out = W.cash_cut(pay, "fecha_ing", "1998-01-01", "1999-01-01", "deposito", "id_atencion",
                     excluded=("4-NOT SPECIFIED", "5-LOW"), method="especialidad")
    return out.withColumn("acumulado", F.col("acumulado").cast("decimal(38,2)"))


@query("w3_page", sql=f"""
{with_roles('atencion')}
SELECT *, (SELECT COUNT(*) FROM atencion) AS total_filas, CAST(CEIL((SELECT COUNT(*) FROM atencion) / 20.0) AS BIGINT) AS paginas
FROM atencion ORDER BY fecha_ing DESC, id_atencion LIMIT 20 OFFSET 40
""")
def w3(t):
    return W.page(t.atencion, ["-fecha_ing"], "id_atencion", 3, 20)


@query("w3_last_page", sql=f"""
{with_roles('cargos')}, c AS (SELECT id_atencion * 8 + linea AS id_linea, id_medico, cantidad, subtotal, fecha FROM cargos),
l AS (SELECT *, row_number() OVER (ORDER BY subtotal, fecha DESC, id_linea, id_medico) AS r, COUNT(*) OVER () AS n FROM c)
SELECT id_linea, id_medico, cantidad, subtotal, fecha, n AS total_filas, CAST(CEIL(n / 50.0) AS BIGINT) AS paginas
FROM l WHERE r > (CAST(CEIL(n / 50.0) AS BIGINT) - 1) * 50
""")
def w3_last(t):
    """The last page of the charges, cheapest first."""
    c = t.cargos.select((F.col("id_atencion") * 8 + F.col("linea")).cast("long").alias("id_linea"), "id_medico", "cantidad", "subtotal", "fecha")
    return W.page(c, ["subtotal", "-fecha", "id_linea"], "id_medico", -(-c.count() // 50), 50)


@query("w4_latest_per_user", sql=f"""
{with_roles('signos')}
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id_usuario ORDER BY fecha DESC, id_signo DESC) AS rn FROM signos)
WHERE rn <= 3
""")
def w4(t):
    return W.latest(t.signos, "fecha", "id_signo", 3, group="id_usuario").withColumn("rn", F.col("rn").cast("long"))


@query("w4_latest_global", sql=f"""
{with_roles('signos')}
SELECT * FROM signos ORDER BY fecha DESC, id_signo DESC LIMIT 10
""")
def w4b(t):
    return W.latest(t.signos, "fecha", "id_signo", 10)


@query("w6_minmax", sql=f"""
{with_roles('catalogo')},
s AS (SELECT CAST(MIN(precio) AS DOUBLE) AS pmin, CAST(MAX(precio) AS DOUBLE) AS pmax,
             CAST(MIN(tamano) AS DOUBLE) AS tmin, CAST(MAX(tamano) AS DOUBLE) AS tmax FROM catalogo)
SELECT c.*, {r6('CASE WHEN pmax > pmin THEN (precio - pmin) / (pmax - pmin) ELSE 0.0 END')} AS precio_esc,
       {r6('CASE WHEN tmax > tmin THEN (tamano - tmin) / (tmax - tmin) ELSE 0.0 END')} AS tamano_esc
FROM catalogo c, s
""")
def w6(t):
    return W.minmax(t.catalogo, ["precio", "tamano"])


@query("u1_missing_ids", sql=f"""
{with_roles('atencion', 'cargos')}
SELECT DISTINCT id_atencion FROM atencion WHERE id_atencion IS NOT NULL
EXCEPT SELECT id_atencion FROM cargos
""")
def u1(t):
    return W.missing_ids(t.atencion, t.cargos, "id_atencion")


@query("u2_distinct_ids", sql=f"""
{with_roles('atencion')}
SELECT DISTINCT Id_exp FROM atencion WHERE Id_exp IS NOT NULL
""")
def u2(t):
    return W.distinct_ids(t.atencion, "Id_exp")


@query("u3_stack_sections", sql=f"""
{with_roles('atencion', 'camas')}
SELECT id_atencion, NULL::BIGINT AS id_cama, status, 'ABIERTAS' AS seccion FROM atencion WHERE status = 'ABIERTA'
UNION ALL SELECT NULL::BIGINT, id_cama, NULL, 'CAMAS' FROM camas
""")
def u3(t):
    return W.stack_sections({
        "ABIERTAS": t.atencion.filter("status = 'ABIERTA'").select("id_atencion", "status"),
        "CAMAS": t.camas.select("id_cama"),
    }).select("id_atencion", "id_cama", "status", "seccion")


@query("u4_dedupe_list", sql=f"""
{with_roles('cargos')},
f AS (SELECT id_atencion, tipo, MIN(linea) AS primera FROM cargos GROUP BY id_atencion, tipo)
SELECT id_atencion, string_agg(tipo, '|' ORDER BY primera, tipo) AS tipos FROM f GROUP BY id_atencion
""")
def u4(t):
    # the stored form is a comma-joined text list (with blanks around items)
    lists = t.cargos.groupBy("id_atencion").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("linea", "tipo"))),
                                 lambda x: F.concat(F.lit(" "), x["tipo"], F.lit(" "))), ",,").alias("lista"))
    return lists.select("id_atencion", F.array_join(split_clean("lista", ","), "|").alias("tipos"))


@query("w5_retain_latest_per_user", sql=f"""
{with_roles('signos')}
SELECT id_signo, fecha, id_usuario, signo, valor, props FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY id_usuario ORDER BY fecha DESC, id_signo DESC) AS rn FROM signos) WHERE rn <= 4
""")
def w5(t):
    from ..sources.sinks import retain_latest
    return retain_latest(t.signos, "id_usuario", "fecha", "id_signo", 4)
