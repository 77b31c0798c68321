"""Driver bindings for projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as FL
from . import vitals
from .bind import AS_OF_ORDERS, with_roles
from .registry import query

CARGOS_COLS = ("id_atencion, linea, id_catalogo, id_medico, cantidad, subtotal, precio, descuento, impuesto, "
               "tipo, estado, linestatus, fecha")


@query("f1_clean_charges", sql=f"""
{with_roles('cargos')}
SELECT * FROM cargos
WHERE cantidad IS NOT NULL AND precio IS NOT NULL AND subtotal IS NOT NULL
  AND cantidad > 0 AND precio > 0 AND subtotal > 0
""")
def f1(t):
    return FL.clean_charges(t.cargos)


@query("f2_clean_selected", sql=f"""
{with_roles('cargos')}
SELECT id_atencion, cantidad, precio, subtotal, fecha FROM cargos
WHERE id_atencion IS NOT NULL AND cantidad IS NOT NULL AND precio IS NOT NULL AND subtotal IS NOT NULL
  AND fecha IS NOT NULL AND subtotal > 0
""")
def f2(t):
    return FL.clean_selected(t.cargos, ["id_atencion", "cantidad", "precio", "subtotal", "fecha"], ["subtotal"])


@query("f3_cleaning_report", sql=f"""
{with_roles('cargos')},
c AS (SELECT COUNT(*) AS iniciales, COUNT(*) FILTER (WHERE subtotal > 0 AND descuento > 0.0) AS validos FROM cargos)
SELECT iniciales, validos, iniciales - validos AS eliminados,
       COALESCE(ROUND((iniciales - validos) * 100.0 / NULLIF(iniciales, 0), 2), 0.0) AS tasa_eliminacion FROM c
""")
def f3(t):
    return FL.cleaning_report(t.cargos, (F.col("subtotal") > 0) & (F.col("descuento") > 0.0))


@query("f4_derive_finance", sql=f"""
{with_roles('cargos')}
SELECT *, CAST(month(fecha) AS INTEGER) AS mes, CAST(year(fecha) AS INTEGER) AS anio,
       CASE WHEN precio = 0 THEN NULL ELSE subtotal / precio END AS margen,
       CASE WHEN cantidad = 0 THEN NULL ELSE subtotal / cantidad END AS precio_unitario
FROM cargos
""")
def f4(t):
    return FL.derive_finance(t.cargos)


@query("f5_band", sql=f"""
{with_roles('cargos')}
SELECT id_atencion, linea, precio,
       CASE WHEN precio IS NULL THEN NULL WHEN precio < 1000.0 THEN 'Bajo' WHEN precio < 1500.0 THEN 'Medio'
            ELSE 'Alto' END AS banda
FROM cargos
""")
def f5(t):
    return t.cargos.select("id_atencion", "linea", "precio", FL.band("precio", (1000.0, 1500.0)).alias("banda"))


@query("f6_amount_distribution", sql=f"""
{with_roles('signos')}
SELECT '0-100' AS rango, COUNT(*) FILTER (WHERE valor >= 0 AND valor < 100) AS n FROM signos
UNION ALL SELECT '100-500', COUNT(*) FILTER (WHERE valor >= 100 AND valor < 500) FROM signos
UNION ALL SELECT '500-1000', COUNT(*) FILTER (WHERE valor >= 500 AND valor < 1000) FROM signos
UNION ALL SELECT '1000+', COUNT(*) FILTER (WHERE valor >= 1000) FROM signos
""")
def f6(t):
    return FL.amount_distribution(t.signos, "valor")


def _oor_sql() -> str:
    conds = []
    for name, (lo, hi) in vitals.RANGES.items():
        if lo is not None:
            conds.append(f"COALESCE({name} < {lo}, FALSE)")
        if hi is not None:
            conds.append(f"COALESCE({name} > {hi}, FALSE)")
    return " OR ".join(conds)


@query("f7_out_of_range", sql=f"""
{with_roles('signos')}, w AS ({vitals.wide_sql()})
SELECT * FROM w WHERE {_oor_sql()}
""")
def f7(t):
    return FL.out_of_range(vitals.wide(t.signos), vitals.RANGES)


@query("f8_status_is", sql=f"""
{with_roles('cargos')}
SELECT id_atencion, linea, estado FROM cargos WHERE upper(trim(estado)) = 'PENDIENTE'
""")
def f8(t):
    return t.cargos.filter(FL.status_is("estado", " pendiente ")).select("id_atencion", "linea", "estado")


@query("f9_search", sql=f"""
{with_roles('catalogo')}
SELECT * FROM catalogo
WHERE COALESCE(contains(lower(nombre), 'gear'), FALSE) OR COALESCE(contains(lower(tipo), 'gear'), FALSE)
   OR COALESCE(contains(lower(marca), 'gear'), FALSE)
ORDER BY id_catalogo LIMIT 5
""")
def f9(t):
    return FL.search(t.catalogo, ["nombre", "tipo", "marca"], "Gear", "id_catalogo", 5)


EXCLUDED_METHODS = ("4-NOT SPECIFIED", "5-LOW")


@query("f10_period_filter", sql=f"""
{with_roles('atencion')}
SELECT * FROM atencion
WHERE fecha_ing >= DATE '1998-01-01' AND fecha_ing < DATE '1998-12-31' + INTERVAL 1 DAY
  AND (especialidad IS NULL OR especialidad NOT IN ('4-NOT SPECIFIED', '5-LOW'))
""")
def f10(t):
    return FL.period_filter(t.atencion, "fecha_ing", "1998-01-01", "1998-12-31", "especialidad", EXCLUDED_METHODS)


@query("f11_in_or_blank", sql=f"""
{with_roles('pacientes')}
SELECT * FROM pacientes WHERE area IN ('BUILDING', 'MACHINERY') OR area IS NULL OR area = ''
""")
def f11(t):
    return t.pacientes.filter(FL.in_or_blank("area", ["BUILDING", "MACHINERY"]))


@query("f12_available_or", sql=f"""
{with_roles('camas')}
SELECT * FROM camas WHERE COALESCE(ocupada, 0) = 0 OR id_cama = 7
""")
def f12(t):
    return FL.available_or(t.camas, "ocupada", "id_cama", 7)


@query("f13_overdue", sql=f"""
{with_roles('cargos')}
SELECT *, CAST(date_diff('day', fecha, DATE '{AS_OF_ORDERS}') AS INTEGER) AS dias FROM cargos
WHERE upper(trim(estado)) = 'PENDIENTE' AND date_diff('day', fecha, DATE '{AS_OF_ORDERS}') > 7
""")
def f13(t):
    return FL.overdue(t.cargos, "estado", "fecha", AS_OF_ORDERS, 7)


def sales_per_part(t):
    """Units sold per catalogue item (null when never sold)."""
    sold = t.cargos.groupBy("id_catalogo").agg(F.sum("cantidad").alias("ventas"))
    return t.catalogo.select("id_catalogo", "tamano").join(sold, "id_catalogo", "left")


SALES_SQL = ("SELECT c.id_catalogo, c.tamano, s.ventas FROM catalogo c LEFT JOIN "
             "(SELECT id_catalogo, SUM(cantidad) AS ventas FROM cargos GROUP BY id_catalogo) s USING (id_catalogo)")


@query("f14_stock_risk", sql=f"""
{with_roles('catalogo', 'cargos')}, s AS ({SALES_SQL})
SELECT id_catalogo, tamano, ventas,
       CASE WHEN tamano < 10 AND ventas > 100 THEN 'Alto' WHEN tamano < 15 THEN 'Medio' ELSE 'Bajo' END AS riesgo
FROM s
""")
def f14(t):
    s = sales_per_part(t)
    return s.select("id_catalogo", "tamano", "ventas", FL.stock_risk("tamano", "ventas").alias("riesgo"))


@query("f15_impute_median", sql=f"""
{with_roles('catalogo', 'cargos')}, s AS ({SALES_SQL})
SELECT id_catalogo, tamano, COALESCE(CAST(ventas AS DOUBLE), (SELECT quantile_cont(ventas, 0.5) FROM s)) AS ventas FROM s
""")
def f15(t):
    return FL.impute_median(sales_per_part(t), ["ventas"], method="rank")


@query("f16_label_by", sql=f"""
{with_roles('cargos')}
SELECT id_atencion, linea, subtotal,
       CASE WHEN subtotal >= (SELECT quantile_cont(subtotal, 0.5) FROM cargos) THEN 1 ELSE 0 END AS etiqueta
FROM cargos
""")
def f16(t):
    return FL.label_by(t.cargos.select("id_atencion", "linea", "subtotal"), "subtotal", "median", method="rank")


@query("f16_label_fixed", sql=f"""
{with_roles('cargos')}
SELECT id_atencion, linea, subtotal, CASE WHEN subtotal > 50000 THEN 1 ELSE 0 END AS etiqueta FROM cargos
""")
def f16b(t):
    return FL.label_by(t.cargos.select("id_atencion", "linea", "subtotal"), "subtotal", 50000)


@query("f17_drop_prefixes", sql=f"""
{with_roles('signos')}
SELECT id_signo, signo, props FROM signos
WHERE NOT COALESCE(starts_with(signo, 'cl'), FALSE) AND NOT COALESCE(starts_with(signo, 'sign'), FALSE)
""")
def f17(t):
    return FL.drop_prefixes(t.signos.select("id_signo", "signo", "props"), "signo", ["cl", "sign"])


@query("f18_require", sql=f"""
{with_roles('diagnosticos')}
SELECT id_diagnostico, lang, fuente,
       COALESCE(trim(CAST(texto AS VARCHAR)) <> '', FALSE) AND COALESCE(trim(CAST(lang AS VARCHAR)) <> '', FALSE)
       AND COALESCE(trim(CAST(fuente AS VARCHAR)) <> '', FALSE) AS valido
FROM diagnosticos
""")
def f18(t):
    d = t.diagnosticos
    valid, rejected = FL.require(d, ["texto", "lang", "fuente"])
    cols = ["id_diagnostico", "lang", "fuente"]
    return valid.select(*cols, F.lit(True).alias("valido")).unionByName(
        rejected.select(*cols, F.lit(False).alias("valido")))
