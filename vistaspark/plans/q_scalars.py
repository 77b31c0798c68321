"""Driver bindings for the scalar functions.

Text to parse (money, blood pressure, dates) is built in the query from typed columns and
parsed back, in both engines, so both read the same strings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as AR
from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as TX
from ..operators._common import money_sum
from ..operators.aggregates import nest_details
from .bind import AS_OF_ORDERS, with_roles
from .q_aggregates import BIRTH_SQL, PROFILE_DEFAULT, PROFILE_RULES, age_sql, birth_dates, profile_case_sql
from .q_joins import PATIENT_FACTS_SQL, patient_facts
from .registry import query
from .sqlkit import fold as sql_fold
from .sqlkit import money, pct


@query("t1_fold", sql=f"""
{with_roles('diagnosticos')}
SELECT id_diagnostico, {sql_fold('texto')} AS texto_norm FROM diagnosticos
""")
def t1(t):
    return t.diagnosticos.select("id_diagnostico", TX.fold("texto").alias("texto_norm"))


@query("t2_classify", sql=f"""
{with_roles('catalogo')}
SELECT id_catalogo, nombre, {profile_case_sql(sql_fold('nombre'))} AS perfil FROM catalogo
""")
def t2(t):
    return t.catalogo.select("id_catalogo", "nombre", TX.classify("nombre", PROFILE_RULES, PROFILE_DEFAULT).alias("perfil"))


@query("t3_parse_money", sql=f"""
{with_roles('cargos')},
x AS (SELECT id_atencion, linea,
             CASE WHEN linea = 1 THEN 'abc' WHEN linea = 2 THEN NULL WHEN linea = 3 THEN 'NaN'
                  ELSE '$' || format('{{:,.2f}}', subtotal) END AS txt FROM cargos),
v AS (SELECT *, TRY_CAST(regexp_replace(txt, '[$,]', '', 'g') AS DOUBLE) AS v FROM x)
SELECT id_atencion, linea, COALESCE(CASE WHEN isnan(v) THEN NULL ELSE v END, 0.0) AS valor FROM v
""")
def t3(t):
    txt = (F.when(F.col("linea") == 1, F.lit("abc")).when(F.col("linea") == 2, F.lit(None))
           .when(F.col("linea") == 3, F.lit("NaN"))
           .otherwise(F.concat(F.lit("$"), F.format_number("subtotal", 2))))
    return t.cargos.select("id_atencion", "linea", N.parse_money(txt, 0.0).alias("valor"))


@query("t4_parse_bp", sql=f"""
{with_roles('signos')},
x AS (SELECT id_signo, 'TA ' || CAST(CAST(FLOOR(valor) AS BIGINT) AS VARCHAR) || ' / ' ||
             CAST(CAST(FLOOR(valor / 2) AS BIGINT) AS VARCHAR) AS txt FROM signos)
SELECT id_signo,
       CAST(NULLIF(regexp_extract(txt, '(\\d{{2,3}})\\s*/\\s*(\\d{{2,3}})', 1), '') AS INTEGER) AS sistolica,
       CAST(NULLIF(regexp_extract(txt, '(\\d{{2,3}})\\s*/\\s*(\\d{{2,3}})', 2), '') AS INTEGER) AS diastolica
FROM x
""")
def t4(t):
    txt = F.concat(F.lit("TA "), F.floor("valor").cast("string"), F.lit(" / "),
                   F.floor(F.col("valor") / 2).cast("string"))
    bp = TX.parse_bp(txt)
    return t.signos.select("id_signo", bp["sistolica"].alias("sistolica"), bp["diastolica"].alias("diastolica"))


# binding: the text layout of each attention's date depends on its specialty
_TS_LAYOUT = (("1-URGENT", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
              ("2-HIGH", "dd/MM/yyyy", "%d/%m/%Y"),
              ("3-MEDIUM", "yyyyMMdd", "%Y%m%d"),
              ("4-NOT SPECIFIED", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"))
_DUCK_FORMATS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y%m%d",
                 "%d-%m-%Y", "%Y/%m/%d")


def _ts_text_spark():
    out = None
    for spec, jfmt, _ in _TS_LAYOUT:
        cond = F.col("especialidad") == spec
        val = F.date_format(F.col("fecha_ing").cast("timestamp_ntz"), jfmt)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(F.lit("sin fecha"))


def _ts_text_sql() -> str:
    whens = " ".join(f"WHEN especialidad = '{s}' THEN strftime(CAST(fecha_ing AS TIMESTAMP), '{p}')"
                     for s, _, p in _TS_LAYOUT)
    return f"CASE {whens} ELSE 'sin fecha' END"


def parse_ts_sql(x: str) -> str:
    return "COALESCE(" + ", ".join(f"try_strptime({x}, '{f}')" for f in _DUCK_FORMATS) + ")"


@query("t5_parse_ts", sql=f"""
{with_roles('atencion')}, x AS (SELECT id_atencion, {_ts_text_sql()} AS txt FROM atencion)
SELECT id_atencion, txt, {parse_ts_sql('txt')} AS fecha FROM x
""")
def t5(t):
    x = t.atencion.select("id_atencion", _ts_text_spark().alias("txt"))
    return x.select("id_atencion", "txt", D.parse_ts("txt").alias("fecha"))


def _months_rule_sql(b: str, a: str) -> str:
    frac = (f"CASE WHEN day({a}) = day({b}) OR ({a} = last_day({a}) AND {b} = last_day({b})) THEN 0 "
            f"ELSE (day({a}) - day({b})) / 31.0 END")
    return f"CAST(FLOOR(((year({a}) - year({b})) * 12 + month({a}) - month({b}) + {frac}) / 12) AS INTEGER)"


@query("t6_age", sql=f"""
{with_roles('atencion')}, b AS ({BIRTH_SQL})
SELECT Id_exp, fecnac, {age_sql('fecnac', "DATE '2001-12-01'")} AS edad,
       {_months_rule_sql('fecnac', "DATE '2001-12-01'")} AS edad_meses
FROM b
""")
def t6(t):
    b = birth_dates(t)
    return b.select("Id_exp", "fecnac", D.age_calendar("fecnac", AS_OF_ORDERS).alias("edad"),
                    D.age_months_rule("fecnac", AS_OF_ORDERS).alias("edad_meses"))


@query("t7_days_between", sql=f"""
{with_roles('cargos', 'atencion')}
SELECT d.id_atencion, d.linea,
       CAST(CASE WHEN date_diff('day', a.fecha_ing, d.fecha) >= 0 THEN date_diff('day', a.fecha_ing, d.fecha) END AS INTEGER) AS dias
FROM cargos d JOIN atencion a USING (id_atencion)
""")
def t7(t):
    j = t.cargos.select("id_atencion", "linea", "fecha").join(t.atencion.select("id_atencion", "fecha_ing"), "id_atencion")
    return j.select("id_atencion", "linea", D.days_between("fecha_ing", "fecha").alias("dias"))


@query("t8_split_clean", sql=f"""
{with_roles('diagnosticos')},
p AS (SELECT id_diagnostico, list_filter(list_transform(string_split(texto, '.'), lambda x: trim(x)), lambda x: x <> '') AS l FROM diagnosticos),
u AS (SELECT id_diagnostico, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM p)
SELECT id_diagnostico, CAST(len(l) AS INTEGER) AS n_frases, md5(array_to_string(l, chr(31))) AS frases_md5 FROM u
""")
def t8(t):
    parts = t.diagnosticos.select("id_diagnostico", AR.split_clean("texto", r"\.").alias("l"))
    return parts.select("id_diagnostico", F.size("l").alias("n_frases"), F.md5(F.array_join("l", "\x1f")).alias("frases_md5"))


@query("t9_first_non_blank", sql=f"""
{with_roles('cargos')},
x AS (SELECT id_atencion, linea, CASE WHEN tipo = 'A' THEN '' ELSE estado END AS nota FROM cargos)
SELECT i.id_atencion, f.nota AS primera_nota FROM (SELECT DISTINCT id_atencion FROM x) i LEFT JOIN (
  SELECT id_atencion, nota FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id_atencion ORDER BY linea, nota) AS rn
  FROM x WHERE nota IS NOT NULL AND trim(nota) <> '') WHERE rn = 1) f USING (id_atencion)
""")
def t9(t):
    x = t.cargos.select("id_atencion", "linea",
                        F.when(F.col("tipo") == "A", F.lit("")).otherwise(F.col("estado")).alias("nota"))
    n = nest_details(x, "id_atencion", ["linea"], ["nota"])
    return n.select("id_atencion", AR.first_non_blank("detalles", "nota").alias("primera_nota"))


@query("t10_full_name", sql=f"""
{with_roles('pacientes')}
SELECT Id_exp, trim(concat_ws(' ', area, nombre, CASE WHEN saldo < 0 THEN 'DEUDOR' END)) AS nombre_completo
FROM pacientes
""")
def t10(t):
    return t.pacientes.select("Id_exp", TX.full_name("area", "nombre", F.when(F.col("saldo") < 0, "DEUDOR"))
                              .alias("nombre_completo"))


@query("t11_clip_label", sql=f"""
{with_roles('catalogo')},
x AS (SELECT id_catalogo, regexp_replace(COALESCE(NULLIF(concat_ws(' ', nombre, marca, tipo), ''), 'Sin dato'),
                                         '^\\s+|\\s+$', '', 'g') AS s FROM catalogo)
SELECT id_catalogo, CASE WHEN length(s) > 20 THEN substr(s, 1, 17) || '...' ELSE s END AS etiqueta FROM x
""")
def t11(t):
    return t.catalogo.select("id_catalogo",
                             TX.clip_label(F.concat_ws(" ", "nombre", "marca", "tipo"), 20).alias("etiqueta"))


@query("t12_month_label", sql=f"""
{with_roles('atencion')}
SELECT ['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'][month(fecha_ing)] || ' ' ||
       substr(CAST(year(fecha_ing) AS VARCHAR), 3, 2) AS mes, COUNT(*) AS n
FROM atencion GROUP BY 1
""")
def t12(t):
    return t.atencion.groupBy(D.month_label("fecha_ing").alias("mes")).agg(F.count(F.lit(1)).alias("n"))


@query("t13_date_display", sql=f"""
{with_roles('atencion')},
x AS (SELECT id_atencion, CASE WHEN status = 'ABIERTA' THEN strftime(fecha_ing, '%Y-%m-%d') ELSE 'n/a' END AS txt
      FROM atencion)
SELECT id_atencion, COALESCE(strftime({parse_ts_sql('txt')}, '%d/%m/%Y'), 'Sin fecha') AS fecha_texto FROM x
""")
def t13(t):
    txt = F.when(F.col("status") == "ABIERTA", F.date_format("fecha_ing", "yyyy-MM-dd")).otherwise(F.lit("n/a"))
    return t.atencion.select("id_atencion", D.date_display(txt).alias("fecha_texto"))


@query("t14_pct", sql=f"""
{with_roles('cargos')},
g AS (SELECT estado, COUNT(*) AS n FROM cargos GROUP BY estado)
SELECT estado, n, {pct('n', '(SELECT COUNT(*) FROM cargos)')} AS porcentaje FROM g
""")
def t14(t):
    total = t.cargos.select(F.count(F.lit(1))).scalar()
    return t.cargos.groupBy("estado").agg(F.count(F.lit(1)).alias("n")).withColumn("porcentaje", N.pct("n", total))


@query("t15_iva", sql=f"""
{with_roles('cargos')},
g AS (SELECT id_atencion, {money('subtotal')} AS subtotal FROM cargos GROUP BY id_atencion)
SELECT id_atencion, subtotal, CAST(ROUND(subtotal * CAST(0.16 AS DECIMAL(4,2)), 2) AS DECIMAL(38,2)) AS iva,
       CAST(subtotal + CAST(ROUND(subtotal * CAST(0.16 AS DECIMAL(4,2)), 2) AS DECIMAL(38,2)) AS DECIMAL(38,2)) AS total
FROM g
""")
def t15(t):
    g = t.cargos.groupBy("id_atencion").agg(money_sum("subtotal").alias("subtotal"))
    iva, total = N.with_iva("subtotal")
    return g.select("id_atencion", "subtotal", iva.alias("iva"), total.alias("total"))


@query("t16_factor_list", sql=f"""
{with_roles('pacientes', 'atencion', 'cargos')}, {PATIENT_FACTS_SQL}
SELECT p.Id_exp, concat_ws(', ', CASE WHEN COALESCE(v.visitas, 0) > 12 THEN 'visitas frecuentes' END,
                                 CASE WHEN p.saldo < 0 THEN 'saldo negativo' END,
                                 CASE WHEN COALESCE(m.monto, 0) > 2000000 THEN 'monto alto' END) AS factores
FROM pacientes p LEFT JOIN v USING (Id_exp) LEFT JOIN m USING (Id_exp)
""")
def t16(t):
    visits, amount = patient_facts(t)
    p = t.pacientes.select("Id_exp", "saldo").join(visits, "Id_exp", "left").join(amount, "Id_exp", "left")
    return p.select("Id_exp", TX.factor_list([
        ("visitas frecuentes", F.coalesce("visitas", F.lit(0)) > 12),
        ("saldo negativo", F.col("saldo") < 0),
        ("monto alto", F.coalesce("monto", F.lit(0)) > 2000000),
    ]).alias("factores"))


@query("t17_zip_items", sql=f"""
{with_roles('cargos', 'catalogo')},
l AS (SELECT d.id_atencion,
             list(CASE WHEN d.tipo = 'R' THEN '' ELSE c.nombre END
                  ORDER BY d.linea, CASE WHEN d.tipo = 'R' THEN '' ELSE c.nombre END) AS nombres,
             list(CAST(d.cantidad AS VARCHAR) ORDER BY d.linea, CAST(d.cantidad AS VARCHAR))
                  FILTER (WHERE d.tipo <> 'N') AS cantidades
      FROM cargos d JOIN catalogo c USING (id_catalogo) GROUP BY d.id_atencion),
e AS (SELECT id_atencion, nombres, cantidades,
             unnest(range(1, GREATEST(len(nombres), COALESCE(len(cantidades), 0)) + 1)) AS i FROM l)
SELECT id_atencion, COALESCE(nombres[i], '') AS item, COALESCE(cantidades[i], '') AS cantidad FROM e
WHERE trim(COALESCE(nombres[i], '')) <> ''
""")
def t17(t):
    j = t.cargos.select("id_atencion", "linea", "tipo", "cantidad", "id_catalogo").join(
        t.catalogo.select("id_catalogo", "nombre"), "id_catalogo")
    lists = j.groupBy("id_atencion").agg(
        F.array_sort(F.collect_list(F.struct("linea", F.when(F.col("tipo") == "R", F.lit("")).otherwise(F.col("nombre"))
                                             .alias("v")))).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("tipo") != "N", F.struct("linea", F.col("cantidad").cast("string")
                                                                         .alias("v"))))).alias("q"),
    )
    names = F.transform("n", lambda x: x["v"])
    qtys = F.transform("q", lambda x: x["v"])
    items = lists.select("id_atencion", F.explode(AR.zip_items({"item": names, "cantidad": qtys})).alias("z"))
    return items.select("id_atencion", "z.item", "z.cantidad")


@query("t6a_age_calendar", sql=f"""
{with_roles('atencion')}, b AS ({BIRTH_SQL})
SELECT Id_exp, {age_sql('fecnac', "DATE '2001-12-01'")} AS edad FROM b
""")
def t6a(t):
    return birth_dates(t).select("Id_exp", D.age_calendar("fecnac", AS_OF_ORDERS).alias("edad"))


@query("t6b_age_months", sql=f"""
{with_roles('atencion')}, b AS ({BIRTH_SQL})
SELECT Id_exp, {_months_rule_sql('fecnac', "DATE '2001-12-01'")} AS edad_meses FROM b
""")
def t6b(t):
    return birth_dates(t).select("Id_exp", D.age_months_rule("fecnac", AS_OF_ORDERS).alias("edad_meses"))
