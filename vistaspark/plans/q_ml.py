"""Driver bindings for the machine-learning operators.

Closed-form and metric operators (M1's linear model, M3, M4, M7-M9, M12-M17, M20, M21, M23, M26) have
exact DuckDB twins. Iterative fits (forests, boosting, k-means, logistic regression)
cannot be matched by another engine; they are seeded and checked by row count here and by
metric bounds in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..ml import metrics as MM
from ..ml import models as MD
from ..ml import neighbours as NB
from ..ml import study as ST
from ..ml.gram import standardised
from ..operators import rules as R
from ..operators._common import r6 as r6_
from ..operators._common import rsig as rsig_
from ..sources.sinks import scratch_path
from .bind import with_roles
from .q_rules import FEATURES_SQL, finance_metrics, patient_features_basic
from .registry import query
from .sqlkit import money, r6, rsig

FEATURE_COLS = ["edad", "visitas", "estudios", "monto", "diagnosticos"]


def features(t):
    """M20 binding: patient feature table; ages >= 0 (birth = first attention)."""
    return patient_features_basic(t).filter(F.col("edad").isNotNull() & (F.col("edad") >= 0))


FEAT_ROLES = with_roles("pacientes", "atencion", "cargos", "diagnosticos")


@query("m20_patient_features", sql=f"""
{FEAT_ROLES}, {FEATURES_SQL}
SELECT * FROM feat WHERE edad IS NOT NULL AND edad >= 0
""")
def m20(t):
    return features(t)


@query("m1_fit_regressors")
def m1(t):
    metrics, _ = MD.fit_regressors(t.cargos, ["cantidad", "precio"], "subtotal", "id_atencion", trees=50, depth=5,
                                   iters=50)
    return metrics


@query("m2_fit_visit_models")
def m2(t):
    closed = t.atencion.groupBy("Id_exp").agg(F.count_if(F.col("status") == "CERRADA").alias("cerradas"))
    df = features(t).join(closed, "Id_exp", "left").fillna({"cerradas": 0})
    metrics, _ = MD.fit_regressors(df, ["edad", "cerradas"], "visitas", "Id_exp", trees=50, depth=5, iters=50)
    return metrics


def _line_pred(t):
    """Predictions of the least-squares line subtotal ~ cantidad (closed form, both engines)."""
    c = t.cargos
    b0 = c.select(F.regr_intercept("subtotal", "cantidad")).scalar()
    b1 = c.select(F.regr_slope("subtotal", "cantidad")).scalar()
    return c.select(F.col("subtotal").alias("label"), (b0 + b1 * F.col("cantidad")).alias("prediction"))


PRED_SQL = """
pr AS (SELECT subtotal AS label, (SELECT regr_intercept(subtotal, cantidad) FROM cargos)
                 + (SELECT regr_slope(subtotal, cantidad) FROM cargos) * cantidad AS prediction FROM cargos)"""
REG_METRICS_SQL = f"""
SELECT {r6("1 - SUM((label - prediction) * (label - prediction)) / NULLIF(VAR_POP(label) * COUNT(label), 0)")} AS r2,
       {rsig('AVG(ABS(label - prediction))')} AS mae, {rsig('AVG((label - prediction) * (label - prediction))')} AS mse,
       {rsig('SQRT(AVG((label - prediction) * (label - prediction)))')} AS rmse, COUNT(*) AS n
FROM pr"""


@query("m3_regression_metrics", sql=f"""
{with_roles('cargos')}, {PRED_SQL}
{REG_METRICS_SQL}
""")
def m3(t):
    return MM.regression_metrics(_line_pred(t))


@query("m4_in_sample_metrics", sql=f"""
{with_roles('cargos')},
pr AS (SELECT subtotal AS label, (SELECT regr_intercept(subtotal, precio) FROM cargos)
              + (SELECT regr_slope(subtotal, precio) FROM cargos) * precio AS prediction FROM cargos)
{REG_METRICS_SQL}
""")
def m4(t):
    c = t.cargos
    b0 = c.select(F.regr_intercept("subtotal", "precio")).scalar()
    b1 = c.select(F.regr_slope("subtotal", "precio")).scalar()
    return MM.regression_metrics(c.select(F.col("subtotal").alias("label"), (b0 + b1 * F.col("precio")).alias("prediction")))


# the linear model in standardised form: two features, ridge penalty 0.1 / deviation of the label
@query("m1_linear", sql=f"""
{with_roles('cargos')},
d AS (SELECT cantidad AS x1, precio AS x2, subtotal AS y, CAST((id_atencion * 2654435761 + 42) % 1000003 AS DOUBLE) / 1000003.0 AS u
      FROM cargos WHERE cantidad IS NOT NULL AND precio IS NOT NULL AND subtotal IS NOT NULL),
m AS (SELECT AVG(x1) AS m1, AVG(x2) AS m2, AVG(y) AS my, STDDEV_POP(x1) AS s1, STDDEV_POP(x2) AS s2, STDDEV_POP(y) AS sy,
             CORR(x1, x2) AS r12, CORR(x1, y) AS r1, CORR(x2, y) AS r2, 1 + 0.1 / STDDEV_POP(y) AS a FROM d WHERE u < 0.8),
b AS (SELECT *, (a * r1 - r12 * r2) / (a * a - r12 * r12) * sy / s1 AS b1, (a * r2 - r12 * r1) / (a * a - r12 * r12) * sy / s2 AS b2 FROM m),
pr AS (SELECT y AS label, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS prediction FROM d, b WHERE u >= 0.8)
{REG_METRICS_SQL}
""")
def m1_linear(t):
    """Test metrics of M1's linear model, split so that another engine can follow it."""
    return MD.fit_linear(t.cargos, ["cantidad", "precio"], "subtotal", "id_atencion", method="knuth")[0]


@query("m5_importances")
def m5(t):
    _, models = MD.fit_regressors(t.cargos, ["cantidad", "precio"], "subtotal", "id_atencion")
    return MD.importances(models["random_forest"], ["cantidad", "precio"], t.spark)


@query("m6_fit_logistic")
def m6(t):
    pred = MD.fit_logistic(t.cargos, ["cantidad", "precio"], "subtotal", "id_atencion")
    return MM.classification_metrics(pred)


def _doc_pred(t):
    """Binding: known labels (quality) vs a rule prediction (long documents are 'good')."""
    return t.labels.join(t.raw("documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").alias("label"), F.when(F.col("n_chars") >= 2000, 1).otherwise(0).alias("prediction"))


DOC_PRED_SQL = """
pr AS (SELECT l.quality AS label, CASE WHEN d.n_chars >= 2000 THEN 1 ELSE 0 END AS prediction
       FROM labels l JOIN documents d USING (doc_id))"""


@query("m7_confusion", sql=f"""
WITH {DOC_PRED_SQL}
SELECT COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, COUNT(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
       COUNT(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn, COUNT(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn
FROM pr
""")
def m7(t):
    return MM.confusion(_doc_pred(t))


@query("m8_classification_metrics", sql=f"""
WITH {DOC_PRED_SQL},
n AS (SELECT COUNT(*) AS n FROM pr),
per AS (SELECT label AS c, COUNT(*) AS support, COUNT(*) FILTER (WHERE prediction = label) AS tp FROM pr GROUP BY 1),
pp AS (SELECT prediction AS c, COUNT(*) AS npred FROM pr GROUP BY 1),
j AS (SELECT per.*, COALESCE(pp.npred, 0) AS npred FROM per LEFT JOIN pp USING (c)),
m AS (SELECT *, COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(npred AS DOUBLE), 0), 0.0) AS prec,
             CAST(tp AS DOUBLE) / NULLIF(CAST(support AS DOUBLE), 0) AS rec FROM j),
m2 AS (SELECT *, COALESCE(2 * prec * rec / NULLIF(prec + rec, 0), 0.0) AS f1, support / (SELECT n FROM n) AS w FROM m),
cm AS (SELECT COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, COUNT(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
              COUNT(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn, COUNT(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn FROM pr),
b AS (SELECT COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0.0) AS bp,
             COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0.0) AS br,
             COALESCE(CAST(tn AS DOUBLE) / NULLIF(CAST(tn + fp AS DOUBLE), 0), 0.0) AS bs FROM cm)
SELECT {r6('SUM(tp) / SUM(support)')} AS accuracy, {r6('SUM(support * prec) / SUM(support)')} AS weighted_precision,
       {r6('SUM(support * rec) / SUM(support)')} AS weighted_recall, {r6('SUM(support * f1) / SUM(support)')} AS weighted_f1,
       {r6('ANY_VALUE(b.br)')} AS recall, {r6('ANY_VALUE(b.bs)')} AS specificity, {r6('ANY_VALUE(b.bp)')} AS precision,
       {r6('COALESCE(2 * ANY_VALUE(b.bp) * ANY_VALUE(b.br) / NULLIF(ANY_VALUE(b.bp) + ANY_VALUE(b.br), 0), 0.0)')} AS f1
FROM m2, b
""")
def m8(t):
    return MM.classification_metrics(_doc_pred(t))


def _coefficients(df):
    """Solved in another order by another engine: nine digits agree."""
    return df.withColumn("coeficiente", rsig_("coeficiente", 9))


# two features: both normal equations in closed form; lasso's coefficients have the signs of the ordinary ones
# where the penalty is small beside the covariances, as it is here
@query("m9_fit_penalised", sql=f"""
{with_roles('cargos')},
d AS (SELECT cantidad AS x1, precio AS x2, subtotal AS y FROM cargos WHERE cantidad IS NOT NULL AND precio IS NOT NULL AND subtotal IS NOT NULL),
m AS (SELECT COUNT(*) AS n, AVG(x1) AS m1, AVG(x2) AS m2, AVG(y) AS my, VAR_POP(x1) AS v1, VAR_POP(x2) AS v2, COVAR_POP(x1, x2) AS c12,
             COVAR_POP(x1, y) AS c1, COVAR_POP(x2, y) AS c2 FROM d),
o AS (SELECT *, SIGN(v2 * c1 - c12 * c2) AS g1, SIGN(v1 * c2 - c12 * c1) AS g2 FROM m),
e AS (SELECT 'ordinario' AS modelo, m1, m2, my, v1, v2, c12, c1, c2 FROM o
      UNION ALL SELECT 'ridge', m1, m2, my, v1 + 1.0 / n, v2 + 1.0 / n, c12, c1, c2 FROM o
      UNION ALL SELECT 'lasso', m1, m2, my, v1, v2, c12, c1 - 0.1 * g1, c2 - 0.1 * g2 FROM o),
b AS (SELECT *, (v2 * c1 - c12 * c2) / (v1 * v2 - c12 * c12) AS b1, (v1 * c2 - c12 * c1) / (v1 * v2 - c12 * c12) AS b2 FROM e),
r AS (SELECT modelo, 'intercepto' AS variable, my - b1 * m1 - b2 * m2 AS coeficiente FROM b
      UNION ALL SELECT modelo, 'cantidad', b1 FROM b UNION ALL SELECT modelo, 'precio', b2 FROM b)
SELECT modelo, variable, {rsig('coeficiente', 9)} AS coeficiente FROM r
""")
def m9(t):
    return _coefficients(MD.fit_penalised(t.cargos, ["cantidad", "precio"], "subtotal"))


def _doc_features(t):
    d = t.raw("documents").select("doc_id", "n_chars", F.length("text").alias("largo"),
                                  (F.col("lang") == "en").cast("int").alias("es_en"))
    return t.labels.join(d, "doc_id")


@query("m10_fit_tree")
def m10(t):
    pred, rules_text = MD.fit_tree(_doc_features(t), ["n_chars", "es_en"], "quality", depth=3)
    return MM.confusion(pred).withColumn("reglas", F.lit(rules_text))


@query("m11_fit_forest")
def m11(t):
    pred = MD.fit_forest(_doc_features(t), ["n_chars", "es_en", "largo"], "quality", trees=100)
    return MM.classification_metrics(pred)


KNN_SPLIT = "((vec_id * 2654435761 + 42) % 1000003) / 1000003.0"


def _emb_split(t):
    e = t.embeddings.withColumn("_u", MD.split_bucket("vec_id", 42, "knuth"))
    return e.filter(F.col("_u") < 0.8).drop("_u"), e.filter(F.col("_u") >= 0.8).drop("_u")


@query("m12_knn_classify", sql=f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, {KNN_SPLIT} AS u FROM embeddings),
tr AS (SELECT * FROM e WHERE u < 0.8), te AS (SELECT * FROM e WHERE u >= 0.8),
d AS (SELECT te.vec_id AS qid, tr.vec_id AS rid, tr.label AS rl,
             list_sum(list_transform(list_zip(te.v, tr.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
      FROM te, tr),
r AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY d2, rid) AS rn FROM d) WHERE rn <= 3),
v AS (SELECT qid, rl, COUNT(*) AS votos FROM r GROUP BY qid, rl),
w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY votos DESC, rl) AS rn FROM v)
SELECT qid AS vec_id, CAST(rl AS BIGINT) AS prediccion FROM w WHERE rn = 1
""")
def m12(t):
    train, test = _emb_split(t)
    return NB.classify(train, test, "vec_id", "embedding", "label", k=3)


@query("m13_simple_fit", sql=f"""
{with_roles('cargos')}
SELECT {r6('regr_intercept(subtotal, cantidad)')} AS b0, {r6('regr_slope(subtotal, cantidad)')} AS b1,
       {r6('regr_r2(subtotal, cantidad)')} AS r2, CAST(regr_count(subtotal, cantidad) AS BIGINT) AS n
FROM cargos
""")
def m13(t):
    return MM.simple_fit(t.cargos, "cantidad", "subtotal")


@query("m14_fit_vs_naive", sql=f"""
{FEAT_ROLES}, {FEATURES_SQL},
f AS (SELECT * FROM feat WHERE edad IS NOT NULL AND edad >= 0),
a AS (SELECT regr_slope(monto, edad) AS b1, regr_intercept(monto, edad) AS b0, regr_r2(monto, edad) AS r2,
             var_pop(monto) AS v, CAST(regr_count(monto, edad) AS BIGINT) AS n FROM f)
SELECT {rsig('b0')} AS b0, {rsig('b1')} AS b1, {r6('r2')} AS r2, {rsig('v')} AS mse_naive,
       {rsig('(1 - r2) * v')} AS mse_modelo,
       {r6('(v - (1 - r2) * v) / NULLIF(v, 0) * 100')} AS mejora_pct, n FROM a
""")
def m14(t):
    return MM.fit_vs_naive(features(t), "edad", "monto")


def _cramer(columns: dict[str, str]) -> str:
    """Determinant of a symmetric 3 x 3 matrix whose columns are given by their three entries."""
    (a, b, c), (d, e, f), (g, h, i) = columns.values()
    return f"({a} * ({e} * {i} - {f} * {h}) - {d} * ({b} * {i} - {c} * {h}) + {g} * ({b} * {f} - {c} * {e}))"


_X = {"1": ("v1", "c12", "c13"), "2": ("c12", "v2", "c23"), "3": ("c13", "c23", "v3")}
_BETA = [f"{_cramer(_X | {k: ('c1', 'c2', 'c3')})} / {_cramer(_X)}" for k in _X]


@query("m15_multi_fit", sql=f"""
{FEAT_ROLES}, {FEATURES_SQL},
datos AS (SELECT edad AS x1, visitas AS x2, estudios AS x3, CAST(monto AS DOUBLE) AS y FROM feat
      WHERE edad >= 0 AND visitas IS NOT NULL AND estudios IS NOT NULL AND monto IS NOT NULL),
momentos AS (SELECT AVG(x1) AS m1, AVG(x2) AS m2, AVG(x3) AS m3, AVG(y) AS my, VAR_POP(x1) AS v1, VAR_POP(x2) AS v2, VAR_POP(x3) AS v3, VAR_POP(y) AS vy,
             COVAR_POP(x1, x2) AS c12, COVAR_POP(x1, x3) AS c13, COVAR_POP(x2, x3) AS c23,
             COVAR_POP(x1, y) AS c1, COVAR_POP(x2, y) AS c2, COVAR_POP(x3, y) AS c3 FROM datos),
betas AS (SELECT *, {_BETA[0]} AS b1, {_BETA[1]} AS b2, {_BETA[2]} AS b3 FROM momentos),
filas AS (SELECT unnest(['intercepto', 'edad', 'visitas', 'estudios']) AS variable,
             unnest([my - b1 * m1 - b2 * m2 - b3 * m3, b1, b2, b3]) AS coeficiente, (b1 * c1 + b2 * c2 + b3 * c3) / vy AS r2 FROM betas)
SELECT variable, {rsig('coeficiente', 9)} AS coeficiente, {rsig('r2', 9)} AS r2 FROM filas
""")
def m15(t):
    return _coefficients(MD.multi_fit(features(t), ["edad", "visitas", "estudios"], "monto")).withColumn("r2", rsig_("r2", 9))


@query("m16_split", sql=f"""
WITH e AS (SELECT label, {KNN_SPLIT} AS u FROM embeddings)
SELECT CASE WHEN u < 0.75 THEN 'train' ELSE 'test' END AS conjunto, label, COUNT(*) AS n FROM e GROUP BY 1, 2
""")
def m16(t):
    train, test = MD.split(t.embeddings, "vec_id", 0.75, 42, "knuth", strata="label")
    return (train.withColumn("conjunto", F.lit("train")).unionByName(test.withColumn("conjunto", F.lit("test")))
            .groupBy("conjunto", "label").agg(F.count(F.lit(1)).alias("n")))


# strata of which one holds half the rows
STRATUM = "CASE WHEN label % 2 = 0 THEN -1 ELSE label END"


@query("m16_exact_strata", sql=f"""
WITH e AS (SELECT vec_id, {STRATUM} AS estrato FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY estrato ORDER BY (vec_id * 2654435761 + 42) % 1000003, vec_id) AS r,
             COUNT(*) OVER (PARTITION BY estrato) AS n FROM e)
SELECT CASE WHEN r <= round(0.75 * n) THEN 'train' ELSE 'test' END AS conjunto, vec_id, estrato FROM r
""")
def m16_exact(t):
    """Exactly three quarters of each stratum."""
    rows = t.embeddings.select("vec_id", F.expr(STRATUM).alias("estrato"))
    train, test = MD.split(rows, "vec_id", 0.75, 42, "knuth", strata="estrato", exact_strata=True)
    return train.withColumn("conjunto", F.lit("train")).unionByName(test.withColumn("conjunto", F.lit("test")))


@query("m17_standardise", sql=f"""
{FEAT_ROLES}, {FEATURES_SQL},
f AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURE_COLS)} FROM feat WHERE edad >= 0 AND {' AND '.join(f'{c} IS NOT NULL' for c in FEATURE_COLS)}),
z AS (SELECT {', '.join(f'COALESCE(({c} - AVG({c}) OVER ()) / NULLIF(STDDEV_SAMP({c}) OVER (), 0), 0) AS {c}' for c in FEATURE_COLS)} FROM f)
SELECT {', '.join(f'{r6(f"AVG({c})")} + 0 AS media_{c}' for c in FEATURE_COLS)},
       {', '.join(f'{r6(f"STDDEV_SAMP({c})")} AS std_{c}, {r6(f"MIN({c})")} AS min_{c}, {r6(f"MAX({c})")} AS max_{c}' for c in FEATURE_COLS)}
FROM z
""")
def m17(t):
    scaled = standardised(features(t), FEATURE_COLS)
    return scaled.agg(*[(r6_(F.avg(c)) + 0).alias(f"media_{c}") for c in FEATURE_COLS], *[
        r6_(f(c)).alias(f"{name}_{c}") for c in FEATURE_COLS for name, f in (("std", F.stddev), ("min", F.min), ("max", F.max))])


@query("m18_segment_charges")
def m18(t):
    cols = ["cantidad", "precio", "subtotal"]
    return MD.cluster_means(MD.kmeans_segments(t.cargos.select(*cols), cols, 3), cols)


@query("m19_segment_patients")
def m19(t):
    cols = ["edad", "visitas"]
    means = MD.cluster_means(MD.kmeans_segments(features(t), cols, 3), cols)
    return means.withColumn("segmento", R.segment_name(F.col("visitas_promedio"), F.col("edad_promedio")))


def _eigen_sql(d: int, k: int) -> str:
    """The k largest eigenvalues of the d x d matrix ``m`` of table ``c1``, as shares of its trace: a matrix
    squared again and again, divided by its trace, becomes the projector on its largest eigenvector; the
    eigenvalue is the trace of matrix times projector, and is then taken out."""
    def times(a: str, b: str) -> str:
        return (f"list_transform(range({d * d}), lambda x: list_sum(list_transform(range({d}), lambda y: "
                f"{a}[(x // {d}) * {d} + y + 1] * {b}[y * {d} + x % {d} + 1])))")

    trace = lambda m: "(" + " + ".join(f"{m}[{i * d + i + 1}]" for i in range(d)) + ")"
    scaled = lambda m, by: f"list_transform({m}, lambda v: v / {by})"
    parts = []
    for i in range(1, k + 1):
        parts.append(f"""
s{i} AS (SELECT 0 AS step, {scaled('m', trace('m'))} AS p FROM c{i}
         UNION ALL SELECT step + 1, {scaled('q', trace('q'))} FROM (SELECT step, {times('p', 'p')} AS q FROM s{i} WHERE step < 24)),
l{i} AS (SELECT m, p, {trace(times('m', 'p'))} AS value FROM c{i}, s{i} WHERE step = 24),
c{i + 1} AS (SELECT list_transform(list_zip(m, p), lambda e: e[1] - value * e[2]) AS m FROM l{i})""")
    return ",".join(parts) + ",\nshares AS (" + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS componente, value / {d} AS v FROM l{i}" for i in range(1, k + 1)) + ")"


@query("r10_fitted_summary")
def r10_fitted(t):
    """The executive summary of a study fitted and saved: best of M1's models, M19's segments."""
    path = scratch_path(t.spark, "estudio")
    ST.fit_study(t.cargos, features(t), path)
    other = finance_metrics(t).where("metrica <> 'mejor_r2'")
    insights = R.finance_findings(t.spark, ST.fitted_metric(t.spark, path).unionByName(other))
    return ST.study_summary(t.spark, path, t.cargos, features(t), insights)


@query("m21_pca_summary", sql=f"""
{FEAT_ROLES.replace('WITH', 'WITH RECURSIVE', 1)}, {FEATURES_SQL},
f AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURE_COLS)} FROM feat WHERE edad >= 0 AND {' AND '.join(f'{c} IS NOT NULL' for c in FEATURE_COLS)}),
c1 AS (SELECT [{', '.join(f'CORR({a}, {b})' for a in FEATURE_COLS for b in FEATURE_COLS)}] AS m FROM f),
{_eigen_sql(len(FEATURE_COLS), 3)}
SELECT componente, {r6('v')} AS varianza, {r6('SUM(v) OVER (ORDER BY componente)')} AS acumulada FROM shares
""")
def m21(t):
    return MD.pca_summary(features(t), FEATURE_COLS, 3).withColumns({c: F.round(c, 6) for c in ("varianza", "acumulada")})


@query("m22_kmeans_sweep")
def m22(t):
    return MD.kmeans_sweep(features(t), FEATURE_COLS)


@query("m22_best_k")
def m22_best(t):
    return MD.kmeans_study(features(t), FEATURE_COLS)[1]


@query("m22_cluster_table")
def m22_clusters(t):
    table = MD.kmeans_study(features(t), FEATURE_COLS)[2]
    mean = lambda c: F.round(f"{c}_promedio", 2)
    return table.withColumn("perfil", R.cluster_profile(mean("edad"), mean("visitas"), mean("estudios"), mean("diagnosticos"),
                                                        mean("monto")))


def _sse_curve(t):
    """Binding: a deterministic (k, inertia) curve: within-bin squared error of the charge
    amount cut into k equal-width bins, k = 1..10."""
    c = t.cargos.select("subtotal")
    st = c.agg(F.struct(F.min("subtotal").alias("lo"), F.max("subtotal").alias("hi"))).scalar()
    ks = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10))))
    w = (st["hi"] - st["lo"]) / F.col("k")
    b = F.least(F.floor((F.col("subtotal") - st["lo"]) / w), F.col("k") - 1)
    g = ks.groupBy("k", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("subtotal").alias("s"),
                                            F.sum(F.col("subtotal") * F.col("subtotal")).alias("ss"))
    return g.groupBy("k").agg(F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("inercia"))


@query("m23_elbow", sql=f"""
{with_roles('cargos')},
st AS (SELECT MIN(subtotal) AS lo, MAX(subtotal) AS hi FROM cargos),
ks AS (SELECT subtotal, unnest(range(1, 11)) AS k FROM cargos),
g AS (SELECT k, LEAST(FLOOR((subtotal - st.lo) / ((st.hi - st.lo) / k)), k - 1) AS bin, COUNT(*) AS n, SUM(subtotal) AS s,
             SUM(subtotal * subtotal) AS ss FROM ks, st GROUP BY 1, 2),
p AS (SELECT k, SUM(ss - s * s / n) AS inercia FROM g GROUP BY k),
e AS (SELECT MIN(k) AS k0, MAX(k) AS k1, MIN(inercia) AS y0, MAX(inercia) AS y1, arg_min(inercia, k) AS yf,
             arg_max(inercia, k) AS yl, COUNT(*) AS n, MAX(k) AS kmax FROM p),
d AS (SELECT p.k, ABS(((e.yl - e.y0) / (e.y1 - e.y0) - (e.yf - e.y0) / (e.y1 - e.y0)) * ((p.k - e.k0) / (e.k1 - e.k0))
                      - (p.inercia - e.y0) / (e.y1 - e.y0) + (e.yf - e.y0) / (e.y1 - e.y0))
             / SQRT(POWER((e.yl - e.y0) / (e.y1 - e.y0) - (e.yf - e.y0) / (e.y1 - e.y0), 2) + 1) AS d FROM p, e)
SELECT CAST(CASE WHEN (SELECT n FROM e) < 3 THEN (SELECT kmax FROM e)
                 ELSE (SELECT k FROM d ORDER BY ROUND(d, 9) DESC, k LIMIT 1) END AS INTEGER) AS k_codo
""")
def m23(t):
    return MM.elbow(_sse_curve(t))


@query("m24_trial_grid")
def m24(t):
    return MD.trial_grid(features(t), FEATURE_COLS, [2, 3, 4], list(range(2, 9)))


@query("m25_cluster_issues")
def m25(t):
    f = MD.written(features(t))
    assigned = MD.kmeans_segments(f, FEATURE_COLS, 3)
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sweep = MD.kmeans_sweep(f, FEATURE_COLS, [3])
    pca = MD.pca_summary(f, FEATURE_COLS, 3)
    sil = sweep.select(F.max("silueta")).scalar()
    var = pca.select(F.max("acumulada")).scalar()
    return MM.cluster_issues(t.spark, sizes, sil, var)


@query("m26_account_features", sql=f"""
{with_roles('atencion', 'cargos')}
SELECT a.id_atencion, COUNT(d.id_atencion) AS n_cargos, {r6('AVG(d.precio)')} AS precio_promedio,
       COALESCE({money('d.subtotal')}, CAST(0 AS DECIMAL(38,2))) AS ingreso
FROM atencion a LEFT JOIN cargos d USING (id_atencion) WHERE a.status = 'ABIERTA' GROUP BY a.id_atencion
""")
def m26(t):
    from ..operators._common import money_sum
    agg = t.cargos.groupBy("id_atencion").agg(F.count(F.lit(1)).alias("n_cargos"), r6_(F.avg("precio")).alias("precio_promedio"),
                                              money_sum("subtotal").alias("ingreso"))
    open_att = t.atencion.filter("status = 'ABIERTA'").select("id_atencion")
    return open_att.join(agg, "id_atencion", "left").select(
        "id_atencion", F.coalesce("n_cargos", F.lit(0)).alias("n_cargos"), "precio_promedio",
        F.coalesce("ingreso", F.lit(0).cast("decimal(38,2)")).alias("ingreso"))


def r6_(c):
    from ..operators._common import r6 as _r6
    return _r6(c)
