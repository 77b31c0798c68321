"""Operators on hand-made fixtures and the reference's golden in-code tables."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaspark.ml import metrics as MM
from vistaspark.ml import models as MD
from vistaspark.operators import aggregates as A
from vistaspark.operators import filters as FL
from vistaspark.operators import jobs as B
from vistaspark.operators import joins as J
from vistaspark.operators import rules as R
from vistaspark.operators import windows as W
from vistaspark.operators._common import dense_index
from vistaspark.sources import sinks as S
from vistaspark.sources import tables as TB

# The nine-product inventory table of the reference's retail example (input and stored output).
INVENTORY = [
    ("Leche", "Lácteos", 120.0, 10, 1.2), ("Carne Res", "Carnes", 85.0, 8, 5.5), ("Yogurt", "Lácteos", None, 20, 0.9),
    ("Pollo", "Carnes", 60.0, 12, 3.2), ("Queso", "Lácteos", 150.0, 5, 2.1), ("Pan", "Panadería", 200.0, 40, 0.8),
    ("Carne Cerdo", "Carnes", None, 14, 4.8), ("Mantequilla", "Lácteos", 90.0, 9, 1.5), ("Crema", "Lácteos", 110.0, 13, 1.3),
]
INV_SCHEMA = "producto string, categoria string, ventas double, stock int, precio double"
EXPECTED_RISK = ["Medio", "Medio", "Bajo", "Medio", "Alto", "Bajo", "Medio", "Medio", "Medio"]


@pytest.fixture(scope="module")
def inventory(spark):
    return spark.createDataFrame(INVENTORY, INV_SCHEMA)


def test_inventory_golden(inventory):
    imp = FL.impute_median(inventory, ["ventas"])
    assert [r.ventas for r in imp.orderBy("producto").collect() if r.producto in ("Yogurt", "Carne Cerdo")] == [110.0, 110.0]
    scaled = W.minmax(imp, ["ventas", "stock"])
    risk = scaled.withColumn("riesgo", FL.stock_risk("stock", "ventas"))
    got = {r.producto: r for r in risk.collect()}
    for (name, *_), exp in zip(INVENTORY, EXPECTED_RISK):
        assert got[name].riesgo == exp
    assert got["Leche"].ventas_esc == pytest.approx(0.428571, abs=1e-6)
    assert got["Queso"].stock_esc == 0.0
    assert got["Pan"].ventas_esc == 1.0


def test_inventory_argmax_top_category_summary(inventory):
    inv = inventory.withColumn("valor", F.col("stock") * F.col("precio"))
    top = {r.columna: r.producto for r in A.argmax_rows(inv, ["precio", "stock", "valor"], "producto", ["producto"]).collect()}
    assert top == {"precio": "Carne Res", "stock": "Pan", "valor": "Carne Cerdo"}
    assert A.top_category(inventory, "categoria").first().categoria == "Lácteos"
    summ = {r.categoria: r for r in A.inventory_summary(inventory, "categoria", "stock", "precio").collect()}
    assert summ["TOTAL"].filas == 9 and summ["TOTAL"].categorias == 3 and summ["TOTAL"].stock_total == 131


def test_multi_fit_matches_normal_equations(inventory):
    imp = FL.impute_median(inventory, ["ventas"])
    coefs = {r.variable: r.coeficiente for r in MD.multi_fit(imp, ["stock", "precio"], "ventas").collect()}
    pdf = imp.toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf.stock, pdf.precio])
    beta = np.linalg.lstsq(X, pdf.ventas.to_numpy(), rcond=None)[0]
    assert coefs["intercepto"] == pytest.approx(beta[0], rel=1e-6)
    assert coefs["stock"] == pytest.approx(beta[1], rel=1e-6)
    # the reference stored 111.4883584278129 as Leche's prediction
    assert beta[0] + beta[1] * 10 + beta[2] * 1.2 == pytest.approx(111.4883584278129, rel=1e-9)


def test_elbow_golden(spark):
    # the reference's stored k-means sweep; its elbow is k = 6
    pts = [(2, 582.8485), (3, 496.4854), (4, 418.2595), (5, 359.4922), (6, 284.2474), (7, 249.9696),
           (8, 244.5949), (9, 215.4822), (10, 209.6852)]
    df = spark.createDataFrame(pts, "k int, inercia double")
    assert MM.elbow(df).first().k_codo == 6
    assert MM.elbow(df.filter("k <= 3")).first().k_codo == 3  # fewer than 3 points -> last k


def test_cluster_profile_golden(spark):
    df = spark.createDataFrame([(36.49, 5.63, 32.29, 1.46, 6167.88), (71.28, 3.09, 17.89, 0.74, 3297.18)],
                               "e double, v double, x double, d double, m double")
    out = [r[0] for r in df.select(R.cluster_profile(F.col("e"), F.col("v"), F.col("x"), F.col("d"), F.col("m"))).collect()]
    assert out == ["Joven | Alta Frecuencia | Complejidad Media | Bajo Gasto",
                   "Adulto Mayor | Frecuencia Media | Complejidad Baja | Bajo Gasto"]


def test_confusion_golden(spark):
    rows = [(1, 1)] * 473 + [(1, 0)] * 51 + [(0, 0)] * 483
    pred = spark.createDataFrame(rows, "label int, prediction int")
    cm = MM.confusion(pred).first()
    assert (cm.tp, cm.fp, cm.fn, cm.tn) == (473, 0, 51, 483)
    assert MM.classification_metrics(pred).first().accuracy == pytest.approx(0.9494, abs=1e-4)


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    out = {(r.var_a, r.var_b): r.corr for r in A.corr_matrix(df, ["a", "b"]).collect()}
    assert out[("a", "b")] is None and out[("b", "b")] == 1.0


def test_sigma_outliers_single_row_group_and_equal_prices(spark):
    rows = [("solo", 10.0)] + [("igual", 5.0)] * 4 + [("mix", v) for v in (10.0, 10.0, 10.0, 10.0, 10.0, 50.0)]
    out = W.sigma_outliers(spark.createDataFrame(rows, "k string, p double"), "k", "p", 2.0).collect()
    assert [(r.k, r.p) for r in out] == [("mix", 50.0)]


def test_rollup_status_and_status_match(spark):
    df = spark.createDataFrame([(1, "REALIZADO"), (1, " pendiente "), (2, "CANCELADO"), (2, "REALIZADO"), (3, "REALIZADO")],
                               "k int, e string")
    out = {r.k: r.estado_general for r in A.rollup_status(df, "k", "e").collect()}
    assert out == {1: "PENDIENTE", 2: "CANCELADO", 3: "REALIZADO"}


def test_period_filter_keeps_null_methods(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 31), None), (dt.date(2024, 1, 31), "5-LOW"), (dt.date(2024, 2, 1), "x")],
                               "d date, m string")
    assert FL.period_filter(df, "d", "2024-01-01", "2024-01-31", "m", ["5-LOW"]).count() == 1


def test_share_top_with_null_label(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [(None,)] * 2 + [("c",)], "x string")
    out = {r.categoria: (r.n, r.porcentaje) for r in A.share_top(df, "x", 3).collect()}
    assert out == {"a": (5, 45.45), "b": (3, 27.27), "Otros": (3, 27.27)}


def test_histogram_constant_and_gaps(spark):
    df = spark.createDataFrame([(1.0,)] * 4, "x double")
    assert [(r.bin, r.n) for r in A.histogram(df, "x").collect()] == [(0, 4)]
    df2 = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    h = sorted((r.bin, r.n) for r in A.histogram(df2, "x", 5).collect())
    assert h == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1)]


def test_monthly_trend_fills_gaps(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 3, 9),)], "d date")
    out = [(r.mes.month, r.n) for r in A.monthly_trend(df, "d", 3, "2024-03-20").orderBy("mes").collect()]
    assert out == [(1, 1), (2, 0), (3, 1)]


def test_dense_index_matches_row_number(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 101).alias("v"), "id").repartition(7)
    out = dense_index(df, ["v", "id"], value="v", partitions=5).orderBy("n").collect()
    vs = sorted((r.v, r.id) for r in df.collect())
    assert [r.n for r in out] == list(range(1, 501))
    assert [(r.v, r.id) for r in out] == vs
    assert out[-1].acumulado == sum(v for v, _ in vs)


def test_join_semantics(spark):
    att = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id_atencion long, s string")
    ch = spark.createDataFrame([(1, 1, Decimal("10.00")), (1, 2, Decimal("5.50")), (4, 1, Decimal("1.00"))],
                               "id_atencion long, linea int, subtotal decimal(18,2)")
    assert sorted(r.id_atencion for r in J.orphans(att, ch, "id_atencion").collect()) == [2, 3]
    red = {r.id_atencion: (r.n, r.suma) for r in J.reduce_matches(att, ch, "id_atencion", "subtotal").collect()}
    assert red == {1: (2, Decimal("15.50")), 2: (0, Decimal("0.00")), 3: (0, Decimal("0.00"))}
    first = {r.id_atencion: r.linea for r in J.first_match(att, ch, "id_atencion", ["linea"], ["linea"]).collect()}
    assert first == {1: 1, 2: None, 3: None}
    assert J.left(att, ch, "id_atencion").count() == 4  # row conservation + fan-out of 1


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a", dt.date(2020, 1, 1)), (2, "b", dt.date(2020, 1, 1))], "k int, v string, f date")
    u = spark.createDataFrame([(2, "B", dt.date(2021, 1, 1)), (3, "C", dt.date(2021, 1, 1))], "k int, v string, f date")
    once = B.upsert(t, u, "k", protected=("f",))
    twice = B.upsert(once, u, "k", protected=("f",))
    exp = [(1, "a", dt.date(2020, 1, 1)), (2, "B", dt.date(2020, 1, 1)), (3, "C", dt.date(2021, 1, 1))]
    assert sorted(tuple(r) for r in once.collect()) == exp
    assert sorted(tuple(r) for r in twice.collect()) == exp


def test_delete_where_keeps_headers_without_lines(spark):
    det = spark.createDataFrame([(1, "LAB"), (1, "RX"), (2, "RX")], "id_atencion long, tipo string")
    hdr = spark.createDataFrame([(1,), (2,), (3,)], "id_atencion long")
    d, h = B.delete_where(det, hdr, F.col("tipo") == "RX")
    assert [tuple(r) for r in d.collect()] == [(1, "LAB")]
    assert sorted(r.id_atencion for r in h.collect()) == [1, 3]


def test_export_restore_round_trip(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("d", T.DateType()),
                           T.StructField("m", T.DecimalType(18, 2)), T.StructField("s", T.StringType())])
    df = spark.createDataFrame([(1, dt.date(2024, 2, 29), Decimal("10.50"), "á"), (2, None, None, None)], schema)
    for fmt in ("json", "csv"):
        paths = S.export_tables({"t": df}, S.scratch_path(spark, "rt"), fmt)
        back = S.restore_tables(spark, paths, {"t": schema}, fmt)["t"]
        got = sorted((tuple(r) for r in back.collect()), key=lambda r: r[0])
        exp = [(1, dt.date(2024, 2, 29), Decimal("10.50"), "á"), (2, None, None, None if fmt == "json" else None)]
        assert got == exp, fmt


def test_load_tables_reports_missing(spark):
    tables, missing = TB.load_tables(spark, "/root/testdata/sf0.001", ["region", "no_existe"])
    assert list(tables) == ["region"] and missing == ["no_existe"]


def test_conform_and_ragged_union(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([("1", "x")], "a string, b string")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("c", T.DateType())])
    assert [tuple(r) for r in TB.conform(df, schema).collect()] == [(1, None)]
    u = TB.ragged_union([spark.createDataFrame([(1, "x")], "k int, b string"), spark.createDataFrame([("y",)], "c string")])
    assert u.columns == ["b", "c", "k"] and sorted(tuple(r) for r in u.collect()) == [("", "y", None), ("x", "", 1)]


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = rng.normal(size=(60, 4))
    labels = (pts[:, 0] > 0).astype(int) + (pts[:, 1] > 0).astype(int)
    rows = [(i, [float(x) for x in p], int(l)) for i, (p, l) in enumerate(zip(pts, labels))]
    df = spark.createDataFrame(rows, "id long, v array<double>, label long")
    train, test = df.filter("id < 45"), df.filter("id >= 45")
    got = {r.id: r.prediccion for r in MD.knn_classify(train, test, "id", "v", "label", k=3, blocks_test=3,
                                                          blocks_train=2).collect()}
    for i in range(45, 60):
        d = ((pts[:45] - pts[i]) ** 2).sum(1)
        nn = np.lexsort((np.arange(45), d))[:3]
        vals, counts = np.unique(labels[nn], return_counts=True)
        assert got[i] == vals[np.argmax(counts)]


def test_knn_blocks_follow_the_rows(spark):
    rng = np.random.default_rng(9)
    pts = rng.normal(size=(400, 3))
    labels = (pts[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, [float(x) for x in p], int(l)) for i, (p, l) in enumerate(zip(pts, labels))],
                               "id long, v array<double>, label long")
    train, test = df.filter("id < 300"), df.filter("id >= 300")
    assert (MD.knn_blocks(train, 50), MD.knn_blocks(test, 50), MD.knn_blocks(test), MD.knn_blocks(test.limit(0))) == (6, 4, 4, 4)
    got = {r.id: r.prediccion for r in MD.knn_classify(train, test, "id", "v", "label", k=3, block_rows=50).collect()}
    assert len(got) == 100
    for i in range(300, 400):
        near = np.lexsort((np.arange(300), ((pts[:300] - pts[i]) ** 2).sum(1)))[:3]
        assert got[i] == np.bincount(labels[near]).argmax()


def test_kmeans_study_best_k_and_cluster_table(spark):
    rng = np.random.default_rng(3)
    centres = [(0.0, 0.0), (40.0, 0.0), (0.0, 40.0)]
    rows = [(float(x + rng.normal()), float(y + rng.normal())) for x, y in centres for _ in range(30)]
    sweep, best, table = MD.kmeans_study(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], [2, 3, 4, 5])
    scores = {r.k: (r.inercia, r.silueta) for r in sweep.collect()}
    assert {r.criterio: (r.k, r.inercia, r.silueta) for r in best.collect()} == {
        "codo": (3, *scores[3]), "silueta": (3, *scores[3])}
    found = sorted((r.n, round(r.a_promedio / 40), round(r.b_promedio / 40)) for r in table.collect())
    assert found == [(30, 0, 0), (30, 0, 1), (30, 1, 0)]


def test_split_is_stable_under_repartition(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "k")
    a, _ = MD.split(df, "k", 0.8, 42)
    b, _ = MD.split(df.repartition(13), "k", 0.8, 42)
    assert sorted(r.k for r in a.collect()) == sorted(r.k for r in b.collect())
    tr, te = MD.split(df.withColumn("s", F.col("k") % 3), "k", 0.75, 42, strata="s", exact_strata=True)
    counts = {r.s: r.n for r in tr.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {0: 500, 1: 500, 2: 500}


def test_relapse_risk_on_fixture(spark):
    det = spark.createDataFrame([
        (10, 5, "OCT de retina", "REALIZADO", dt.date(2024, 1, 2)),
        (10, 5, "OCT de retina", "PENDIENTE", None),
        (10, 3, "Tonometría", "PENDIENTE", None),
        (11, 99, "Glucosa", "PENDIENTE", None),
        (11, 98, "Perfil de lípidos", "PENDIENTE", None),
    ], "id_examen long, id_catalogo long, nombre_examen string, estado string, fecha_realizado date")
    hdr = spark.createDataFrame([(10, 100, dt.date(2024, 1, 1)), (11, 100, dt.date(2024, 1, 1))],
                                "id_examen long, id_atencion long, fecha date")
    att = spark.createDataFrame([(100, 7), (101, 8)], "id_atencion long, Id_exp long")
    dx = spark.createDataFrame([(100, "Glaucoma crónico")], "id_atencion long, texto string")
    out = {r.Id_exp: r for r in R.relapse_risk(det, hdr, att, dx, R.CLINICAL_RULES, "2024-02-01").collect()}
    p = out[7]
    # exams 3 -> 2, retina 2 -> 2, glaucoma 1 -> 1, repeats 1 -> 2, pending 2 -> 0, diagnosis -> 2, systemic 2 -> 1
    assert (p.total_examenes_oculares, p.estudios_retina, p.estudios_glaucoma, p.examenes_repetidos) == (3, 2, 1, 1)
    assert p.score_recaida == 10 and p.nivel_riesgo_recaida == "ALTO" and p.perfil_principal == "Retina/Mácula"
    assert out[8].score_recaida == 0 and out[8].nivel_riesgo_recaida == "BAJO"


def test_rule_engine_exclusive_groups(spark):
    metrics = R.metrics_table(spark, {"ocupacion_pct": F.lit(85.0), "anomalias_signos": F.lit(0.0),
                                      "adultos_mayores": F.lit(9.0)})
    out = {r.regla for r in R.clinical_findings(spark, metrics).collect()}
    assert out == {"ocupacion_critica", "adultos_mayores"}


def test_regression_metrics_exact(spark):
    pred = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "label double, prediction double")
    r = MM.regression_metrics(pred).first()
    assert r.mae == pytest.approx(1 / 3, abs=1e-6) and r.r2 == pytest.approx(0.75, abs=1e-6)


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_ranked_quantiles_equal_exact_percentile(spark, n):
    rng = np.random.default_rng(n)
    vals = [(float(v),) for v in rng.integers(0, 20, size=n)] + [(None,)]
    df = spark.createDataFrame(vals, "x double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    ranked = A.ranked_quantiles(df, "x", probs).first().q
    exact = df.select(F.percentile("x", probs)).first()[0]
    assert ranked == pytest.approx(exact, abs=1e-9)


def test_window_group_limit_before_shuffle(spark):
    from vistaspark.sources.sinks import retain_latest

    df = spark.range(0, 1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("ts"), F.col("id").alias("k"))
    plan = retain_latest(df, "g", "ts", "k", 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_grouped_ranked_quantiles_with_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 50, size=300)] + [("b", 1.0), ("b", 4.0), ("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: r.q for r in A.ranked_quantiles(df, "x", probs, by=["g"]).collect()}
    exp = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", probs).alias("q")).collect()}
    assert got.keys() == exp.keys()
    for g in exp:
        assert got[g] == pytest.approx(exp[g], abs=1e-9)


@pytest.mark.parametrize("name", ["finance", "clinical", "unsupervised"])
def test_batch_analyses_write_every_section(spark, name):
    from vistaspark.plans.analyses import ANALYSES, run_analysis

    out = S.scratch_path(spark, f"analysis-{name}")
    written = run_analysis(spark, name, "/root/testdata/sf0.001", out, "t1")
    assert len(written) >= 5
    back = spark.read.json(f"{out}/{name}/run_id=t1")
    assert sorted(r.section for r in back.select("section").distinct().collect()) == sorted(written)


def test_band_edges(spark):
    df = spark.createDataFrame([(99.99,), (100.0,), (299.99,), (300.0,), (None,)], "p double")
    assert [r[0] for r in df.select(FL.band("p")).collect()] == ["Bajo", "Medio", "Medio", "Alto", None]
    amounts = spark.createDataFrame([(0.0,), (100.0,), (499.99,), (500.0,), (1000.0,)], "x double")
    out = {r.rango: r.n for r in FL.amount_distribution(amounts, "x").collect()}
    assert out == {"0-100": 1, "100-500": 2, "500-1000": 1, "1000+": 1}


def test_overdue_exactly_seven_days_is_not_overdue(spark):
    df = spark.createDataFrame([("PENDIENTE", dt.date(2024, 1, 24)), ("pendiente", dt.date(2024, 1, 23)),
                                ("REALIZADO", dt.date(2023, 1, 1))], "e string, d date")
    out = [(r.e, r.dias) for r in FL.overdue(df, "e", "d", "2024-01-31", 7).collect()]
    assert out == [("pendiente", 8)]


def test_relapse_levels_at_exact_thresholds(spark):
    # 4 points -> MEDIO, 8 points -> ALTO (thresholds are inclusive)
    def patient(pid, exams):
        return [(pid * 100 + i, cat, name, "REALIZADO", dt.date(2024, 1, 1)) for i, (cat, name) in enumerate(exams)]

    # patient 10: 2 ocular exams (1) + retina 1 (1) + glaucoma 1 (1) + 2 systemic markers (1) = 4
    # patient 20: 5 ocular exams (3) + retina 2 (2) + glaucoma 1 (1) + cornea 1 (1) + 2 systemic (1) = 8
    det_rows = (patient(1, [(5, "a"), (3, "b"), (17, "x"), (18, "y")])
                + patient(2, [(5, "a"), (7, "b"), (3, "c"), (9, "d"), (1, "e"), (17, "x"), (18, "y")]))
    det = spark.createDataFrame([(r[0] // 100, r[1], r[2], r[3], r[4]) for r in det_rows],
                                "id_examen long, id_catalogo long, nombre_examen string, estado string, fecha_realizado date")
    hdr = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1)), (2, 2, dt.date(2024, 1, 1))],
                                "id_examen long, id_atencion long, fecha date")
    att = spark.createDataFrame([(1, 10), (2, 20)], "id_atencion long, Id_exp long")
    dx = spark.createDataFrame([(1, "sano")], "id_atencion long, texto string")
    out = {r.Id_exp: (r.score_recaida, r.nivel_riesgo_recaida) for r in
           R.relapse_risk(det, hdr, att, dx, R.CLINICAL_RULES, "2024-02-01").collect()}
    assert out == {10: (4, "MEDIO"), 20: (8, "ALTO")}


def test_duplicate_keys_fingerprint_equals_plain(spark):
    rows = [(i, t) for i, t in enumerate(["a", "b", "a", "c", None, None, "b", "a", "d"])]
    df = spark.createDataFrame(rows, "id long, t string")
    plain = sorted(tuple(r) for r in A.duplicate_keys(df, "t", "id", fingerprint=False).collect())
    fp = sorted(tuple(r) for r in A.duplicate_keys(df, "t", "id").collect())
    assert fp == plain == [("a", 0, 3), ("a", 2, 3), ("a", 7, 3), ("b", 1, 2), ("b", 6, 2)]
