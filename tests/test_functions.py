"""Scalar functions (T1-T17) on hand-made fixtures: accents, dates, nulls, edge formats."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from vistaspark.functions import arrays as AR
from vistaspark.functions import dates as D
from vistaspark.functions import numbers as N
from vistaspark.functions import text as TX


def one(spark, col, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col.alias("y")).collect()]


def test_fold_accents_and_nulls(spark):
    out = one(spark, TX.fold("x"), [("Tonometría",), (" campimetría \n",), (None,), ("Ñandú œuvre",)])
    assert out == ["TONOMETRIA", "CAMPIMETRIA", "", "NANDU UVRE"]


def test_classify_priority_and_default(spark):
    rules = [("Retina y macula", ["RETINA", "OCT"]), ("Glaucoma", ["GLAUCOMA", "TONOMETRIA"])]
    out = one(spark, TX.classify("x", rules, "Otros"),
              [("Tonometría ocular",), ("OCT de retina con glaucoma",), ("rayos x",), (None,)])
    assert out == ["Glaucoma", "Retina y macula", "Otros", "Otros"]


def test_parse_money(spark):
    out = one(spark, N.parse_money("x", 0.0), [("$1,234.50",), ("abc",), ("NaN",), ("",), (None,), (" 12 ",)])
    assert out == [1234.5, 0.0, 0.0, 0.0, 0.0, 12.0]


def test_parse_bp(spark):
    rows = spark.createDataFrame([("TA 120 / 80 mmHg",), ("120-80",), ("presion 95/60",), (None,)], "x string")
    out = [tuple(r) for r in rows.select(TX.parse_bp("x").alias("b")).select("b.*").collect()]
    assert out == [(120, 80), (None, None), (95, 60), (None, None)]


def test_parse_ts_layouts(spark):
    rows = [("2024-03-05T10:20:30",), ("2024-03-05 10:20:30.123",), ("2024-03-05",), ("05/03/2024",),
            ("20240305",), ("2024/3/5",), ("",), ("basura",), ("2024-03-05T10:20:30Z",)]
    out = one(spark, D.parse_ts("x"), rows)
    d = dt.datetime
    assert out == [d(2024, 3, 5, 10, 20, 30), d(2024, 3, 5, 10, 20, 30), d(2024, 3, 5), d(2024, 3, 5),
                   d(2024, 3, 5), d(2024, 3, 5), None, None, d(2024, 3, 5, 10, 20, 30)]


def test_day_month_wins_over_month_day(spark):
    assert one(spark, D.parse_ts("x"), [("03/04/2024",)]) == [dt.datetime(2024, 4, 3)]


def test_age_rules_differ_on_leap_birthday(spark):
    df = spark.createDataFrame([(dt.date(2000, 2, 29),)], "b date")
    r = df.select(D.age_calendar("b", "2023-02-28").alias("a"), D.age_months_rule("b", "2023-02-28").alias("m")).first()
    assert (r.a, r.m) == (22, 23)


def test_age_future_or_too_old_is_null(spark):
    df = spark.createDataFrame([(dt.date(2030, 1, 1),), (dt.date(1850, 1, 1),), (dt.date(1990, 6, 15),)], "b date")
    assert [r[0] for r in df.select(D.age_calendar("b", "2024-06-14")).collect()] == [None, None, 33]


def test_days_between_negative_is_null(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 10), dt.date(2024, 1, 1)), (dt.date(2024, 1, 1), dt.date(2024, 1, 10))],
                               "a date, b date")
    assert [r[0] for r in df.select(D.days_between("a", "b")).collect()] == [None, 9]


def test_month_label_and_date_display(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 15), "2024-12-01"), (dt.date(1999, 12, 1), "n/a")], "d date, t string")
    out = [tuple(r) for r in df.select(D.month_label("d"), D.date_display("t")).collect()]
    assert out == [("Ene 24", "01/12/2024"), ("Dic 99", "Sin fecha")]


def test_split_clean_keeps_first_order(spark):
    out = one(spark, F.array_join(AR.split_clean("x", ","), "|"), [(" b.pdf, a.pdf,, b.pdf ,c.pdf ",)])
    assert out == ["b.pdf|a.pdf|c.pdf"]


def test_first_non_blank(spark):
    df = spark.createDataFrame([([" ", None, "x", "y"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(AR.first_non_blank("a")).collect()] == ["x", None]


def test_full_name_null_safe_and_clip(spark):
    df = spark.createDataFrame([("Perez", None, "Ana"), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(TX.full_name("a", "b", "c")).collect()] == ["Perez Ana", ""]
    out = one(spark, TX.clip_label("x", 10), [("abcdefghijkl",), ("corto",), (None,)])
    assert out == ["abcdefg...", "corto", "Sin dato"]


def test_pct_and_iva(spark):
    df = spark.createDataFrame([(1, 3, Decimal("100.00")), (1, 0, Decimal("0.05"))], "a int, b int, s decimal(38,2)")
    iva, total = N.with_iva("s")
    out = [tuple(r) for r in df.select(N.pct("a", "b"), iva, total).collect()]
    assert out == [(33.33, Decimal("16.00"), Decimal("116.00")), (None, Decimal("0.01"), Decimal("0.06"))]


def test_factor_list_skips_false(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "a int, b int")
    col = TX.factor_list([("A", F.col("a") > 0), ("B", F.col("b") > 0)])
    assert [r[0] for r in df.select(col).collect()] == ["A", ""]


def test_zip_items_pads_and_drops_blank_names(spark):
    df = spark.createDataFrame([(["ibuprofeno", " ", "paracetamol"], ["400mg"])], "n array<string>, d array<string>")
    out = df.select(F.explode(AR.zip_items({"medicamento": "n", "dosis": "d"})).alias("z")).select("z.*").collect()
    assert [tuple(r) for r in out] == [("ibuprofeno", "400mg"), ("paracetamol", "")]


def test_clinical_exam_profiles_fold_accents(spark):
    out = one(spark, TX.classify("x"), [("Tonometría de aplanación",), ("OCT macular",), ("Paquimetría",),
                                        ("Biometría ocular",), ("Agudeza visual",), ("Biometría hemática",), ("Rayos X",)])
    assert out == ["Glaucoma", "Retina y macula", "Cornea", "Catarata", "Vision y refraccion", "Catarata", "Otros estudios"]
    hit = TX.contains_any(TX.fold("x"), TX.OCULAR_KEYWORDS)
    assert one(spark, hit, [("Campimetría",), ("Rayos X",)]) == [True, False]


def test_lab_threshold_levels(spark):
    from vistaspark.operators.rules import threshold_risk

    labs = spark.createDataFrame([(1, "Glucosa", 99.0), (1, "Glucosa", 110.0), (2, "Glucosa", 130.0),
                                  (3, "Hemoglobina Glicosilada", 5.0)], "Id_exp long, prueba string, valor double")
    out = {(r.Id_exp, r.prueba): r.nivel for r in threshold_risk(labs).collect()}
    assert out == {(1, "Glucosa"): "MEDIO", (2, "Glucosa"): "ALTO", (3, "Hemoglobina Glicosilada"): "BAJO"}


def test_fold_equals_nfkd_ascii_fold(spark):
    """T1 against Python's own NFKD -> ASCII -> upper -> strip, on random mixed strings."""
    import random
    import unicodedata

    pool = ([chr(c) for c in range(0x20, 0x7F)] + [" ", "\t", "\n"] + [chr(c) for c in range(0xA0, 0x250)]
            + [chr(c) for c in range(0x1E00, 0x1F00)] + list("¼½¾ﬁﬂﬃĲǄ⅓Ⅻ²ＡＺａｚ１") + ["\u0301", "\u4e2d", "\u0394"])
    rng = random.Random(11)
    rows = [("".join(rng.choice(pool) for _ in range(rng.randint(0, 40))),) for _ in range(400)]
    got = one(spark, TX.fold("x"), rows)
    exp = [unicodedata.normalize("NFKD", r[0]).encode("ascii", "ignore").decode("ascii").upper().strip(" \t\n")
           for r in rows]
    assert got == exp


def test_fold_covers_every_code_point(spark):
    import unicodedata

    points = [c for c in map(chr, range(0x20, 0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF and (
        unicodedata.decomposition(c) or ord(c) < 0x3000)]
    rows = [(f"a{c}b",) for c in points]
    df = spark.createDataFrame(rows, "x string").repartition(8)
    got = {r["x"]: r["y"] for r in df.select("x", TX.fold("x").alias("y")).collect()}
    wrong = [f"{ord(c):X}" for c in points if got[f"a{c}b"] != TX.fold_word(f"a{c}b")]
    assert not wrong, wrong[:20]
    assert TX.fold_word("x…™ №") == "X...TM NO"
