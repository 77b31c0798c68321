"""Five outputs of one numbering, published together; V5, V19 and A29 on small tables."""

import pytest
from pyspark.sql import functions as F

from vistaspark.operators import aggregates as A
from vistaspark.operators import jobs as B
from vistaspark.plans import reports
from vistaspark.sources import sinks as S

REQUEST = ("solicitud long, nombre string, especialidad string, medicos array<string>, fam_nombre string, parentesco string, telefono string")


def admitted(spark, n, beds):
    rows = [(100 + i, f"p{i}", "GENERAL", ["d1", " ", None, f"d{i}", "d3", "d4", "d5", "d6"] if i % 2 else None, f"f{i}", "OTRO", None) for i in range(n)]
    req = spark.createDataFrame(rows, REQUEST).repartition(3)
    return B.admit_all(req, spark.createDataFrame([(b,) for b in beds], "id_cama long"), 1000, 5000, "2024-01-01", ["solicitud"])


def test_all_outputs_share_one_numbering(spark):
    out = {k: [tuple(r) for r in v.collect()] for k, v in admitted(spark, 6, [9, 3, 7, 5]).items()}
    assert sorted(out["pacientes"]) == [(1001 + i, 100 + i, f"p{i}") for i in range(6)]
    assert sorted(out["familiares"]) == [(1001 + i, f"f{i}", "OTRO", None) for i in range(6)]
    assert sorted((r[0], r[1], r[2]) for r in out["atencion"]) == [(5001 + i, 1001 + i, b) for i, b in enumerate([3, 5, 7, 9, None, None])]
    doctors = [r[1] for r in sorted(out["atencion_medicos"]) if r[0] == 5002]
    assert len(doctors) == 5 and {r[0] for r in out["atencion_medicos"]} == {5002, 5004, 5006}
    assert sorted(out["camas"]) == [(3, 1), (5, 1), (7, 1), (9, 1)]


def test_a_rerun_replaces_all_outputs_and_a_died_run_none(spark):
    path = S.scratch_path(spark, "publish")
    assert S.publish(spark, admitted(spark, 2, [1, 2]), path, "lunes") == 1
    S.publish(spark, admitted(spark, 3, [1]), path, "martes")
    assert S.read_published(spark, path, "pacientes").count() == 5

    def broken(df):
        return df.withColumn("boom", F.raise_error(F.lit("lost")))

    tables = admitted(spark, 4, [1])
    with pytest.raises(Exception, match="lost"):
        S.publish(spark, tables | {"camas": broken(tables["camas"])}, path, "lunes")
    assert S.read_published(spark, path, "pacientes").where("corrida = 'lunes'").count() == 2
    S.publish(spark, tables, path, "lunes")
    now = {(r.corrida, r.tabla): r.filas for r in S.published(spark, path).collect()}
    assert now["lunes", "pacientes"] == 4 and now["lunes", "camas"] == 1 and now["martes", "pacientes"] == 3 and len(now) == 10
    assert S.read_published(spark, path, "camas").where("corrida = 'lunes'").count() == 1
    with pytest.raises(ValueError, match="nothing published"):
        S.read_published(spark, path, "otra")


def test_pressure_alerts_take_both_limits(spark):
    df = spark.createDataFrame([("TA 120/80",), ("120/95",), ("120 / 50",), ("150/80",), ("80/70",), ("sin dato",), (None,)], "ta string").withColumn("fc", F.lit(70.0))
    got = {r.signo: (r.alertas, r.validos) for r in A.alert_rates(df, {"fc": (60.0, 100.0)}, {"ta": ((90.0, 140.0), (60.0, 90.0))}).collect()}
    assert got == {"fc": (0, 7), "ta": (4, 5)}


def test_bed_sections(spark):
    att = spark.createDataFrame([(1, 10, "ABIERTA", "C"), (2, 11, "ABIERTA", "X"), (3, 12, "CERRADA", "C")], "id_atencion long, Id_exp long, status string, area string")
    pat = spark.createDataFrame([(10, "ana"), (11, "bo")], "Id_exp long, nombre string")
    beds = spark.createDataFrame([(1, "u1", "U"), (2, "u2", "U"), (3, "h1", "H")], "id_cama long, numero string, area string")
    occ = spark.createDataFrame([(1, 2), (1, 2), (1, 1)], "id_cama long, id_atencion long")
    got = sorted((r.seccion, r.numero, r.estatus, r.paciente) for r in reports.bed_sections(att, pat, beds, occ, "C", "U", "H").collect())
    assert got == sorted([("consulta", "Consulta 1", "OCUPADA", "ana"), ("urgencias", "u1", "OCUPADA", "ana"), ("urgencias", "u1", "OCUPADA", "bo"),
                          ("urgencias", "u2", "LIBRE", None), ("hospitalizado", "h1", "LIBRE", None)], key=lambda r: r[:2] + (r[3] or "",))


def test_edit_header(spark):
    d = spark.createDataFrame([(1, 3, "b", "", "E3"), (1, 1, None, " ", "E1"), (1, 2, "b", "ver", "E2"), (1, 4, "a", "no", "E4"), (2, 1, None, None, "E1")],
                              "id_atencion long, linea int, archivo string, observacion string, estudio string")
    att = spark.createDataFrame([(1, 10), (2, 10)], "id_atencion long, Id_exp long")
    pat = spark.createDataFrame([(10, "ana", "C")], "Id_exp long, nombre string, area string")
    rooms = spark.createDataFrame([(1, "101")], "id_atencion long, habitacion string")
    got = {r.id_examen: (r.paciente, r.habitacion, r.estudios, r.archivos, r.observaciones) for r in reports.edit_headers(d, ["linea"], att, pat, rooms).collect()}
    assert got == {1: ("ana C", "101", "E1, E2, E3, E4", "b,a", "ver"), 2: ("ana C", None, "E1", "", "")}
