"""Joined report views (V1-V25): compositions of the operators, one DataFrame each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import open_account_totals
from ..operators.windows import stack_sections


def open_attention_report(att: DataFrame, pat: DataFrame, charges: DataFrame) -> DataFrame:
    """Open attentions with their patient and exact account total (0 without charges).

    Charges are summed per attention before joining (no fan-out); patients join inner.
    """
    acc = open_account_totals(att, charges)
    return acc.join(pat.select("Id_exp", "nombre", "area"), "Id_exp", "inner").select(
        "id_atencion",
        F.col("Id_exp").alias("expediente"),
        "area",
        "especialidad",
        "fecha_ing",
        F.col("nombre").alias("paciente"),
        "total_cuenta",
    )


def study_chain(det: DataFrame, att: DataFrame, pat: DataFrame, cat: DataFrame, staff: DataFrame) -> DataFrame:
    """Detail -> attention -> patient -> catalogue -> doctor, one row per detail line.

    Catalogue and staff joins are left joins on their unique keys; Spark broadcasts them
    when the size check allows, and sort-merges otherwise.
    """
    a = att.select("id_atencion", "Id_exp", "fecha_ing")
    p = pat.select("Id_exp", F.col("nombre").alias("paciente"), "area")
    c = cat.select("id_catalogo", F.col("nombre").alias("examen"), F.col("tipo").alias("tipo_examen"))
    m = staff.select(F.col("id_cama").alias("id_medico"), F.col("numero").alias("medico"),
                     F.col("area").alias("area_medico"))
    return (
        det.select("id_atencion", "linea", "id_catalogo", "id_medico")
        .join(a, "id_atencion").join(p, "Id_exp")
        .join(c, "id_catalogo", "left").join(m, "id_medico", "left")
        .select("id_atencion", "linea", "examen", "tipo_examen", "fecha_ing", "paciente", "area", "medico",
                "area_medico")
    )


# ---------------------------------------------------------------- shared pieces
def bed_of_attention(occupants: DataFrame) -> DataFrame:
    """One bed per attention: the lowest-numbered bed it currently holds (partial min)."""
    return (occupants.filter(F.col("id_atencion_actual").isNotNull())
            .groupBy(F.col("id_atencion_actual").alias("id_atencion")).agg(F.min("id_cama").alias("id_cama")))


def with_age(pat: DataFrame, births: DataFrame, as_of: str) -> DataFrame:
    from ..functions.dates import age_calendar

    return pat.join(births, "Id_exp", "left").withColumn("edad", age_calendar("fecnac", as_of))


# ---------------------------------------------------------------- V1-V25
def open_by_area(att: DataFrame, pat: DataFrame, beds_of_att: DataFrame, beds: DataFrame, area: str) -> DataFrame:
    """V1: open attentions of one area with patient, age and bed number (J1 + J2 + T6)."""
    a = att.filter((F.col("status") == "ABIERTA") & (F.col("area") == area)).select(
        "id_atencion", "Id_exp", "area", "fecha_ing")
    p = pat.select("Id_exp", "nombre", "edad")
    b = beds_of_att.join(beds.select("id_cama", F.col("numero").alias("num_cama")), "id_cama")
    return a.join(p, "Id_exp").join(b.select("id_atencion", "num_cama"), "id_atencion", "left")


def patient_documents(att: DataFrame, pat: DataFrame) -> DataFrame:
    """V2: each patient's attentions with display date, newest first (order set before projecting)."""
    from ..functions.dates import date_display

    j = att.select("id_atencion", "Id_exp", "fecha_ing", "status").join(pat.select("Id_exp", "nombre"), "Id_exp")
    return j.orderBy("Id_exp", F.desc("fecha_ing"), F.desc("id_atencion")).select(
        "Id_exp", "nombre", "id_atencion", "status", date_display(F.col("fecha_ing").cast("string")).alias("fecha"))


def discharges(att: DataFrame, pat: DataFrame) -> DataFrame:
    """V3: closed attentions (discharges) with the patient's full name and the closing total."""
    from ..functions.text import full_name

    a = att.filter(F.col("status") == "CERRADA").select("id_atencion", "Id_exp", F.col("fecha_ing").alias("fecha_alta"),
                                                        F.col("monto").cast("decimal(18,2)").alias("total_cuenta"))
    p = pat.select("Id_exp", full_name("area", "nombre").alias("paciente"))
    return a.join(p, "Id_exp", "left")


def bed_board(bed_states: DataFrame, att: DataFrame, pat: DataFrame) -> DataFrame:
    """V5: bed board per section (area): bed status with the occupant's name (J3 + R3 + U3)."""
    occ = att.select(F.col("id_atencion").alias("id_atencion_actual"), "Id_exp").join(
        pat.select("Id_exp", F.col("nombre").alias("paciente")), "Id_exp")
    return bed_states.join(occ, "id_atencion_actual", "left").select(
        F.col("area").alias("seccion"), "id_cama", "numero", "estado_cama", "id_atencion_actual", "paciente")


def bed_sections(att: DataFrame, pat: DataFrame, beds: DataFrame, occupancy: DataFrame, outpatient: str, emergency: str,
                 ward: str) -> DataFrame:
    """V5: the three sections of the bed board, built apart and stacked.

    Outpatient: an open attention of its area is a place of its own. Emergency and ward: the beds of
    their area with each open attention that holds one, or free. ``att`` has area and status;
    ``occupancy`` is (id_cama, id_atencion) of open attentions."""
    names = pat.select("Id_exp", F.col("nombre").alias("paciente"))
    visits = att.filter((F.col("status") == "ABIERTA") & (F.col("area") == outpatient)).select("id_atencion", "Id_exp").join(names, "Id_exp").select(
        F.lit(None).cast("long").alias("id_cama"), F.concat(F.lit("Consulta "), F.col("id_atencion").cast("string")).alias("numero"),
        F.lit("OCUPADA").alias("estatus"), "id_atencion", "Id_exp", "paciente", F.lit(True).alias("tiene_atencion"))
    holders = occupancy.select("id_cama", "id_atencion").distinct().join(att.select("id_atencion", "Id_exp"), "id_atencion").join(names, "Id_exp", "left")

    def of(area: str) -> DataFrame:
        held = F.col("id_atencion").isNotNull()
        return beds.filter(F.col("area") == area).select("id_cama", "numero").join(holders, "id_cama", "left").select(
            F.col("id_cama").cast("long").alias("id_cama"), "numero", F.when(held, "OCUPADA").otherwise("LIBRE").alias("estatus"), "id_atencion",
            "Id_exp", "paciente", held.alias("tiene_atencion"))

    return stack_sections({"consulta": visits, "urgencias": of(emergency), "hospitalizado": of(ward)})


def notes_of_attention(notes: DataFrame, att: DataFrame, pat: DataFrame) -> DataFrame:
    """Notes (id_atencion, orden, autor, nota) of attentions with their patient, newest first."""
    j = notes.join(att.select("id_atencion", "Id_exp"), "id_atencion").join(pat.select("Id_exp", "nombre"), "Id_exp")
    return j.select("id_atencion", "Id_exp", "nombre", "orden", "autor", "nota").orderBy("id_atencion", F.desc("orden"))


def edit_headers(details: DataFrame, line_order, att: DataFrame, pat: DataFrame, rooms: DataFrame) -> DataFrame:
    """What the form for a study's results shows: patient, room, names of its studies, files without
    repeats in their first order, and the first remark that isn't blank. ``details`` (id_atencion, order,
    archivo, observacion, estudio) has the lines of one type of study; its lists are those of one study."""
    w = Window.partitionBy("id_atencion").orderBy(*line_order)
    d = details.select("id_atencion", "archivo", "observacion", "estudio", F.row_number().over(w).alias("r"))
    remark = F.when(F.trim("observacion") != "", F.col("observacion"))
    lists = d.groupBy("id_atencion").agg(
        F.sort_array(F.collect_list(F.struct("r", "estudio", "archivo"))).alias("l"),
        F.coalesce(F.min_by(remark, F.when(remark.isNotNull(), F.col("r"))), F.lit("")).alias("observaciones"))
    lists = lists.select("id_atencion", F.array_join("l.estudio", ", ").alias("estudios"),
                         F.array_join(F.array_distinct(F.array_compact("l.archivo")), ",").alias("archivos"), "observaciones")
    who = att.select("id_atencion", "Id_exp").join(pat.select("Id_exp", F.concat_ws(" ", "nombre", "area").alias("paciente")), "Id_exp")
    return lists.join(who, "id_atencion").join(rooms, "id_atencion", "left").select(
        F.col("id_atencion").alias("id_examen"), "Id_exp", "paciente", "habitacion", "estudios", "archivos", "observaciones")


def patient_sheet(att: DataFrame, pat: DataFrame, first_doctor: DataFrame, beds_of_att: DataFrame) -> DataFrame:
    """V6: open attention sheet: patient, main doctor (first match), bed."""
    a = att.filter(F.col("status") == "ABIERTA").select("id_atencion", "Id_exp", "fecha_ing", "especialidad")
    return (a.join(pat.select("Id_exp", "nombre", "area"), "Id_exp")
            .join(first_doctor, "id_atencion", "left").join(beds_of_att, "id_atencion", "left"))


def study_results(det: DataFrame, cat: DataFrame, att: DataFrame, pat: DataFrame) -> DataFrame:
    """V8: per attention and exam type: patient and the nested detail list (J7 + A12)."""
    d = det.select("id_atencion", "linea", "id_catalogo", "estado").join(
        cat.select("id_catalogo", F.col("nombre").alias("examen"), F.col("tipo").alias("tipo_examen")), "id_catalogo")
    nested = d.groupBy("id_atencion", "tipo_examen").agg(
        F.array_sort(F.collect_list(F.struct("linea", "examen", "estado"))).alias("detalles"))
    a = att.select("id_atencion", "Id_exp").join(pat.select("Id_exp", F.col("nombre").alias("paciente")), "Id_exp")
    return nested.join(a, "id_atencion", "left")


def budget_lines(lines: DataFrame, cat: DataFrame, rate: str = "0.16") -> DataFrame:
    """Budget lines priced from the catalogue (inner join: unknown items drop) + tax."""
    from ..functions.numbers import with_iva

    j = lines.join(cat.select("id_catalogo", F.col("nombre").alias("servicio"), F.col("precio").alias("precio_lista")),
                   "id_catalogo", "inner")
    j = j.withColumn("subtotal", (F.col("precio_lista").cast("decimal(18,2)") * F.col("cantidad").cast("decimal(18,2)"))
                     .cast("decimal(38,2)"))
    iva, total = with_iva("subtotal", rate)
    return j.withColumn("iva", iva).withColumn("total", total)


def exam_worklist(det: DataFrame, cat: DataFrame, att: DataFrame, pat: DataFrame) -> DataFrame:
    """Printed exam list per attention: rolled-up status and the ordered exam names."""
    from ..operators.aggregates import rollup_status

    d = det.select("id_atencion", "linea", "id_catalogo", "estado").join(
        cat.select("id_catalogo", F.col("nombre").alias("examen")), "id_catalogo")
    status = rollup_status(d, "id_atencion", "estado")
    names = d.groupBy("id_atencion").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("linea", "examen"))), lambda x: x["examen"]), ", ").alias("examenes"))
    a = att.select("id_atencion", "Id_exp").join(pat.select("Id_exp", F.col("nombre").alias("paciente")), "Id_exp")
    return status.join(names, "id_atencion").join(a, "id_atencion", "left")


def active_accounts(att: DataFrame, pat: DataFrame, charges: DataFrame, beds_of_att: DataFrame,
                    first_doctor: DataFrame) -> DataFrame:
    """Open accounts: patient, bed, main doctor, subtotal, IVA, total (aggregate before join)."""
    from ..functions.numbers import with_iva
    from ..operators._common import money_sum

    tot = charges.groupBy("id_atencion").agg(money_sum("subtotal").alias("subtotal"))
    a = att.filter(F.col("status") == "ABIERTA").select("id_atencion", "Id_exp")
    j = (a.join(pat.select("Id_exp", F.col("nombre").alias("paciente")), "Id_exp")
         .join(beds_of_att, "id_atencion", "left").join(first_doctor, "id_atencion", "left")
         .join(tot, "id_atencion", "left")
         .withColumn("subtotal", F.coalesce("subtotal", F.lit(0).cast("decimal(38,2)"))))
    iva, total = with_iva("subtotal")
    return j.withColumn("iva", iva).withColumn("total", total)


def census(bed_states: DataFrame, att: DataFrame, pat_age: DataFrame, doctors: DataFrame, as_of: str) -> DataFrame:
    """Census per area: bed status, occupant, age, stay days, the occupant's doctors."""
    from ..functions.dates import days_between

    occ = att.select(F.col("id_atencion").alias("id_atencion_actual"), "Id_exp", "fecha_ing").join(
        pat_age.select("Id_exp", F.col("nombre").alias("paciente"), "edad"), "Id_exp", "left")
    docs = doctors.select(F.col("id_atencion").alias("id_atencion_actual"), "medicos")
    out = bed_states.select("area", "id_cama", "numero", "estado_cama", "id_atencion_actual") \
        .join(occ, "id_atencion_actual", "left").join(docs, "id_atencion_actual", "left")
    return out.withColumn("dias_estancia", days_between(F.col("fecha_ing"), F.lit(as_of).cast("date")))
