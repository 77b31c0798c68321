"""Table-changing batch jobs (B1-B12), re-aimed from per-request writes.

Each job is a pure function from the current tables (and a change set) to the new table
state(s); persisting them is a separate ``overwrite`` write, so a retried job gives the
same result (run twice = run once). Keys are matched with joins, never driver loops.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ._common import as_list, dense_index, money_sum


def upsert(target: DataFrame, updates: DataFrame, key, protected: Sequence[str] = ()) -> DataFrame:
    """New table = target with ``updates`` applied by key (full outer join).

    Non-key columns take the update's value when it has the row (``coalesce(new, old)``);
    ``protected`` columns keep the target's value when the target has the row (an id, a first
    date). Rows only in ``updates`` are inserted.
    """
    keys = as_list(key)
    cols = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_in_t"))
    u = updates.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols if c in updates.columns],
                       F.lit(True).alias("_in_u"))
    j = t.join(u, keys, "full_outer")
    out = []
    for c in cols:
        old, new = F.col(f"_o_{c}"), (F.col(f"_n_{c}") if c in updates.columns else F.lit(None))
        if c in protected:
            out.append(F.when(F.col("_in_t").isNotNull(), old).otherwise(new).alias(c))
        else:
            out.append(F.when(F.col("_in_u").isNotNull(), F.coalesce(new, old)).otherwise(old).alias(c))
    return j.select(*keys, *out)


def close_accounts(att: DataFrame, beds: DataFrame, charges: DataFrame, ids: DataFrame, as_of: str,
                   occupants: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """B2: close the attentions in ``ids``: (attentions with status CERRADA, new discharge rows
    with the account total, beds freed when their occupant is closed)."""
    k = ids.select("id_atencion").distinct().withColumn("_close", F.lit(True))
    a = att.join(k, "id_atencion", "left").withColumn(
        "status", F.when(F.col("_close"), F.lit("CERRADA")).otherwise(F.col("status"))).drop("_close")
    totals = charges.groupBy("id_atencion").agg(money_sum("subtotal").alias("total_cuenta"))
    discharges = (att.join(k, "id_atencion").select("id_atencion", "Id_exp")
                  .join(totals, "id_atencion", "left")
                  .select("Id_exp", "id_atencion", F.lit(as_of).cast("date").alias("fecha_alta"),
                          F.coalesce("total_cuenta", F.lit(0).cast("decimal(38,2)")).alias("total_cuenta")))
    freed = occupants.join(k.withColumnRenamed("id_atencion", "id_atencion_actual"), "id_atencion_actual").select(
        "id_cama").distinct().withColumn("_free", F.lit(True))
    b = beds.join(freed, "id_cama", "left").withColumn(
        "ocupada", F.when(F.col("_free"), F.lit(0)).otherwise(F.col("ocupada"))).drop("_free")
    return a, discharges, b


def apply_results(det: DataFrame, results: DataFrame, keys: Sequence[str] = ("id_atencion", "id_catalogo")) -> DataFrame:
    """Mark the detail rows that have a result REALIZADO, with its date and files."""
    r = results.select(*keys, "fecha_resultado", "archivo_resultado").withColumn("_hit", F.lit(True))
    j = det.join(r, list(keys), "left")
    return j.withColumn("estado", F.when(F.col("_hit"), F.lit("REALIZADO")).otherwise(F.col("estado"))).withColumn(
        "fecha_realizado", F.when(F.col("_hit"), F.col("fecha_resultado"))).drop("_hit", "fecha_resultado")


def assign_ids(df: DataFrame, current_max: Column, order: Sequence, name: str = "nuevo_id") -> DataFrame:
    """Dense ids after the current maximum, in a total order (distributed numbering)."""
    return dense_index(df, order, start=current_max + 1, index_name=name)


def append_log(df: DataFrame, path: str, batch_id: int) -> None:
    """Append audit rows (filtered beforehand, F17) to the log table, one folder per batch:
    a retried or replayed batch overwrites its own folder instead of appending twice."""
    df.write.mode("overwrite").parquet(f"{path}/lote={batch_id}")


def repair_dates(df: DataFrame, cols: Sequence[str], as_date: bool = True) -> DataFrame:
    """Re-type text dates in the listed columns (T5 layouts); unparseable -> null."""
    from ..functions.dates import parse_ts

    out = df
    for c in cols:
        ts = parse_ts(F.col(c))
        out = out.withColumn(c, F.to_date(ts) if as_date else ts)
    return out


def delete_where(details: DataFrame, headers: DataFrame, doomed: Column, key: str = "id_atencion"
                 ) -> tuple[DataFrame, DataFrame]:
    """Delete detail lines for which ``doomed`` is true (null: kept); delete a header only when
    it had lines and none remains (headers without lines at all are kept). The predicate needs no
    join; what is left of each header is one partial aggregate."""
    kept = ~F.coalesce(doomed, F.lit(False))
    emptied = details.groupBy(key).agg(F.max(kept).alias("_left")).where("not _left").select(key)
    return details.where(kept), headers.join(emptied, key, "left_anti")


def admit(requests: DataFrame, free_beds: DataFrame, current_max: Column, as_of: str, order: Sequence[str],
          bed_order: Sequence[str] = ("id_cama",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bulk admission: new attention ids after the current maximum; the n-th request (in
    ``order``) takes the n-th free bed (in ``bed_order``); up to five non-blank doctors each.

    Returns (new attentions, doctor rows, beds taken). Both sides are numbered with a
    distributed dense index and matched by an equi-join on it (no cross join).
    """
    req = dense_index(requests, order, start=1, index_name="_n")
    beds = dense_index(free_beds.select(*bed_order), list(bed_order), start=1, index_name="_n")
    j = req.join(beds, "_n", "left")
    att = j.select((current_max + F.col("_n")).cast("long").alias("id_atencion"), "Id_exp",
                   F.lit("ABIERTA").alias("status"), F.lit(as_of).cast("date").alias("fecha_ing"), "id_cama")
    docs = (req.select((current_max + F.col("_n")).cast("long").alias("id_atencion"),
                       F.explode(F.slice(F.filter("medicos", lambda x: x.isNotNull() & (F.trim(x.cast("string")) != "")),
                                         1, 5)).alias("id_medico")))
    taken = att.filter(F.col("id_cama").isNotNull()).select("id_cama", F.lit(1).alias("ocupada"))
    return att, docs, taken


def admit_all(requests: DataFrame, free_beds: DataFrame, last_patient: int, last_attention: int, as_of: str, order: Sequence[str],
              bed_order: Sequence[str] = ("id_cama",)) -> dict[str, DataFrame]:
    """B9 in full: ``requests`` (patient columns, especialidad, medicos array, fam_nombre, parentesco, telefono)
    -> the rows of ``pacientes``, ``familiares``, ``atencion``, ``atencion_medicos`` and ``camas``.

    The n-th request (in ``order``) becomes the n-th patient and attention after the last ones and takes
    the n-th free bed, if there is one. Requests and beds are numbered once and their join is written
    (when this is called), so all five outputs have the same numbers, whatever is recomputed."""
    req = dense_index(requests, order, start=1, index_name="_n")
    beds = dense_index(free_beds.select(*bed_order), list(bed_order), start=1, index_name="_n")
    spark = requests.sparkSession
    j = req.join(beds, "_n", "left").withColumns({"Id_exp": F.col("_n") + F.lit(last_patient), "id_atencion": F.col("_n") + F.lit(last_attention)})
    path = f"{checkpoint_dir(spark).rstrip('/')}/admit-{uuid.uuid4().hex[:12]}"
    j.write.parquet(path)
    j = spark.read.schema(j.schema).parquet(path)
    own = {"_n", "id_atencion", "especialidad", "medicos", "fam_nombre", "parentesco", "telefono", *bed_order}
    doctors = F.slice(F.filter("medicos", lambda x: x.isNotNull() & (F.trim(x.cast("string")) != "")), 1, 5)
    return {
        "pacientes": j.select("Id_exp", *[c for c in j.columns if c not in own and c != "Id_exp"]),
        "familiares": j.select("Id_exp", F.col("fam_nombre").alias("nombre"), "parentesco", "telefono"),
        "atencion": j.select("id_atencion", "Id_exp", *bed_order, "especialidad", F.lit(as_of).cast("date").alias("fecha_ing"),
                             F.lit("ABIERTA").alias("status")),
        "atencion_medicos": j.select("id_atencion", F.explode(doctors).alias("id_medico")),
        "camas": j.filter(F.col(bed_order[0]).isNotNull()).select(*bed_order, F.lit(1).alias("ocupada")),
    }


def reassign(att_doctors: DataFrame, changes: DataFrame, key: str = "id_atencion") -> DataFrame:
    """Replace the doctors of the attentions named in ``changes`` (anti join + union)."""
    kept = att_doctors.join(changes.select(key).distinct(), key, "left_anti")
    return kept.unionByName(changes.select(*att_doctors.columns))


def bed_moves(beds: DataFrame, moves: DataFrame) -> DataFrame:
    """Apply a (free, take) change set to the bed flags: freed beds -> 0, taken -> 1."""
    free = moves.select(F.col("cama_anterior").alias("id_cama")).withColumn("_v", F.lit(0))
    take = moves.select(F.col("cama_nueva").alias("id_cama")).withColumn("_v", F.lit(1))
    change = free.unionByName(take).groupBy("id_cama").agg(F.max("_v").alias("_v"))  # take wins over free
    return beds.join(change, "id_cama", "left").withColumn("ocupada", F.coalesce("_v", "ocupada")).drop("_v")


def insert_absent(target: DataFrame, rows: DataFrame, key) -> DataFrame:
    """Insert only rows whose key is not in the target."""
    return target.unionByName(rows.join(target.select(*as_list(key)), as_list(key), "left_anti"))


def delete_unused(target: DataFrame, used: DataFrame, key: str, used_key: str | None = None) -> DataFrame:
    """Delete only rows not referenced by ``used`` (e.g. by an open attention)."""
    u = used.select(F.col(used_key or key).alias(key)).filter(F.col(key).isNotNull())
    return target.join(u, key, "left_semi")


def keep_unused_deletions(target: DataFrame, doomed: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Delete the ``doomed`` keys except those still in use."""
    really = doomed.select(key).join(used.select(key), key, "left_anti")
    return target.join(really, key, "left_anti")
