"""Binding of ``events`` as wide vital-sign rows: one reading per event, by event type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# sign column <- event type
SIGN_OF = {"fc": "click", "fr": "view", "temp": "signup", "spo2": "purchase", "ta_sis": "error"}
RANGES = {"fc": (60.0, 100.0), "fr": (12.0, 20.0), "temp": (36.1, 37.2), "spo2": (95.0, None), "ta_sis": (90.0, 140.0)}
# pressure as a text "systolic/diastolic": of an event of its type, with a diastolic part from its id
PRESSURES = {"ta": ((90.0, 140.0), (60.0, 90.0))}
SINGLE = {k: v for k, v in RANGES.items() if k != "ta_sis"}
TA_SQL = "CAST(CAST(FLOOR(ta_sis) AS BIGINT) AS STRING) || '/' || CAST(50 + id_signo % 60 AS STRING)"


def wide(signos: DataFrame) -> DataFrame:
    return signos.select(
        "id_signo", "fecha", "id_usuario",
        *[F.when(F.col("signo") == ev, F.col("valor")).alias(name) for name, ev in SIGN_OF.items()],
    )


def wide_sql() -> str:
    cols = ", ".join(f"CASE WHEN signo = '{ev}' THEN valor END AS {name}" for name, ev in SIGN_OF.items())
    return f"SELECT id_signo, fecha, id_usuario, {cols} FROM signos"


def with_pressure(signos: DataFrame) -> DataFrame:
    """The wide rows with the pressure as text."""
    return wide(signos).withColumn("ta", F.expr(TA_SQL))


def with_pressure_sql() -> str:
    return f"SELECT *, {TA_SQL} AS ta FROM ({wide_sql()})"
