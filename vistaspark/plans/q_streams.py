"""Driver bindings for the streaming monitors.

Each binding runs the Structured Streaming query over the ``events`` parquet file of the
scale-factor folder (``availableNow``), into a changelog under the session's checkpoint
folder, and returns the current answer read back from it. On data that arrives in order
the stream's answer equals the batch answer, which is what the DuckDB twin states.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.sinks import scratch_path
from ..streaming import monitors as X
from . import vitals
from .registry import query
from .sqlkit import pct

# sign ranges keyed by event type (binding of events as vital signs)
EVENT_RANGES = {ev: vitals.RANGES[name] for name, ev in vitals.SIGN_OF.items()}


def _cond_sql() -> str:
    parts = []
    for ev, (lo, hi) in EVENT_RANGES.items():
        side = []
        if lo is not None:
            side.append(f"value < {lo}")
        if hi is not None:
            side.append(f"value > {hi}")
        parts.append(f"(event_type = '{ev}' AND ({' OR '.join(side)}))")
    return "COALESCE(" + " OR ".join(parts) + ", FALSE)"


@query("x1_alert_rate_stream", sql=f"""
WITH g AS (SELECT date_trunc('hour', ts) AS inicio, event_type AS signo,
                  COUNT(*) FILTER (WHERE {_cond_sql()}) AS alertas, COUNT(value) AS validos
           FROM events GROUP BY 1, 2)
SELECT inicio, signo, alertas, validos, {pct('alertas', 'validos')} AS porcentaje FROM g
""")
def x1(t):
    base = scratch_path(t.spark, "x1")
    events = X.event_stream(t.spark, t.root, "events.parquet")
    X.run_to_changelog(X.alert_rate_stream(events, EVENT_RANGES), f"{base}/log", f"{base}/chk")
    return X.alert_rates_now(t.spark, f"{base}/log")


@query("x2_actions_per_user_stream", sql="""
SELECT user_id AS id_usuario, COUNT(DISTINCT event_id) AS acciones, MAX(ts) AS ultima FROM events GROUP BY user_id
""")
def x2(t):
    base = scratch_path(t.spark, "x2")
    events = X.event_stream(t.spark, t.root, "events.parquet")
    X.run_to_changelog(X.actions_per_user_stream(events), f"{base}/log", f"{base}/chk")
    return X.current_state(t.spark, f"{base}/log", ["id_usuario"], ["acciones", "ultima"])


# X2 pending requests: each user is a request whose events are its state changes; the type is the user's group
STATES = {"purchase": "REALIZADO", "error": "CANCELADO"}
GROUPS = 7


def request_changes(events):
    """The event stream as state changes of requests."""
    estado = F.lit("PENDIENTE")
    for kind, state in STATES.items():
        estado = F.when(F.col("event_type") == kind, state).otherwise(estado)
    return events.select(F.col("user_id").alias("id_solicitud"), F.concat(F.lit("tipo "), (F.col("user_id") % GROUPS).cast("string")).alias("tipo"),
                         estado.alias("estado"), "ts", F.col("event_id").alias("secuencia"))


@query("x2_pending_per_type_stream", sql=f"""
WITH ultimo AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS ultimo FROM events GROUP BY user_id)
SELECT 'tipo ' || CAST(user_id % {GROUPS} AS VARCHAR) AS tipo, COUNT(*) AS pendientes
FROM ultimo WHERE ultimo NOT IN ({', '.join(f"'{k}'" for k in STATES)}) GROUP BY 1
""")
def x2_pending(t):
    base = scratch_path(t.spark, "x2-pending")
    events = X.event_stream(X.stateful_session(t.spark), t.root, "events.parquet")
    X.run_to_change_log(X.pending_changes_stream(request_changes(events)), f"{base}/log", f"{base}/chk")
    return X.pending_now(t.spark, f"{base}/log")
