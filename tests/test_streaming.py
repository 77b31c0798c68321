"""Streaming monitors: stream answer = batch answer on in-order rows; late rows are dropped."""

import datetime as dt

import pandas as pd

from vistaspark.sources.sinks import scratch_path
from vistaspark.streaming import monitors as X

RANGES = {"click": (60.0, 100.0)}


def _write(folder, name, rows):
    import os
    import time

    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    pdf["ts"] = pd.to_datetime(pdf["ts"])
    pdf.to_parquet(f"{folder}/{name}", index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
    stamp = time.time() + len(os.listdir(folder))  # files are taken in modification-time order
    os.utime(f"{folder}/{name}", (stamp, stamp))


def test_late_rows_are_dropped_after_watermark(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    _write(d, "events_1.parquet", [(1, t(10, 0), 1, "click", 120.0, "{}"), (2, t(10, 50), 1, "click", 70.0, "{}"),
                                   (3, t(12, 0), 2, "click", 50.0, "{}")])
    # Spark filters late rows with the watermark of the previous batch, so the late row comes
    # two batches after the one that moved the watermark to 12:00 - 30 min = 11:30 (> 11:00)
    _write(d, "events_2.parquet", [(6, t(12, 20), 2, "click", 99.0, "{}")])
    _write(d, "events_3.parquet", [(4, t(10, 10), 1, "click", 150.0, "{}"), (5, t(12, 10), 2, "click", 80.0, "{}")])
    base = scratch_path(spark, "late")
    ev = X.event_stream(spark, str(d), "events_*.parquet", files_per_trigger=1)
    X.run_to_changelog(X.alert_rate_stream(ev, RANGES, delay="30 minutes"), f"{base}/log", f"{base}/chk")
    out = {(r.inicio.hour, r.signo): (r.alertas, r.validos) for r in X.alert_rates_now(spark, f"{base}/log").collect()}
    assert out == {(10, "click"): (1, 2), (12, "click"): (1, 3)}


def test_duplicates_counted_once(spark, tmp_path):
    d = tmp_path / "in2"
    d.mkdir()
    t = dt.datetime(2024, 1, 1, 9, 0)
    _write(d, "events_1.parquet", [(1, t, 7, "view", 1.0, "{}"), (2, t, 7, "view", 1.0, "{}")])
    _write(d, "events_2.parquet", [(2, t, 7, "view", 1.0, "{}"), (3, t, 8, "view", 1.0, "{}")])
    base = scratch_path(spark, "dup")
    ev = X.event_stream(spark, str(d), "events_*.parquet", files_per_trigger=1)
    X.run_to_changelog(X.actions_per_user_stream(ev), f"{base}/log", f"{base}/chk")
    out = {r.id_usuario: r.acciones for r in X.current_state(spark, f"{base}/log", ["id_usuario"], ["acciones"]).collect()}
    assert out == {7: 2, 8: 1}


def _pending(spark, d, delay="1 hour", keep_ms=3_600_000):
    """(answer, ended query) of the pending monitor over the folder's files, one micro-batch each; a
    request is a user, its state and type come from event_type and props."""
    base = scratch_path(spark, "pending")
    ev = X.event_stream(X.stateful_session(spark), str(d), "events_*.parquet", files_per_trigger=1)
    changes = ev.selectExpr("user_id AS id_solicitud", "props AS tipo", "event_type AS estado", "ts", "event_id AS secuencia")
    q = X.run_to_change_log(X.pending_changes_stream(changes, delay=delay, keep_ms=keep_ms), f"{base}/log", f"{base}/chk")
    return {r.tipo: r.pendientes for r in X.pending_now(spark, f"{base}/log").collect()}, q


def test_pending_requests_equal_the_batch_answer(spark, tmp_path):
    """Shuffled, repeated and late changes over several micro-batches."""
    import random

    d = tmp_path / "in3"
    d.mkdir()
    draw = random.Random(3)
    at = lambda m: dt.datetime(2024, 1, 1, 9, 0) + dt.timedelta(minutes=m)
    rows = [(i, at(draw.randint(0, 55)), draw.randint(0, 30), draw.choice(["PENDIENTE", "REALIZADO", "CANCELADO"]), 0.0, draw.choice(["LAB", "IMG", None]))
            for i in range(300)]
    given = rows + draw.sample(rows, 60)
    draw.shuffle(given)
    for k in range(4):
        _write(d, f"events_{k}.parquet", given[k::4])
    newest = {}
    for r in rows:
        newest[r[2]] = max(newest.get(r[2], r), r, key=lambda x: (x[1], x[0]))
    want = {}
    for r in newest.values():
        if r[3] == "PENDIENTE":
            want[r[5]] = want.get(r[5], 0) + 1
    assert _pending(spark, d)[0] == want


def test_closed_requests_leave_the_state(spark, tmp_path):
    d = tmp_path / "in4"
    d.mkdir()
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    _write(d, "events_1.parquet", [(i, t(9), i, "PENDIENTE", 0.0, "LAB") for i in range(50)])
    _write(d, "events_2.parquet", [(100 + i, t(9, 10), i, "REALIZADO", 0.0, "LAB") for i in range(45)])
    _write(d, "events_3.parquet", [(200, t(14), 99, "PENDIENTE", 0.0, "IMG")])
    _write(d, "events_4.parquet", [(201, t(14, 5), 98, "PENDIENTE", 0.0, "IMG"), (202, t(9, 5), 3, "PENDIENTE", 0.0, "LAB")])  # the last one: too late
    _write(d, "events_5.parquet", [(203, t(14, 6), 0, "PENDIENTE", 0.0, "LAB")])  # a closed request is opened again
    got, q = _pending(spark, d)
    assert got == {"LAB": 6, "IMG": 2}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) >= 50 and held[-1] == 8, held  # 5 that were never closed, 2 and the one opened again
