"""S8 copies: replayed chains equal the tables as they were, also with deletes, late stamps and new tables."""

import datetime as dt

import pytest

from vistaspark.sources.backups import DIFFERENTIAL, FULL, INCREMENTAL, BackupStore, Source
from vistaspark.sources.sinks import scratch_path

DAY = [dt.datetime(2024, 1, d) for d in range(1, 9)]
SCHEMA = "id long, parte string, valor double, updated_at timestamp_ntz"


def source(spark, rows):
    return Source(spark.createDataFrame([(*k, v, ts) for k, (v, ts) in rows.items()], SCHEMA), ["id", "parte"], "updated_at")


def contents(df):
    return sorted((r.id, r.parte, r.valor, r.updated_at) for r in df.collect())


def test_full_plus_deltas_are_the_tables_as_they_were(spark):
    store = BackupStore(spark, scratch_path(spark, "copies"))
    rows = {(i, p): (float(i), DAY[0]) for i in range(20) for p in "ab"}
    states = {}

    def take(kind, day):
        version = store.copy({"t": source(spark, rows)}, kind, DAY[day])
        states[version] = sorted((*k, v, ts) for k, (v, ts) in rows.items())
        return version

    take(FULL, 0)
    rows |= {(3, "a"): (33.0, DAY[1]), (50, "a"): (1.0, DAY[1]), (51, "a"): (2.0, dt.datetime(2020, 1, 1))}  # the last one: new, stamped long ago
    del rows[4, "b"]
    take(INCREMENTAL, 1)
    rows |= {(4, "b"): (44.0, DAY[2]), (3, "a"): (34.0, DAY[2]), (60, "b"): (None, None)}  # comes back; again; never stamped
    del rows[50, "a"], rows[5, "a"]
    take(INCREMENTAL, 2)
    take(INCREMENTAL, 3)  # nothing changed but the row without a stamp, which is always taken
    rows |= {(5, "a"): (5.5, DAY[4])}
    differential = take(DIFFERENTIAL, 4)
    rows |= {(7, "a"): (7.5, DAY[5])}
    take(INCREMENTAL, 5)  # based on the differential copy
    for version, state in states.items():
        assert contents(store.restore("t", version)) == state, version
    assert contents(store.restore("t")) == states[6]
    control = {r.version: r for r in store.control().collect()}
    assert [(control[v].tipo, control[v].base, control[v].filas, control[v].bajas) for v in sorted(control)] == [
        (FULL, None, 40, 0), (INCREMENTAL, 1, 3, 1), (INCREMENTAL, 2, 3, 2), (INCREMENTAL, 3, 1, 0), (DIFFERENTIAL, 1, 5, 0), (INCREMENTAL, 5, 2, 0)]
    deltas = store.delta_rows("t", differential).collect()
    assert sorted((r.id, r.parte, r._op) for r in deltas) == [(3, "a", "U"), (4, "b", "U"), (5, "a", "U"), (51, "a", "U"), (60, "b", "U")]
    assert control[4].desde == DAY[2] and control[5].desde == DAY[0]


def test_a_copy_that_died_is_not_there_and_is_run_again(spark):
    store = BackupStore(spark, scratch_path(spark, "copies"))
    one = source(spark, {(1, "a"): (1.0, DAY[0])})
    store.copy({"t": one}, FULL, DAY[0])
    store._write("t", source(spark, {(9, "z"): (0.0, DAY[1])}), 2, None, {})  # data without control rows
    assert contents(store.restore("t")) == [(1, "a", 1.0, DAY[0])]
    assert store.copy({"t": source(spark, {(2, "a"): (2.0, DAY[1])})}, INCREMENTAL, DAY[1]) == 2
    assert contents(store.restore("t")) == [(2, "a", 2.0, DAY[1])]


def test_first_delta_takes_everything_and_new_tables_join_later(spark):
    store = BackupStore(spark, scratch_path(spark, "copies"))
    a, none = source(spark, {(1, "a"): (1.0, DAY[0])}), source(spark, {})
    store.copy({"a": a}, INCREMENTAL, DAY[0])
    store.copy({"a": none, "b": a}, INCREMENTAL, DAY[1])
    assert contents(store.restore("a", 1)) == contents(store.restore("b")) == [(1, "a", 1.0, DAY[0])]
    assert contents(store.restore("a")) == []
    with pytest.raises(ValueError, match="not in copy 1"):
        store.restore("b", 1)
    with pytest.raises(ValueError, match="unknown kind"):
        store.copy({"a": a}, "total", DAY[2])
