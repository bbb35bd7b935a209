"""Running phases and versions of a listing."""

import pandas as pd
import pytest

from tracewright.streaming import sessions


def chunk(*rows):
    return pd.DataFrame(rows, columns=["seq", "label", "phase_class"])


def test_phases_go_on_from_their_state():
    out, state = sessions.told(chunk((2, "c", "patch"), (0, "a", "ctx"), (1, "b", "loc"), (None, "x", "ctx"), (1, "again", "loc")), False, -1, None)
    assert [(None if pd.isna(r.seq) else r.seq, r.phase, r.late, r.prev_label) for r in out.itertuples()] == [(0, "localization", False, None), (1, "localization", False, "a"), (1, None, True, None), (2, "patch", False, "b"), (None, None, True, None)]
    assert state == (True, 2, "c")
    out, state = sessions.told(chunk((1, "old", "ctx"), (3, "d", "ctx"), (4, "e", "general")), *state)
    assert [(r.phase, r.late, r.prev_label) for r in out.itertuples()] == [(None, True, None), ("validation", False, "c"), ("general", False, "d")]
    assert sessions.told(chunk((1, "old", "ctx")), *state)[1] == (True, 4, "e")


def test_running_phases_over_two_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    one = [("s", 0, None, "a", "ctx"), ("s", 1, None, "b", "patch"), ("u", 0, None, "a", "ctx")]
    two = [("s", 2, None, "c", "ctx"), ("s", 0, None, "late", "ctx"), ("u", 1, None, "d", "ctx")]
    found = []
    for k, rows in enumerate((one, two)):
        spark.createDataFrame(rows, sessions.RECORD).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = sessions.running_phases(sessions.records(spark, f"{tmp_path}/in"))
        take = lambda batch, number: found.extend((r.session, r.seq, r.phase, r.late) for r in batch.collect())
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    assert set(found) == {("s", 0, "localization", False), ("s", 0, None, True), ("s", 1, "patch", False), ("s", 2, "validation", False), ("u", 0, "localization", False), ("u", 1, "localization", False)}


def test_a_missing_version_is_an_error(spark, tmp_path):
    f = spark.createDataFrame([("a", 1)], "session string, n long")
    write = sessions.upsert(spark, f"{tmp_path}/up")
    write(f, 0)
    write(f.selectExpr("'b' session", "2L n"), 1)
    write(f.selectExpr("'b' session", "2L n"), 1)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/up/v=1").collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(RuntimeError):
        write(f, 5)
