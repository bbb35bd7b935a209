"""Run logs as they grow: listings, phases and counts over Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewright.sources import tables
from tracewright.sources.logs import merged
from tracewright.streaming import appended

RECORD = "session string, seq long, ts timestamp, label string, phase_class string"


def records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of appended JSON lines; broken and partial lines are dropped."""
    return spark.readStream.text(path).select(F.from_json("value", schema).alias("j")).where("j is not null and j.session is not null").select("j.*")


def appended_records(spark: SparkSession, path: str, schema: str = RECORD, *, suffix: str = "") -> DataFrame:
    """Records of JSON lines that are appended to files: a line counts once it is whole; broken ones are dropped."""
    return appended.lines(spark, path, suffix=suffix).select(F.from_json("value", schema).alias("j")).where("j is not null and j.session is not null").select("j.*")


def running_listing(stream: DataFrame) -> DataFrame:
    """session, records, last_ts, title: for update mode."""
    return stream.groupBy("session").agg(F.count("*").alias("records"), F.max("ts").alias("last_ts"), F.min_by("label", "seq").alias("title"))


def phase_counts(stream: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """start, phase_class, n over tumbling windows of event time."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "phase_class").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "phase_class", "n")


def session_windows(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """session, start, end, n of stretches without a gap."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session").agg(F.count("*").alias("n"))
    return w.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Phases(StatefulProcessor):
    """Each session's state: whether it has patched, the last place seen, and the label there. Rows at or behind that
    place, and rows without one, come out as late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "patched boolean, seq long, label string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else (False, -1, None)
        out, state = told(pd.concat([r[["seq", "label", "phase_class"]] for r in rows]), *state)
        self.state.update(state)
        out.insert(0, "session", key[0])
        yield out

    def close(self) -> None:
        pass


def told(rows: pd.DataFrame, patched: bool, last: int, label: str | None) -> tuple[pd.DataFrame, tuple]:
    """seq, phase, late and the label before each row, and the state after them."""
    v = rows.sort_values("seq", kind="stable", ignore_index=True)
    late = (v.seq.isna() | (v.seq <= last) | v.seq.duplicated()).to_numpy(bool)
    on = v[~late]
    before = (on.phase_class == "patch").cummax().shift(fill_value=False).to_numpy(bool) | bool(patched)
    own = on.phase_class.to_numpy()
    phase = np.where(own == "ctx", np.where(before, "validation", "localization"), np.where(own == "loc", "localization", own))
    out = pd.DataFrame({"seq": v.seq.astype("Int64"), "phase": None, "late": late, "prev_label": None})
    out.loc[~late, "phase"] = phase
    out.loc[~late, "prev_label"] = on.label.shift(fill_value=label).to_numpy()
    if len(on):
        patched, last, label = bool(patched or (own == "patch").any()), int(on.seq.iloc[-1]), on.label.iloc[-1]
    return out, (bool(patched), int(last), label)


def running_phases(stream: DataFrame) -> DataFrame:
    """session, seq, phase, late, prev_label: needs the RocksDB state store."""
    return stream.groupBy("session").transformWithStateInPandas(statefulProcessor=Phases(), outputStructType="session string, seq long, phase string, late boolean, prev_label string", outputMode="Append", timeMode="None")


def upsert(spark: SparkSession, path: str):
    """For foreachBatch: merges each batch of a listing into version files below path, each batch written once, so that one
    that runs again gives the same. A batch whose version before is missing, though others are there, is an error."""

    def found(where: str) -> DataFrame | None:
        try:
            return spark.read.parquet(where)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def write(batch: DataFrame, number: int) -> None:
        old = found(f"{path}/v={number - 1}")
        if old is None:
            if found(f"{path}/v=*") is not None and found(f"{path}/v={number}") is None:
                raise RuntimeError(f"version {number - 1} is missing below {path}: batch {number} has nothing to go on from")
            old = batch.limit(0)
        merged(old, batch, "session").write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def keyed_upsert(spark: SparkSession, path: str, key: str = "session", *, buckets: int = 256):
    """For foreachBatch: merges each batch of a listing into the table at `path` (tables.merge), exactly once: a batch that
    runs again, or that broke off, gives the same table."""

    def write(batch: DataFrame, number: int) -> None:
        tables.merge(spark, path, batch, key, number, buckets=buckets)

    return write


def drained(listing: DataFrame) -> DataFrame:
    """The result of an aggregate over all that its source holds now, as a table in the shared folder."""
    spark = listing.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tracewright-")
    base = f"{root.rstrip('/')}/tracewright-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    listing.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(listing.schema).parquet(f"{base}/out")
