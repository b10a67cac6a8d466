"""Streaming twins of the keyed folds: state for each key, drained with ``availableNow``."""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..operators.control import PID, Gains

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SequenceProcessor(StatefulProcessor):
    """Numbers each partition's items in order; the count lives in the state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values(["ts", "event_id"], kind="stable")
        n = self.count.get()[0] if self.count.exists() else 0
        self.count.update((n + len(pdf),))
        yield pd.DataFrame({"part": key[0], "event_id": pdf.event_id.values, "seq": range(n + 1, n + len(pdf) + 1)})

    def close(self) -> None:
        pass


class PIDProcessor(StatefulProcessor):
    """The clamped controller of each key; integral, last error and last time are its state."""

    def __init__(self, setpoint: float, gains: Gains):
        self.setpoint, self.gains = setpoint, gains

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("pid", StructType([StructField("i", DoubleType()), StructField("e", DoubleType()), StructField("us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values(["us", "event_id"], kind="stable")
        pid, last = PID(self.gains), None
        if self.kept.exists():
            pid.integral, pid.last_error, last = self.kept.get()
        out = []
        for r in pdf.itertuples(index=False):
            out.append(pid.step(self.setpoint - r.value, 0.0 if last is None else (r.us - last) / 1e6))
            last = r.us
        self.kept.update((float(pid.integral), float(pid.last_error), int(last)))
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf.event_id.values, "output": out})

    def close(self) -> None:
        pass


class RouteProcessor(StatefulProcessor):
    """The last client of each target; responses before any request have none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.client = handle.getValueState("client", StructType([StructField("c", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values(["ts", "event_id"], kind="stable")
        client = self.client.get()[0] if self.client.exists() else None
        out = []
        for r in pdf.itertuples(index=False):
            if r.direction == "request":
                client = r.src
            else:
                out.append((key[0], r.event_id, client))
        if client is not None:
            self.client.update((str(client),))
        yield pd.DataFrame(out, columns=["target", "event_id", "client"])

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def sequence_stream(stream: DataFrame) -> DataFrame:
    """(part, event_id, seq) of a stream with part, ts, event_id."""
    return _stateful(stream, "part", SequenceProcessor(), "part int, event_id long, seq long")


def pid_stream(stream: DataFrame, setpoint: float, gains: Gains) -> DataFrame:
    """(user_id, event_id, output) of a stream with user_id, event_id, us (microseconds), value."""
    return _stateful(stream, "user_id", PIDProcessor(setpoint, gains), "user_id long, event_id long, output double")


def route_stream(stream: DataFrame) -> DataFrame:
    """(target, event_id, client) of a stream with target, direction, src, ts, event_id."""
    return _stateful(stream, "target", RouteProcessor(), "target long, event_id long, client string")


def window_counts(stream: DataFrame, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Events of each type in tumbling windows, with a watermark for late data."""
    t = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return t.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def drain(result: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Run to the end of what is there into the memory table ``name``, then stop."""
    q = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drain_to(result: DataFrame, path: str, checkpoint: str) -> None:
    """Run to the end of what is there into Parquet files under ``path``, then stop; exactly once by the checkpoint."""
    result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """The state store that keyed state needs and, meanwhile, how many partitions the state has."""
    keys = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
