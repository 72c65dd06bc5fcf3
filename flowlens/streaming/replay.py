"""Replay of stored transfers as a stream: micro-batches, alerts, window status, stateful detection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.drift import Adwin, PageHinkley, Patience, status
from ..session import scratch_path


def read_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of a folder, a few to each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def replay(stream: DataFrame, history: DataFrame, sink: str, checkpoint: str, threshold: float, look_back: int = 96 * 3600, on_batch: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write the alerts of each micro-batch; ``on_batch`` gets them with the scored history of the last ``look_back`` seconds.

    The batch number is part of the path, so a repeated batch overwrites its
    own output.
    """

    def handle(batch: DataFrame, number: int) -> None:
        span = batch.agg(F.min("t"), F.max("t")).first()
        alerts = batch.where(F.col("score") >= threshold)
        if on_batch is not None and span[0] is not None:
            recent = history.where((F.col("t") < span[1]) & (F.col("t") >= span[0] - look_back))
            alerts = on_batch(alerts, recent)
        alerts.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, hours: int = 6, late: str = "1 hour") -> DataFrame:
    """Transfers, mean score and alerts by tumbling window; the watermark is this engine's addition."""
    timed = stream.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{hours} hours")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))


def with_status(windows: DataFrame, warn: float, drift: float) -> DataFrame:
    return windows.withColumn("status", status(F.col("mean_score"), warn, drift))


class DetectorProcessor(StatefulProcessor):
    """Carries a detector's numbers across micro-batches for every stream key; puts out the alarms."""

    def __init__(self, make: Callable[[], PageHinkley | Adwin | Patience]):
        self.make = make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("detector", "x double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        detector = self.make()
        before = [float(x) for (x,) in self.state.get()] if self.state.exists() else []
        if before:
            detector.state = before
        values = pd.concat(list(rows)).sort_values("i")
        alarms = values[[detector.update(float(x)) for x in values["x"]]]
        after = [float(x) for x in detector.state]
        if before and after[: len(before)] == before:  # a window that only grew
            if len(after) > len(before):
                self.state.appendList([(x,) for x in after[len(before) :]])
        elif after:
            self.state.put([(x,) for x in after])
        else:
            self.state.clear()
        yield pd.DataFrame({"stream": key[0], "i": alarms["i"].astype("int64"), "x": alarms["x"].astype("float64")})

    def close(self) -> None:
        pass


def detect_stream(values: DataFrame, make: Callable[[], PageHinkley | Adwin | Patience] | None = None, **options: object) -> DataFrame:
    """Alarms (stream, i, x) of a keyed stream of values, by ``make`` or else Page-Hinkley with ``options``; needs the RocksDB state store.

    Values come in order of i from batch to batch; within one they are sorted.
    """
    made = make or (lambda: PageHinkley(**options))
    return values.groupBy("stream").transformWithStateInPandas(DetectorProcessor(made), "stream string, i long, x double", "Append", "None")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_through(made: Callable[[DataFrame], DataFrame], rows: DataFrame, name: str) -> DataFrame:
    """``made`` applied to ``rows`` as a stream until all is read; its output as a table in the shared folder."""
    spark = rows.sparkSession
    folder = scratch_path(spark, name)
    rows.write.parquet(f"{folder}/in")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = made(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
