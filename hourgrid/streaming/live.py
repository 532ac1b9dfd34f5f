"""Live-sensor steps on streams (ST1-ST4): the same rules as their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hourgrid import schemas
from hourgrid.functions import columns as C
from hourgrid.functions.series import nowcast_value

HOUR_MS = 3_600_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_stream(spark: SparkSession, folder: str, name: str = "*.parquet") -> DataFrame:
    """Landed reading files as a stream."""
    rows = spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what has landed and stop; a restart goes on from the checkpoint.  The file sink
    commits each batch once, and the result is read from the shared folder, not the driver."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
                   .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def hourly_means(stream: DataFrame, lateness: str = "2 hours", keys: tuple[str, ...] = ("sensor_id",), value: str = "value") -> DataFrame:
    """ST1: mean per sensor and clock hour, final once the watermark passes the hour."""
    agg = (stream.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), *keys)
                 .agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n")))
    return agg.select(*keys, F.col("window.start").alias("ts"), value, "n")


def clean_on_arrival(stream: DataFrame, stats: DataFrame, extent: C.Extent, floor: float = 1.0, cap: float = 300.0,
                     limit: float = 3.0, key: str = "sensor_id", value: str = "value") -> DataFrame:
    """ST2: extent, sign, floor, outlier and cap rules; the per-sensor mean and deviation come from
    a static table that a batch job refreshes."""
    inside = stream.where(C.in_extent(extent))
    v = C.floor_low(C.negative_to_null(value), floor)
    rows = inside.withColumn(value, v).join(stats.select(key, F.col("mean").alias("_m"), F.col("std").alias("_s")), key, "left")
    far = F.coalesce(F.abs(F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)) > limit, F.lit(False))
    kept = F.when(~far, F.col(value))
    return rows.withColumn(value, kept).withColumn(value, C.cap_to_null(value, cap)).drop("_m", "_s")


def _rows(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["sensor_id", "ts", "carried", "nowcast"])
    return frame.astype({"sensor_id": "int64", "ts": "datetime64[ns]", "carried": "float64", "nowcast": "float64"})


class CarryAndNowcast(StatefulProcessor):
    """Hourly sums of the recent readings per sensor; one output row per finished hour.

    A sensor without a reading for ``silence`` hours is forgotten until it reports again; the batch
    twin of the carried value (T8) has no such end.
    """

    WINDOW = 12         # hours of a NowCast

    def __init__(self, silence: int = 12):
        self.silence = max(silence, self.WINDOW)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour bigint", "total double, n bigint")
        self.clock = handle.getValueState("clock", "first bigint, next bigint, carried double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        low = None
        for pdf in rows:
            hour = pdf["ts"].astype("datetime64[ns]").astype("int64") // (HOUR_MS * 1_000_000)
            for h, part in pdf["value"].groupby(hour):
                h, total, n = int(h), float(part.sum()), int(part.count())
                if self.hours.containsKey((h,)):
                    old = self.hours.getValue((h,))
                    total, n = total + old[0], n + old[1]
                self.hours.updateValue((h,), (total, n))
                low = h if low is None else min(low, h)
        if low is not None:
            state = self.clock.get() if self.clock.exists() else None
            if state is None or low < state[1] == state[0]:
                # Nothing emitted yet: the session starts at its earliest hour.
                self._wait(low, low, None)
        yield _rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.clock.exists():
            mark = timerValues.getCurrentWatermarkInMs()
            first, hour, carried = self.clock.get()
            held = {k[0]: v[0] / v[1] for k, v in self.hours.iterator() if v[1]}
            while (hour + 1) * HOUR_MS <= mark:
                window = [held.get(h) for h in range(max(first, hour - self.WINDOW + 1), hour + 1)]
                if all(held.get(h) is None for h in range(max(first, hour - self.silence + 1), hour + 1)):
                    later = [h for h in held if h > hour]
                    if not later:
                        self._forget(held)
                        hour = None
                        break
                    first = hour = min(later)
                    carried = None
                    continue
                carried = carried if window[-1] is None else window[-1]
                out.append((key[0], pd.Timestamp(hour * HOUR_MS, unit="ms"), carried, nowcast_value(window, self.WINDOW)))
                hour += 1
            if hour is not None:
                for h in held:
                    if h <= hour - self.silence:
                        self.hours.removeKey((h,))
                self._wait(first, hour, carried)
        yield _rows(out)

    def close(self) -> None:
        pass

    def _wait(self, first: int, hour: int, carried: float | None) -> None:
        self.clock.update((first, hour, carried))
        self.handle.registerTimer((hour + 1) * HOUR_MS)

    def _forget(self, held) -> None:
        for h in held:
            self.hours.removeKey((h,))
        self.clock.clear()


def carry_and_nowcast(stream: DataFrame, lateness: str = "2 hours", silence: int = 12) -> DataFrame:
    """ST3: last value carried forward and NowCast per sensor and finished hour.

    After ``silence`` hours without a reading a sensor's rows end until it reports again.  The state needs the RocksDB state store, see ``use_rocksdb``.
    """
    rows = stream.withWatermark("ts", lateness).select("sensor_id", "ts", "value")
    return rows.groupBy("sensor_id").transformWithStateInPandas(
        CarryAndNowcast(silence), "sensor_id bigint, ts timestamp, carried double, nowcast double", "append", "EventTime")


class use_rocksdb:
    """Select the RocksDB state store for the queries started inside the block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_):
        if self.before is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.before)


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str = "event_id", lateness: str = "2 hours") -> DataFrame:
    """ST4: deduplicated append.  Every batch overwrites its own folder, so a replayed batch after a
    failure leaves no second copy."""
    unique = stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = unique.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
