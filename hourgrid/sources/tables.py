"""Series tables: save, load, accept, resume (IO11-IO15, IO19, IO21)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hourgrid.functions.columns import ntz
from hourgrid.session import checkpoint_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


MONTHS, CHUNKS = ("channel", "month"), ("chunk",)


def _commit(rows: DataFrame, path: str, keys: Sequence[str], ts: str) -> None:
    """Write ``rows`` as a run of its own, then one state row for each of its parts.

    The state is taken from the files just written and appended last: a part counts as stored when its state row
    is there, so a run that died half way changes nothing, and a part keeps its former run until then.
    """
    spark, run = rows.sparkSession, f"r{uuid.uuid4().hex}"
    rows.write.partitionBy(*keys).parquet(f"{path}/run={run}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/run={run}")
    digest = F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(20,0)"))
    state = written.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.sort_array(F.collect_set(F.date_trunc("HOUR", ts).cast("timestamp_ntz"))).alias("hours"), digest.alias("digest"))
    state.withColumn("run", F.lit(run)).withColumn("saved", F.lit(time.time_ns())).write.mode("append").parquet(f"{path}_state")


def _state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The state row of the last run of every part."""
    rows = spark.read.parquet(f"{path}_state")
    last = F.max_by(F.struct("n_rows", "first_ts", "last_ts", "hours", "digest", "run"), F.struct("saved", "run"))
    return rows.groupBy(*keys).agg(last.alias("s")).select(*keys, "s.*")


def _stored(spark: SparkSession, path: str, keys: Sequence[str], parts: DataFrame) -> DataFrame:
    """Rows of the current run of ``parts`` (state rows); the join prunes folders, keys keep the type they were saved with."""
    rows = spark.read.parquet(path).withColumns({f"_{k}": F.col(k).cast("string") for k in keys}).drop(*keys)
    parts = parts.select("run", *keys, *[F.col(k).cast("string").alias(f"_{k}") for k in keys])
    on = ["run", *[f"_{k}" for k in keys]]
    return rows.join(parts, on).drop(*on)


def save_series(grid: DataFrame, path: str, params: Mapping[str, str] | None = None, ts: str = "ts") -> None:
    """IO11: Parquet by channel and month, so that a rerun replaces only its own months; the run's
    parameters are a table next to it.

    Rows are clustered by their partition before the write: one channel-month is split over
    ``ts`` hours' tasks rather than gathered in one.  Every save is a run in a folder of its own; the state next to it
    (``series_state``) names the run that holds for each channel-month.
    """
    spark = grid.sparkSession
    month = F.date_format(ts, "yyyy-MM")
    _commit(grid.withColumn("month", month).repartition("channel", "month", F.dayofmonth(ts)), f"{path}/series", MONTHS, ts)
    if params is not None:
        rows = [(k, str(v)) for k, v in params.items()]
        spark.createDataFrame(rows, "name string, value string").write.mode("overwrite").parquet(f"{path}/run_params")


def series_state(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored channel-month: n_rows, first_ts, last_ts, the hours that hold rows (at most 744), digest, run."""
    return _state(spark, f"{path}/series", MONTHS)


def replaced_runs(spark: SparkSession, path: str) -> DataFrame:
    """Channel-months of runs that a later run replaced: their folders may be deleted once no reader uses them."""
    return spark.read.parquet(f"{path}/series_state").select("run", *MONTHS).join(series_state(spark, path), ["run", *MONTHS], "left_anti")


def load_series(spark: SparkSession, path: str, channels: Sequence[str] = (), start: str | None = None, end: str | None = None,
                ts: str = "ts") -> DataFrame:
    """IO11, IO21: the stored series, pruned to channels and months; a missing month has no rows."""
    parts = series_state(spark, path)
    if channels:
        parts = parts.where(F.col("channel").isin(*channels))
    if start and end:
        parts = parts.where(F.col("month").between(start[:7], end[:7]))
    df = _stored(spark, f"{path}/series", MONTHS, parts).drop("month")
    return df.where((F.col(ts) >= ntz(start)) & (F.col(ts) < ntz(end))) if start and end else df


def _chunk(ts: str | Column, hours: int) -> Column:
    """Number of a time's chunk: whole steps of ``hours`` since 1970."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / (3600 * hours)).cast("long")


def append_chunks(grid: DataFrame, path: str, hours: int = 24, ts: str = "ts") -> None:
    """IO15: rows by chunks of ``hours``, each with a line in the manifest (range, row count, digest).

    A repeated chunk takes the place of the one before, so a repeat is harmless; a chunk whose write died has no line.
    """
    _commit(grid.withColumn("chunk", _chunk(ts, hours)).repartition("chunk", F.hour(ts)), f"{path}/chunks", CHUNKS, ts)


def load_chunks(spark: SparkSession, path: str, start: str, end: str, hours: int = 24, ts: str = "ts") -> DataFrame:
    """IO15: the rows of [start, end) in all chunks that are there; ``missing_ranges`` names the others."""
    near = F.col("chunk").between(_chunk(ntz(start), hours), _chunk(ntz(end), hours))
    df = _stored(spark, f"{path}/chunks", CHUNKS, _state(spark, f"{path}/chunks", CHUNKS).where(near)).drop("chunk")
    return df.where((F.col(ts) >= ntz(start)) & (F.col(ts) < ntz(end)))


def missing_ranges(spark: SparkSession, path: str, start: str, end: str, hours: int = 24) -> DataFrame:
    """IO15: (start_ts, end_ts) of the runs of chunks of [start, end) that the manifest lacks, cut to that range.

    A chunk without rows counts as missing.  Chunks are a row each here, so runs are found in one window.
    """
    last = _chunk(F.timestamp_add("SECOND", F.lit(-1), ntz(end)), hours)
    wanted = spark.range(1).select(F.explode(F.sequence(_chunk(ntz(start), hours), last)).alias("chunk"))
    gaps = wanted.join(_state(spark, f"{path}/chunks", CHUNKS), "chunk", "left_anti")
    runs = gaps.withColumn("g", F.col("chunk") - F.row_number().over(Window.orderBy("chunk"))).groupBy("g").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    at = lambda n: F.timestamp_seconds(n * (3600 * hours)).cast("timestamp_ntz")
    return runs.select(F.greatest(at(F.col("a")), ntz(start)).alias("start_ts"), F.least(at(F.col("b") + 1), ntz(end)).alias("end_ts"))


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/run_params")


def _accepted(hours: DataFrame, names: DataFrame, n_hours: int | Column, n_channels: int | Column) -> DataFrame:
    hours, names = (d.distinct().agg(F.count(F.lit(1)).alias("n")) for d in (hours, names))
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return hours.select(F.col("n").alias("n_hours"), names.scalar().alias("n_channels")).withColumn(
        "accepted", (F.col("n_hours") == lit(n_hours)) & (F.col("n_channels") == lit(n_channels)))


def shape_accepted(grid: DataFrame, n_hours: int | Column, n_channels: int | Column, ts: str = "ts", channel: str = "channel") -> DataFrame:
    """IO12: a result is reused only when its number of hours and channels is the expected one."""
    return _accepted(grid.select(ts), grid.select(channel), n_hours, n_channels)


def series_accepted(spark: SparkSession, path: str, n_hours: int | Column, n_channels: int | Column) -> DataFrame:
    """IO12 for a stored series, from its state alone: no pixel file is read."""
    state = series_state(spark, path)
    return _accepted(state.select(F.explode("hours").alias("h")), state.select("channel"), n_hours, n_channels)


def _after(mark: Column, incoming: DataFrame, end: str, ts: str) -> DataFrame:
    done = F.coalesce(mark >= F.timestamp_add("HOUR", F.lit(-1), ntz(end)), F.lit(False))
    return incoming.where(~done & (F.col(ts) < ntz(end)) & F.coalesce(F.col(ts) > mark, F.lit(True)))


def new_rows(stored: DataFrame, incoming: DataFrame, end: str, ts: str = "ts") -> DataFrame:
    """IO13: rows after the stored high-water mark; nothing when the mark already reaches the last
    wanted hour."""
    return _after(stored.agg(F.max(ts).alias("t")).scalar(), incoming, end, ts)


def resume_rows(spark: SparkSession, path: str, incoming: DataFrame, end: str, ts: str = "ts") -> DataFrame:
    """IO13 for a stored series: the mark comes from its state, a row per channel-month."""
    return _after(series_state(spark, path).agg(F.max("last_ts").alias("t")).scalar(), incoming, end, ts)


def chunk_ranges(ranges: DataFrame, step: str, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """IO14: split [start, end) into steps such as ``1 YEAR``, ``3 MONTH``, ``7 DAY``; the last end
    is clipped."""
    starts = F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL {step}"))
    rows = ranges.select("*", F.posexplode(starts).alias("chunk_no", "chunk_start")).where(F.col("chunk_start") < F.col(end))
    return rows.withColumn("chunk_end", F.least(F.col("chunk_start") + F.expr(f"INTERVAL {step}"), F.col(end)))


def save_windows(windows: DataFrame, path: str, scalers: DataFrame | None = None, metadata: Mapping[str, str] | None = None) -> None:
    """IO19: X and Y arrays per split and channel, scaler states and metadata."""
    as_float = lambda c: F.transform(c, lambda f: F.transform(f, lambda v: v.cast("float")))
    x = windows.select("split", "channel", "sample_id", as_float("x_frames").alias("frames"))
    y = windows.select("split", "channel", "sample_id", as_float("y_frames").alias("frames"))
    for name, df in (("x", x), ("y", y)):
        df.write.mode("overwrite").partitionBy("split", "channel").parquet(f"{path}/{name}")
    if scalers is not None:
        scalers.write.mode("overwrite").parquet(f"{path}/scalers")
    if metadata is not None:
        windows.sparkSession.createDataFrame([(k, str(v)) for k, v in metadata.items()], "name string, value string") \
               .write.mode("overwrite").parquet(f"{path}/metadata")


def load_windows(spark: SparkSession, path: str, part: str, split: str, channels: Sequence[str] = ()) -> DataFrame:
    """IO21: the channel files of one split as one feature table (partition pruned)."""
    df = spark.read.parquet(f"{path}/{part}").where(F.col("split") == split)
    return df.where(F.col("channel").isin(*channels)) if channels else df
