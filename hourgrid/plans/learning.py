"""Training sets, event augmentation and the forecast report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from hourgrid.functions import columns as C
from hourgrid.operators import alignment as J
from hourgrid.operators import augment as X
from hourgrid.operators import fills as T
from hourgrid.operators import samples as S
from hourgrid.operators import scoring as M
from hourgrid.operators import stats as A


def with_derived_channels(grid: DataFrame, target: str, start: str, days: int = 30, time_fields: Sequence[str] = ("month", "hour"),
                          static: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The input channels plus the target's climatology, cyclical time and the static layers (x, y, value), on
    the common hours."""
    shared = J.common_hours(grid)
    own = shared.where(F.col("channel") == target)
    clim = T.climatology(own, start, days).select("ts", "x", "y", F.col("climatology").alias("value"), F.lit("climatology").alias("channel"))
    waves = []
    for f in time_fields:
        sin, cos = C.cyclical("ts", f)
        waves += [F.struct(F.lit(f"{f}_sin").alias("channel"), sin.alias("value")), F.struct(F.lit(f"{f}_cos").alias("channel"), cos.alias("value"))]
    time = own.select("ts", "x", "y", F.explode(F.array(*waves)).alias("w")).select("ts", "x", "y", "w.channel", "w.value")
    cols = ["channel", "ts", "x", "y", "value"]
    out = shared.select(*cols).unionByName(clim.select(*cols)).unionByName(time.select(*cols))
    for name, layer in (static or {}).items():
        held = own.select("ts", "x", "y").join(layer, ["x", "y"]).withColumn("channel", F.lit(name))
        out = out.unionByName(held.select(*cols))
    return out


def training_set(grid: DataFrame, target: str, start: str, n_hours: int, dim: int, n_in: int, n_out: int, stride: int = 1,
                 forecast: Mapping[str, str] | None = None, unscaled: Sequence[str] = ("month_sin", "month_cos", "hour_sin", "hour_cos"),
                 static: Mapping[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Derived channels -> split -> scalers from the training part -> windows inside each split.

    Returns (inputs, targets, scalers).  Inputs are scaled, targets keep their unit.  ``forecast``
    maps a forecast channel to the channel whose scaler it reuses; its frames are those at the
    target positions (S4).  ``static`` layers (elevation by S12, vegetation by S12) are scaled already.
    ``grid`` is complete: every channel has every cell in every hour.
    """
    parted_hours = [int(n_hours * 0.70), int(n_hours * 0.85)]
    if min(parted_hours[0], parted_hours[1] - parted_hours[0], n_hours - parted_hours[1]) < n_in + n_out:
        raise ValueError("a split is shorter than one window and its target")
    full = with_derived_channels(grid, target, start, static=static).withColumn("ts_idx", C.hour_index("ts", start))
    parted = S.temporal_split(full, "ts_idx", n_hours)
    forecast = dict(forecast or {})
    scalers = S.fit_scalers(parted.where(~F.col("channel").isin(*unscaled, *forecast, *(static or {}))))
    scaled = S.apply_scalers(parted, scalers, reuse=forecast)
    cell = F.col("x") * dim + F.col("y")
    keys = ["split", "channel"]
    cut = lambda df: S.sliding_windows(S.rebase(S.pack_dense(df, [*keys, "ts_idx"], cell), keys=["channel"]), n_in, n_out, stride, keys=keys, check=False)
    ahead = F.col("channel").isin(*forecast) if forecast else F.lit(False)
    inputs = cut(scaled).select(*keys, "sample_id", F.when(ahead, F.col("y_frames")).otherwise(F.col("x_frames")).alias("frames"))
    targets = cut(parted.where(F.col("channel") == target)).select("split", "sample_id", "y_frames")
    return inputs, targets, scalers


def manifest_training_set(grid: DataFrame, manifest: DataFrame, target: str, start: str, shape: tuple[int, int], n_in: int, n_out: int,
                          stride: int = 1, days: int = 30, static: Mapping[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P16 with the channel table as data (S13): one plan for any number of channels.

    ``manifest``: (position, channel, name, scale, forecast).  ``channel`` is a channel of ``grid``, ``climatology`` (T22 of
    the target), ``month_sin`` ... ``hour_cos`` (T25) or a layer of ``static`` (x, y, value; scaled already).  A channel may
    stand under several names; those share its scaler.  A ``forecast`` row shows the frames of the target hours (S4).
    Names whose channel has no frames are left out; a NULL flag counts as false.

    All series are cut to the length of the shortest one among the target and the grid channels of the manifest (J17), then
    split 70 / 15 / 15.  Hours before ``start`` take no part.  No window crosses a cut or a gap of its series.  A split shorter than
    one window and its target is an error.

    Returns (inputs, targets, scalers): inputs (split, position, name, sample_id, frames), targets unscaled.  Frames hold the
    ``shape`` = (rows, columns) cells by row; every hour of a series has all of them.
    """
    width = n_in + n_out
    cell = F.col("x") * shape[1] + F.col("y")
    named = manifest.select("channel").union(manifest.sparkSession.range(1).select(F.lit(target))).distinct()
    sources = grid.select("channel", "ts", "x", "y", "value").withColumn("ts_idx", C.hour_index("ts", start)).where("ts_idx >= 0").join(named, "channel", "left_semi")
    n = sources.groupBy("channel").agg((F.max("ts_idx") + 1).alias("n")).agg(F.min("n").alias("n")).scalar()
    cuts = [(n * F.lit(share)).cast("long") for share in (0.70, 0.85)]
    enough = F.least(cuts[0], cuts[1] - cuts[0], n - cuts[1]) >= width
    aligned = sources.where(F.assert_true(enough, F.lit("a split is shorter than one window and its target")).isNull() & (F.col("ts_idx") < n))
    cols = ["channel", "ts_idx", "x", "y", "value"]
    clim = T.climatology(aligned.where(F.col("channel") == target), start, days)
    clim = clim.withColumn("channel", F.lit("climatology")).withColumn("value", F.col("climatology"))
    frames = S.pack_dense(aligned.select(*cols).unionByName(clim.select(*cols)), ["channel", "ts_idx"], cell)

    # What is the same in all cells or in all hours is never written out by cell and hour.
    hours = manifest.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("ts_idx"))
    waves = [F.struct(F.lit(f"{field}_{wave}").alias("channel"), value.alias("value")) for field in ("month", "hour")
             for wave, value in zip(("sin", "cos"), C.cyclical(C.plus_hours(C.ntz(start), F.col("ts_idx")), field))]
    time = hours.select("ts_idx", F.explode(F.array(*waves)).alias("w")).select("w.channel", "ts_idx", F.array_repeat("w.value", shape[0] * shape[1]).alias("frame"))
    every = frames.unionByName(time)
    for name, layer in (static or {}).items():
        one = S.pack_dense(layer.withColumn("_one", F.lit(1)), ["_one"], cell).select("frame").scalar()
        every = every.unionByName(hours.select(F.lit(name).alias("channel"), "ts_idx", one.alias("frame")))

    parted = S.temporal_split(every, "ts_idx", n)
    scaled = manifest.where("scale").select("channel").distinct()
    train = parted.where("split = 'train'").join(scaled, "channel", "left_semi").select("channel", F.explode("frame").alias("value"))
    scalers = S.fit_scalers(train, split=None)
    first = F.when(F.col("split") == "train", F.lit(0)).when(F.col("split") == "valid", cuts[0]).otherwise(cuts[1])
    keys = ["split", "position", "name", "forecast"]
    cut = lambda df, keys: S.sliding_windows(df.withColumn("ts_idx", F.col("ts_idx") - first), n_in, n_out, stride, keys=keys, check=False)
    rows = (parted.join(manifest.select("position", "channel", "name", "scale", F.coalesce("forecast", F.lit(False)).alias("forecast")), "channel")
                  .join(scalers, "channel", "left"))
    shown = F.when(F.col("scale") & F.col("mean").isNotNull(), F.transform("frame", lambda v: (v - F.col("mean")) / F.col("std"))).otherwise(F.col("frame"))
    inputs = cut(rows.withColumn("frame", shown), keys).select(
        "split", "position", "name", "sample_id", F.when(F.col("forecast"), F.col("y_frames")).otherwise(F.col("x_frames")).alias("frames"))
    targets = cut(parted.where(F.col("channel") == target), ["split"]).select("split", "sample_id", "y_frames")
    return inputs, targets, scalers


def event_augmentation(samples: DataFrame, activity: DataFrame, search: tuple[str, str], start: str, n_in: int, n_train: int, dim: int,
                       wind: Sequence[tuple[str, str]] = (), strict: bool = False) -> DataFrame:
    """Active window -> samples that touch it -> all variants.

    ``samples``: (sample_id, frame_idx, channel, x, y, value) of the training part, inputs or targets.
    Targets are turned like scalar channels: call it for them without ``wind``.
    """
    inside = (F.col("ts") >= search[0]) & (F.col("ts") < search[1])
    window = A.active_window(activity, inside)
    edge = lambda c: window.select(C.hour_index(c, start).alias("h")).scalar()
    picked = S.event_samples(samples, edge("first_ts"), edge("last_ts"), n_in, n_train)
    return X.all_variants(picked, dim, wind, strict)


def forecast_report(forecasts: DataFrame, horizons: Sequence[int]) -> dict[str, DataFrame]:
    """By hour, station ranking and summary, sensor x hour matrix, worst pairs, full table."""
    return {
        "by_hour": M.score(forecasts, "horizon"),
        "stations": M.station_ranking(forecasts),
        "station_summary": M.station_summary(forecasts),
        "matrix": M.rmse_matrix(forecasts, horizons),
        "worst_pairs": M.worst_pairs(forecasts),
        "table": M.sensor_hour_table(forecasts),
    }
