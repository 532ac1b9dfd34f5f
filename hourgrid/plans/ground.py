"""Ground-sensor jobs (P1-P5): readings to cleaned series to hourly grids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hourgrid.functions import columns as C
from hourgrid.operators import alignment as J
from hourgrid.operators import cleaning as K
from hourgrid.operators import fills as T
from hourgrid.operators import gridding as G
from hourgrid.operators import interpolate as I


@dataclass(frozen=True)
class Axis:
    start: str
    end: str


def station_clean(obs: DataFrame, axis: Axis, extent: C.Extent, min_uptime: float = 0.25, zscore: float = 3.0, cap: float = 300.0,
                  min_reporting: float = 0.3, facts: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Regulatory network.  ``obs`` has one row per (sensor_id, ts).

    Uptime -> extent -> sign -> floor -> hourly scaffold with filled site facts -> z-score -> cap
    -> sparse hours.
    """
    C.check_extent(extent)
    kept = K.min_uptime_rows(obs, min_uptime).where(C.in_extent(extent))
    kept = kept.withColumn("value", C.floor_low(C.negative_to_null("value")))
    full = T.fill_series(T.hour_scaffold(kept, axis.start, axis.end), facts)
    full = K.zscore_to_null(full, zscore, scaffold=True).withColumn("value", C.cap_to_null("value", cap))
    return K.sparse_hours_to_null(full, min_reporting)


def station_grids(clean: DataFrame, hours: DataFrame, extent: C.Extent, dim: int, neighbours: int = 10, power: float = 2.0,
                  elevation: DataFrame | None = None, mask: DataFrame | None = None, names: Sequence = ()) -> DataFrame:
    """Cleaned readings -> cells (last sensor wins) -> carried frames -> IDW."""
    x, y = C.cell_of(extent, dim)
    rows = K.keep_names(clean, names, "sensor_id").withColumn("x", x).withColumn("y", y)
    if mask is not None:
        rows = K.mask_cells(rows.withColumnRenamed("value", "_v"), mask).withColumnRenamed("_v", "value")
    frames = T.carry_frames(G.plot_last(rows, ["sensor_id"]), hours).drop("src_ts")
    return I.idw(frames, dim, power, neighbours, elevation)


def station_clean_filled(obs: DataFrame, axis: Axis, min_uptime: float = 0.25, zscore: float = 3.0,
                         facts: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Uptime -> sign -> scaffold -> z-score -> forward and back fill."""
    kept = K.min_uptime_rows(obs, min_uptime).withColumn("value", C.negative_to_null("value"))
    full = T.fill_series(T.hour_scaffold(kept, axis.start, axis.end), facts)
    return T.fill_series(K.zscore_to_null(full, zscore, scaffold=True), ["value"])


def network_clean(obs: DataFrame, sensors: DataFrame, axis: Axis, extent: C.Extent, dim: int, reference: Column,
                  providers: Sequence[str] = (), min_uptime: float = 0.01, zscore: float = 3.0, cap: float = float("inf"),
                  use_nowcast: bool = False, fill: str = "spatial") -> tuple[DataFrame, DataFrame]:
    """Low-cost network; returns (cleaned hourly readings, surviving sensors with cells).

    Provider -> uptime -> extent -> cells -> [NowCast] -> z-score and cap -> fill -> collisions.
    """
    C.check_extent(extent)
    x, y = C.cell_of(extent, dim)
    kept = K.keep_names(sensors, providers, "provider").where(C.in_extent(extent)).withColumn("x", x).withColumn("y", y)
    # Which sensors survive is settled on the sensor table before any hour is unrolled.
    alive = kept.join(K.enough_hours(obs, axis.start, axis.end, min_uptime), "sensor_id", "left_semi")
    placed = J.drop_colliding(alive, reference)
    full = T.hour_scaffold(obs.join(alive.select("sensor_id"), "sensor_id", "left_semi"), axis.start, axis.end)
    if use_nowcast:
        full = T.nowcast(full).withColumn("value", F.col("nowcast")).drop("nowcast")
    full = K.zscore_to_null(full, zscore, scaffold=True).withColumn("value", C.cap_to_null("value", cap, inclusive=True))
    full = T.fill_dead_hours(full) if fill == "spatial" else T.fill_series(full, ["value"])
    return full.join(placed.select("sensor_id"), "sensor_id", "left_semi"), placed


def network_grids(clean: DataFrame, placed: DataFrame, dim: int, neighbours: int = 10, power: float = 2.0,
                  elevation: DataFrame | None = None) -> DataFrame:
    """P5, from cleaned readings: same-cell mean -> IDW."""
    frames = G.merge_mean(J.with_cells(clean.select("sensor_id", "ts", "value"), placed))
    return I.idw(frames, dim, power, neighbours, elevation)


def network_series(readings: DataFrame, sensors: DataFrame, axis: Axis, extent: C.Extent, dim: int, reference: Column,
                   order: str = "event_id", **options) -> DataFrame:
    """P5: raw readings and sensor life spans -> grids.  ``readings`` comes from the measurement
    documents, ``sensors`` from the locations document."""
    live = K.operating_between(sensors, axis.start, axis.end)
    hourly = T.last_write_per_hour(readings.join(live.select("sensor_id"), "sensor_id", "left_semi"), C.hour_round("ts"), order)
    clean, placed = network_clean(hourly, live, axis, extent, dim, reference, **options)
    return network_grids(clean, placed, dim)
