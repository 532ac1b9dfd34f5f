"""Satellite, model and weather jobs (P6-P15) over decoded pixel tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from hourgrid.functions import columns as C
from hourgrid.operators import alignment as J
from hourgrid.operators import cleaning as K
from hourgrid.operators import fills as T
from hourgrid.operators import gridding as G
from hourgrid.operators import interpolate as I
from hourgrid.operators import raster as R


def geostationary_series(pixels: DataFrame, quality: Column, hours: DataFrame, shape: tuple[int, int], dim: int, coverage: float = 0.20,
                         sparse: bool = False, hourly_mean: bool = True, extent: C.Extent | None = None) -> DataFrame:
    """Quality -> hourly mean (or the observation nearest the hour) -> zero background of sparse
    products -> extent -> resize -> coverage gate -> nearest fill, or the last good frame.

    ``pixels``: (granule_ts, row, col, value, quality columns) on a fixed ``shape`` lattice; with an
    ``extent`` also (lat, lon), and the lattice is cut to it before the resize.
    """
    if extent is not None:
        pixels, shape = G.cropped(pixels, extent)
    passed = pixels.withColumn("value", F.when(quality, F.col("value")))
    agg = J.hourly_pixel_mean(passed) if hourly_mean else J.closest_before_hour(passed, ["row", "col"])
    frames = agg.select("ts", F.col("row").alias("x"), F.col("col").alias("y"), "value")
    frames = T.zero_background(frames, F.lit(sparse))
    small = K.coverage_gate(R.resize(frames, shape, dim), coverage)
    good = small.where(F.col("value").isNotNull()).select("ts").distinct()
    filled = I.fill_nearest(small.join(good, "ts", "left_semi"), dim)
    return T.carry_or_zero(filled, T.fill_status(hours, small.groupBy("ts").agg((F.count("value") > 0).alias("ok"))), dim).drop("status")


def column_series(pixels: DataFrame, hours: DataFrame, shape: tuple[int, int], dim: int, reject_below: float = 0.1,
                  cloud_below: float = 0.5) -> DataFrame:
    """Newest granule of the hour -> quality and cloud -> coverage -> frame mean -> corner-aligned
    resize -> flip to north-up -> unit -> carry or zero, with the status of every hour."""
    hour = C.hour_floor("granule_ts")
    newest = pixels.groupBy(hour.alias("ts")).agg(F.max("granule_ts").alias("granule_ts"))
    rows = pixels.join(newest, "granule_ts").withColumn("value", C.quality_cloud("value", "qa", "cloud", cloud_below))
    frames = rows.select("ts", F.col("row").alias("x"), F.col("col").alias("y"), "value")
    share = frames.groupBy("ts").agg((F.count("value") / F.count(F.lit(1)) >= reject_below).alias("ok"))
    kept = frames.join(share.where("ok").select("ts"), "ts", "left_semi")
    grid = R.resize(T.fill_with_frame_mean(kept), shape, dim, "corner")
    grid = grid.select("ts", C.flip_rows(dim).alias("x"), "y", C.scale_unit("value", "no2_column").alias("value"))
    return T.carry_or_zero(grid, T.fill_status(hours, share), dim)


def model_series(pixels: DataFrame, hours: DataFrame, extent: C.Extent, dim: int, quantity: str | None = None, order: str = "pixel",
                 strict_lead: bool = False, linear: bool = False) -> DataFrame:
    """P8, one scalar variable: unit -> bounding window -> point cloud to grid -> aligned axis.

    ``pixels``: (ts, row, col, lat, lon, value, ``order``) of one lead per hour, see J11/J12.  With ``linear`` nodes
    inside the hull of the pixels take the plane of their triangle, others the nearest pixel.
    """
    rows = pixels.withColumn("value", C.scale_unit("value", quantity)) if quantity else pixels
    grid = (I.linear_point if linear else I.nearest_point)(G.bounding_window(rows, extent, 2), extent, dim, order)
    return T.carry_frames(grid, hours, "first" if strict_lead else "all").drop("src_ts")


def model_wind_series(pixels: DataFrame, hours: DataFrame, extent: C.Extent, dim: int, order: str = "pixel") -> DataFrame:
    """P8, wind: both components are turned to earth-relative and gridded together, in one search."""
    u, v = C.wind_to_earth("u", "v", "lon")
    rows = pixels.select("ts", "row", "col", "lat", "lon", order, F.when(u.isNotNull() & v.isNotNull(), F.struct(u.alias("u"), v.alias("v"))).alias("value"))
    both = model_series(rows, hours, extent, dim, order=order)
    parts = F.explode(F.array(*[F.struct(F.lit(f"wind_{c}").alias("channel"), F.col(f"value.{c}").alias("value")) for c in ("u", "v")]))
    return both.select("ts", "x", "y", parts.alias("p")).select("ts", "x", "y", "p.channel", "p.value")


def forecast_series(pixels: DataFrame, hours: DataFrame, shape: tuple[int, int], dim: int, extent: C.Extent | None = None) -> DataFrame:
    """Valid hours per file -> extent -> resize -> later run wins -> missing hours are zero frames.

    ``pixels``: (init_ts, valid_ts, x, y, value); the inventory was chosen by IO17 and J15.
    """
    rows = J.select_valid_hours(pixels, hours)
    if extent is not None:
        rows, shape = G.cropped(rows, extent, "x", "y")
    grid = R.resize(rows, shape, dim, frame=("init_ts", "valid_ts"))
    last = J.latest_run_wins(grid, ["valid_ts", "x", "y"]).withColumnRenamed("valid_ts", "ts")
    return T.zero_missing_hours(last.select("ts", "x", "y", "value"), hours, dim)


def vegetation_series(tiles: DataFrame, hours: DataFrame, shape: tuple[int, int], dim: int) -> tuple[DataFrame, DataFrame]:
    """P10: unit -> resize -> step function over the hours; also the validity report per hour.

    The series stays as (hour -> acquisition) joined with one grid per acquisition.
    """
    scaled = tiles.withColumn("value", C.scale_unit("value", "vegetation_index"))
    grid = R.resize(scaled, shape, dim, frame=("acq_ts",))
    series = J.step_function(hours, grid.select("acq_ts").distinct()).join(grid, "acq_ts")
    return series, G.frame_validity(series)


def weather_series(reports: DataFrame, hours_by_station: DataFrame, elevation: DataFrame, extent: C.Extent, dim: int,
                   scalars: Mapping[str, bool]) -> DataFrame:
    """Last report per rounded-up hour -> nearest such hour -> wind parts -> wind by G10, scalars by G8.

    ``reports``: (station, valid, lat, lon, sped, drct, scalars...); ``scalars`` maps a variable to
    whether it may be negative (otherwise negatives count as missing).
    """
    columns = ["sped", "drct", *scalars]
    latest = J.latest_in_hour(reports, C.hour_ceil("valid"), ["station"], "valid", columns).withColumnRenamed("ts", "_hour")
    place = reports.groupBy("station").agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"))
    at = J.nearest_report(hours_by_station, latest, ["station"], columns, report_ts="_hour").join(place, "station")
    u, v = C.wind_components("sped", "drct")
    wind = I.wind_idw(at.withColumn("u", u).withColumn("v", v).select("ts", "station", "lat", "lon", "u", "v"), elevation, extent, dim, order="station")
    out = {"wind_u": wind.select("ts", "x", "y", F.col("u").alias("value")), "wind_v": wind.select("ts", "x", "y", F.col("v").alias("value"))}
    x, y = C.cell_of(extent, dim)
    spots = place.withColumn("x", x).withColumn("y", y)
    for name, signed in scalars.items():
        value = F.col(name) if signed else C.negative_to_null(name)
        rows = at.select("ts", "station", value.alias("value"), x.alias("x"), y.alias("y")).where(F.col("value").isNotNull())
        frame = rows.groupBy("ts", "x", "y").agg(F.max_by("value", "station").alias("value"))
        out[name] = I.idw_fixed_neighbours(frame, spots, dim)
    return J.stack_channels(out)


def surface_temperature_series(pixels: DataFrame, hours: DataFrame, shape: tuple[int, int], dim: int) -> DataFrame:
    """Scale -> 100 K floor -> clip to [0, 1] -> corner resize -> Gaussian of frames with heat
    -> all hours of the day, days without data are empty -> recursive smoothing with fading.

    Resampling and smoothing in space run once per day, before the hours are unrolled.
    """
    kelvin = C.kelvin_floor(C.scale_offset("value", "scale", "offset", "fill"))
    rows = pixels.select("day", "x", "y", C.clip_normalise(kelvin).alias("value"))
    daily = R.gaussian(R.resize(rows, shape, dim, "corner", frame=("day",)), (dim, dim), 1.0, only_positive=True, frame=("day",))
    hourly = T.zero_missing_hours(J.daily_to_hours(hours, daily), hours, dim).withColumn("channel", F.lit("surface_temperature"))
    return T.recursive_smooth(hourly, 0.3, fade=0.9, measure="max")


def aerosol_series(pixels: DataFrame, hours: DataFrame, shape: tuple[int, int], dim: int) -> DataFrame:
    """Scale -> mean over bands -> range rules -> corner resize -> all hours of the day."""
    rows = pixels.withColumn("value", C.scale_offset("value", "scale", "offset", "fill"))
    bands = rows.groupBy("day", "x", "y").agg(C.optical_depth_range(F.avg("value")).alias("value"))
    return J.daily_to_hours(hours, R.resize(bands, shape, dim, "corner", frame=("day",)))


def reanalysis_series(native: DataFrame, hours: DataFrame, shape: tuple[int, int], dim: int, extent: C.Extent | None = None) -> dict[str, DataFrame]:
    """Extent -> nearest source time per hour -> corner resize -> recursive smoothing, on the
    native grid and on the resized one; the resized frames decide for both which hours are empty.

    ``native``: (channel, src_ts, x, y, value), variables resolved by F27.
    """
    rows, shape = (native, shape) if extent is None else G.cropped(native, extent, "x", "y")
    times = rows.select("src_ts").distinct().withColumn("one", F.lit(1))
    slots = hours.withColumn("one", F.lit(1))
    nearest = J.nearest_report(slots, times.withColumn("pick", F.col("src_ts")), ["one"], ["pick"], report_ts="src_ts", later_on_tie=False)
    plan = nearest.select("ts", "src_ts")
    small = R.resize(rows, shape, dim, "corner", frame=("channel", "src_ts"))
    hourly = lambda g: plan.join(g, "src_ts").select("channel", "ts", "x", "y", "value")
    state = T.frame_state(hourly(small))
    return {name: T.recursive_smooth(hourly(g), 0.2, state=state) for name, g in (("native", rows), ("resized", small))}


def polar_series(pixels: DataFrame, hours: DataFrame, extent: C.Extent, dim: int, order: str = "pixel", least: int = 4, linear: bool = False) -> DataFrame:
    """Quality score -> grid per day -> gaps from both neighbours -> all hours.

    Nodes take the nearest point; with ``linear`` the plane of their triangle, and 0 outside the hull.  A day needs ``least`` valid points, and a day of zeros counts as missing; if no day has data, all
    are zero frames.
    """
    passed = pixels.withColumn("value", C.quality_score("value", "qa")).where(F.col("value").isNotNull())
    enough = passed.groupBy("day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("day")
    used = passed.join(enough, "day", "left_semi")
    daily = I.linear_point(used, extent, dim, order, ("day",), outside=0.0) if linear else I.nearest_point(used, extent, dim, order, ("day",))
    days = hours.select(F.to_date("ts").alias("day")).distinct()
    filled = T.zero_missing_hours(T.fill_day_gaps(daily, days), days, dim, "day")
    return J.daily_to_hours(hours, filled)
