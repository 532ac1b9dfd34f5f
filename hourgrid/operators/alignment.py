"""Joins and time alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hourgrid.functions.columns import hour_ceil, hour_floor, model_run, ntz, plus_hours


def with_cells(rows: DataFrame, sensors: DataFrame, key: str = "sensor_id") -> DataFrame:
    """Attach or select grid cells; the optimiser broadcasts ``sensors`` only if it is small."""
    return rows.join(sensors.select(key, "x", "y"), key)


def pick_cells(grid: DataFrame, sensors: DataFrame, key: str = "sensor_id") -> DataFrame:
    """Grid values at the sensors' cells."""
    return grid.join(sensors.select(key, "x", "y"), ["x", "y"])


def drop_colliding(sensors: DataFrame, reference: Column) -> DataFrame:
    """Other sensors leave a cell that a reference-grade sensor occupies."""
    is_reference = F.coalesce(reference, F.lit(False))
    occupied = sensors.where(is_reference).select("x", "y").distinct().withColumn("_taken", F.lit(True))
    return sensors.join(occupied, ["x", "y"], "left").where(is_reference | F.col("_taken").isNull()).select(*sensors.columns)


def latest_in_hour(reports: DataFrame, hour: Column, key: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The newest report of each hour stands for the hour."""
    packed = F.struct(*[F.col(c) for c in columns])
    return (reports.withColumn("_h", hour).groupBy(*key, "_h")
                   .agg(F.max_by(packed, order).alias("_r"))
                   .select(*key, F.col("_h").alias("ts"), "_r.*"))


def hourly_pixel_mean(pixels: DataFrame, keys: Sequence[str] = ("row", "col"), ts: str = "granule_ts",
                      value: str = "value") -> DataFrame:
    """T4: mean of the previous hour's passed pixels, labelled by the hour's end."""
    return (pixels.groupBy(*keys, plus_hours(hour_floor(ts), 1).alias("ts"))
                  .agg(F.avg(value).alias(value)))


def closest_before_hour(pixels: DataFrame, keys: Sequence[str], ts: str = "granule_ts", value: str = "value",
                        target_min: int = 10, within_min: int = 10) -> DataFrame:
    """T5: instead of a mean, the observation closest to ``target_min`` minutes before the hour's
    end, at most ``within_min`` minutes away; the earlier one on ties.  A reading exactly on an hour
    belongs to that hour."""
    end = hour_ceil(ts)
    target = F.timestamp_add("MINUTE", F.lit(-target_min), end)
    off = F.abs(F.timestamp_diff("MICROSECOND", F.col(ts), target))
    near = pixels.withColumn("ts", end).withColumn("_off", off).where(F.col("_off") <= within_min * 60_000_000)
    return near.groupBy(*keys, "ts").agg(F.min_by(value, F.struct("_off", ts)).alias(value))


def nearest_report(axis: DataFrame, reports: DataFrame, key: Sequence[str], columns: Sequence[str],
                   ts: str = "ts", report_ts: str = "valid", later_on_tie: bool = True) -> DataFrame:
    """For each (key, hour) of ``axis`` the report nearest in time.

    Only the first and last report of each clock hour can be nearest to a whole hour, so the
    reports are reduced to two per (key, hour) in a combinable aggregate first.  What enters
    the ordered window is then bounded by the axis, however hot one station is.
    """
    row = F.struct(F.col(report_ts), *[F.col(c) for c in columns])
    edge = (reports.where(F.col(report_ts).isNotNull())
                   .groupBy(*key, hour_floor(report_ts).alias("_h"))
                   .agg(F.min_by(row, report_ts).alias("_a"), F.max_by(row, report_ts).alias("_z")))
    points = edge.select(*key, F.explode(F.array("_a", "_z")).alias("_r")).select(
        *key, F.col(f"_r.{report_ts}").alias("_t"), "_r", F.lit(None).cast("timestamp_ntz").alias("_slot")).distinct()
    slots = axis.select(*key, F.col(ts).alias("_t"), F.lit(None).cast(points.schema["_r"].dataType).alias("_r"),
                        F.col(ts).alias("_slot"))
    own = Window.partitionBy(*key)
    before = F.last("_r", ignorenulls=True).over(own.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0))
    after = F.last("_r", ignorenulls=True).over(own.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, 0))
    both = (points.unionByName(slots).withColumn("_b", before).withColumn("_f", after)
                  .where(F.col("_slot").isNotNull()))
    gap_b = F.timestamp_diff("MICROSECOND", F.col(f"_b.{report_ts}"), F.col("_slot"))
    gap_f = F.timestamp_diff("MICROSECOND", F.col("_slot"), F.col(f"_f.{report_ts}"))
    use_f = (gap_f <= gap_b) if later_on_tie else (gap_f < gap_b)
    best = F.when(F.col("_b").isNull() | use_f, F.coalesce("_f", "_b")).otherwise(F.col("_b"))
    return both.select(*key, F.col("_slot").alias(ts), best.alias("_r")).select(*key, ts, "_r.*")


def step_function(axis: DataFrame, rasters: DataFrame, ts: str = "ts", since: str = "acq_ts",
                  clamp_start: bool = True) -> DataFrame:
    """Every hour shows the newest raster acquired at or before it.

    ``rasters`` is one row per acquisition (the small inventory, not its pixels): each becomes a
    validity interval whose hours are unrolled, so the pixels join on equality.  Hours before
    the first acquisition show the first one.
    """
    w = Window.orderBy("_t", "_kind")
    marks = (rasters.select(F.col(since).alias("_t"), F.lit(0).alias("_kind"), F.col(since).alias("_acq")).distinct()
             .unionByName(axis.select(F.col(ts).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("timestamp_ntz").alias("_acq"))))
    held = F.last("_acq", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if clamp_start:
        held = F.coalesce(held, F.first("_acq", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return marks.withColumn(since, held).where(F.col("_kind") == 1).select(F.col("_t").alias(ts), since)


def daily_to_hours(axis: DataFrame, daily: DataFrame, ts: str = "ts", day: str = "day") -> DataFrame:
    """The value of a day holds for all of its hours."""
    return axis.withColumn(day, F.to_date(ts)).join(daily, day)


def with_model_run(hours: DataFrame, ts: str = "ts") -> DataFrame:
    """J11"""
    run, lead = model_run(ts)
    return hours.withColumn("run_ts", run).withColumn("lead", lead)


def latest_usable_run(runs: DataFrame, now: str | Column, horizon: int = 24, reach: int = 48) -> DataFrame:
    """Newest available special run of today or yesterday that still covers the next
    ``horizon`` hours, with the lead hours to read."""
    at = ntz(now)
    offset = F.timestamp_diff("HOUR", F.col("run_ts"), at)
    usable = runs.where((F.col("run_ts") < at) & F.col("available")
                        & (F.to_date("run_ts") >= F.date_sub(F.to_date(at), 1))
                        & (offset + horizon <= reach))
    top = usable.agg(F.max("run_ts").alias("run_ts")).where(F.col("run_ts").isNotNull()).withColumn("offset", offset)
    return top.select("run_ts", "offset", F.explode(F.sequence(F.col("offset") + 1, F.col("offset") + horizon)).alias("lead"))


# How many leading hours of a forecast file are used, by init hour.
LOOK_AHEAD = {6: 6, 12: 18, 3: 24}


def select_valid_hours(forecasts: DataFrame, wanted: DataFrame, init: str = "init_ts", valid: str = "valid_ts",
                       ts: str = "ts") -> DataFrame:
    """The first hours of each forecast file by init hour, restricted to the wanted hours.

    The rank is taken over the distinct valid hours of a file, not over its pixels.
    """
    hours = forecasts.select(init, valid).distinct()
    rank = F.row_number().over(Window.partitionBy(init).orderBy(valid))
    limit = F.coalesce(*[F.when(F.hour(init) == h, F.lit(n)) for h, n in LOOK_AHEAD.items()])
    used = (hours.withColumn("_rank", rank).where(F.col("_rank") <= limit)
                 .join(wanted.select(F.col(ts).alias(valid)), valid, "left_semi").select(init, valid))
    return forecasts.join(used, [init, valid], "left_semi")


def latest_run_wins(forecasts: DataFrame, keys: Sequence[str], init: str = "init_ts", value: str = "value") -> DataFrame:
    """J14"""
    return forecasts.groupBy(*keys).agg(F.max_by(value, init).alias(value), F.max(init).alias(init))


# The two init hours of the daily model.
INIT_HOURS = (6, 12)


def run_back_off(ranges: DataFrame, start: str = "start_ts", end: str = "end_ts",
                 init_hours: tuple[int, int] = INIT_HOURS) -> DataFrame:
    """Which model day and init run cover the ends of a range.

    ``start_steps`` drops that many runs at the front, ``end_steps`` (zero or negative) at the back.
    """
    early, late = init_hours
    sh, eh = F.hour(start), F.hour(end)
    back = lambda c, h: F.when(h < early, F.timestamp_add("DAY", F.lit(-1), F.col(c))).otherwise(F.col(c))
    return (ranges
            .withColumn("model_start", back(start, sh))
            .withColumn("start_steps", F.when((sh > early) & (sh <= late), 0).otherwise(1))
            .withColumn("model_end", back(end, eh))
            .withColumn("end_steps", F.when((eh > early) & (eh <= late), -1).otherwise(0)))


def stack_channels(grids: dict[str, DataFrame]) -> DataFrame:
    """J16, long form."""
    out = None
    for name, g in grids.items():
        g = g.withColumn("channel", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


def channels_side_by_side(grid: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("ts", "x", "y"),
                          value: str = "value", complete: bool = True) -> DataFrame:
    """J16, wide form: one column per channel, only where every channel has a value."""
    wide = grid.groupBy(*keys).agg(*[F.max(F.when(F.col("channel") == c, F.col(value))).alias(c) for c in channels])
    return wide.dropna(subset=list(channels)) if complete else wide


def common_hours(grid: DataFrame, channel: str = "channel", ts: str = "ts") -> DataFrame:
    """Hours every channel has; the prefix rule of equal-length arrays as a set of hours."""
    pairs = grid.select(channel, ts).distinct()
    total = grid.select(channel).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    shared = pairs.groupBy(ts).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == total).select(ts)
    return grid.join(shared, ts, "left_semi")


def shortest_length(grid: DataFrame, channel: str = "channel", index: str = "ts_idx") -> DataFrame:
    """J17, strict form: positions below the smallest channel length."""
    lengths = grid.groupBy(channel).agg(F.max(index).alias("n"))
    return grid.where(F.col(index) <= lengths.agg(F.min("n").alias("n")).scalar())


def attach_static(grid: DataFrame, layer: DataFrame, name: str, value: str = "value") -> DataFrame:
    """A static layer is joined on the cell where needed, never copied per hour."""
    return grid.join(layer.select("x", "y", F.col(value).alias(name)), ["x", "y"], "left")


def grid_against_next_target(grid: DataFrame, targets: DataFrame, site: str = "sensor_id", ts: str = "ts",
                             value: str = "value") -> DataFrame:
    """Mean |pixel(t) - target(t+1)| per site, and the mean of those means."""
    ahead = targets.select(site, "x", "y", plus_hours(ts, -1).alias(ts), F.col(value).alias("_target"))
    per_site = (grid.join(ahead, ["x", "y", ts])
                    .groupBy(site).agg(F.avg(F.abs(F.col(value) - F.col("_target"))).alias("mean_error")))
    overall = per_site.agg(F.avg("mean_error").alias("m")).scalar()
    return per_site.withColumn("mean_of_means", overall)


def side_by_side(series: dict[str, DataFrame], ts: str = "ts", value: str = "value") -> DataFrame:
    """Several hourly series as columns on the shared hours."""
    out = None
    for name, s in series.items():
        s = s.select(ts, F.col(value).alias(name))
        out = s if out is None else out.join(s, ts)
    return out


def label_channels(grid: DataFrame, channels: DataFrame) -> DataFrame:
    """Group, position and display name of a channel."""
    return grid.join(channels, "channel")
