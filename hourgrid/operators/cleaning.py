"""Row and sensor filters (F1-F27) and outlier rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hourgrid.functions.columns import local_time, ntz, one_row


def keep_names(df: DataFrame, names: Sequence[str], column: str = "site_name") -> DataFrame:
    """an empty list keeps everything."""
    return df.where(F.col(column).isin(*names)) if names else df


def keep_providers(sensors: DataFrame, obs: DataFrame, providers: Sequence[str],
                   key: str = "sensor_id") -> tuple[DataFrame, DataFrame]:
    """Drop the metadata of other providers together with their readings."""
    kept = keep_names(sensors, providers, "provider")
    return kept, obs.join(kept.select(key), key, "left_semi")


def operating_between(sensors: DataFrame, start: str, end: str,
                      first: str = "first_ts", last: str = "last_ts") -> DataFrame:
    """life span overlaps (start, end), strict on both sides; unknown life spans fall out."""
    first_ts = F.coalesce(F.col(first), ntz(end))
    last_ts = F.coalesce(F.col(last), ntz(start))
    return sensors.where((last_ts > ntz(start)) & (first_ts < ntz(end)))


def min_uptime_rows(obs: DataFrame, min_uptime: float, key: str = "sensor_id", ts: str = "ts") -> DataFrame:
    """keep sensors whose rows / distinct time steps of the whole table is above the bar."""
    steps = obs.select(ts).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    busy = obs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") / steps > min_uptime)
    return obs.join(busy.select(key), key, "left_semi")


def min_uptime_share(scaffold: DataFrame, min_uptime: float, key: str = "sensor_id", value: str = "value") -> DataFrame:
    """drop sensors whose non-null share of the full axis is below the bar.

    A scaffold holds the axis once per sensor, so the sensor window is bounded and reuses the
    scaffold's partitioning.
    """
    own = Window.partitionBy(key)
    share = F.count(value).over(own) / F.count(F.lit(1)).over(own)
    return scaffold.withColumn("_share", share).where(F.col("_share") >= min_uptime).drop("_share")


def enough_hours(obs: DataFrame, start: str, end: str, min_uptime: float, key: str = "sensor_id", ts: str = "ts",
                 value: str = "value") -> DataFrame:
    """F7 on readings that are unique per (sensor, hour): the axis length is known, so the share
    needs no unrolled hours."""
    share = F.count(value) / F.timestamp_diff("HOUR", ntz(start), ntz(end))
    inside = obs.where((F.col(ts) >= ntz(start)) & (F.col(ts) < ntz(end)))
    return inside.groupBy(key).agg(share.alias("_share")).where(F.col("_share") >= min_uptime).select(key)


def mask_cells(readings: DataFrame, mask: DataFrame, value: str = "value") -> DataFrame:
    """readings whose cell is masked 0 are skipped."""
    return readings.join(mask.where(F.col(value) == 0).select("x", "y"), ["x", "y"], "left_anti")


def mask_report(sensors: DataFrame, mask: DataFrame, value: str = "value") -> DataFrame:
    """how many sensors the mask keeps and drops."""
    open_cell = F.coalesce(F.col(f"m.{value}"), F.lit(1)) != 0
    joined = sensors.alias("s").join(mask.alias("m"), ["x", "y"], "left")
    return joined.agg(F.count(F.lit(1)).alias("n_sensors"),
                      F.count_if(open_cell).alias("n_kept"),
                      F.count_if(~open_cell).alias("n_masked"))


def coverage_gate(pixels: DataFrame, threshold: float, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """null every pixel of a frame whose non-null share is below ``threshold``."""
    share = pixels.groupBy(*frame).agg((F.count(value) / F.count(F.lit(1))).alias("_share"))
    return (pixels.join(share, list(frame))
                  .withColumn(value, F.when(F.col("_share") >= threshold, F.col(value))).drop("_share"))


def event_window(df: DataFrame, center: str, days: int | None = None, until: str | None = None,
                 zone: str | None = None, ts: str = "ts") -> DataFrame:
    """strict window around ``center`` (``days``) or forward from it (``until``), in local time if asked."""
    at = local_time(ts, zone) if zone else F.col(ts)
    low = ntz(center) if until else F.timestamp_add("DAY", F.lit(-days), ntz(center))
    high = ntz(until) if until else F.timestamp_add("DAY", F.lit(days), ntz(center))
    return df.where((at > low) & (at < high))


def trim_outliers(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """keep rows where every column has |z| < limit, population deviation over the table."""
    stats = one_row(df.agg(*[f(c).alias(f"{t}_{c}") for c in columns
                             for t, f in (("m", F.avg), ("s", F.stddev_pop))]))
    out = df.withColumn("_p", stats)
    for c in columns:
        out = out.where(F.abs(F.col(c) - F.col(f"_p.m_{c}")) < limit * F.col(f"_p.s_{c}"))
    return out.drop("_p")


def drop_dead_readings(forecasts: DataFrame, truth: str = "y_true") -> DataFrame:
    """samples whose truth is exactly zero come from a dead sensor."""
    return forecasts.where(F.col(truth) != 0)


def bounded_or_all(stations: DataFrame, inside: Column) -> DataFrame:
    """stations inside the bounds, or all of them when none is."""
    any_inside = stations.agg(F.coalesce(F.max(inside), F.lit(False)).alias("any")).scalar()
    return stations.where(inside | ~any_inside)


# The pair of derived channels that comes along with the wind components.
WIND_COMPONENTS, WIND_DERIVED = ("wind_u", "wind_v"), ("wind_speed", "wind_direction")


def select_channels(df: DataFrame, channels: Sequence[str], groups: Mapping[str, Sequence[str]] | None = None,
                    column: str = "channel") -> DataFrame:
    """explicit channel list, or group flags expanded by ``groups``."""
    wanted = {m for c in channels for m in (groups or {}).get(c, (c,))}
    if wanted & set(WIND_COMPONENTS):
        wanted |= set(WIND_DERIVED)
    return df.where(F.col(column).isin(*sorted(wanted)))


def subset_targets(forecasts: DataFrame, first_frames: int, stations: Sequence | None = None,
                   horizon: str = "horizon", station: str = "sensor_id") -> DataFrame:
    """F26"""
    out = forecasts.where(F.col(horizon) <= first_frames)
    return out if stations is None else out.where(F.col(station).isin(*stations))


def resolve_variables(long: DataFrame, synonyms: DataFrame, name: str = "name") -> DataFrame:
    """F27, long form: rows of the first present synonym of each canonical variable.

    ``synonyms`` has (variable, name, priority); lowest priority wins.
    """
    present = long.select(name).distinct().join(synonyms, name)
    chosen = present.groupBy("variable").agg(F.min_by(name, "priority").alias(name))
    return long.join(chosen, name)


def resolve_columns(df: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """F27, wide form: rename the first present synonym; an absent variable is an error."""
    picked = []
    for variable, names in synonyms.items():
        found = next((n for n in names if n in df.columns), None)
        if found is None:
            raise ValueError(f"no column for {variable}: tried {', '.join(names)}")
        picked.append(F.col(found).alias(variable))
    rest = [c for c in df.columns if not any(c in names for names in synonyms.values())]
    return df.select(*rest, *picked)


def zscore_to_null(df: DataFrame, limit: float = 3.0, key: str = "sensor_id", value: str = "value",
                   scaffold: bool = False) -> DataFrame:
    """Null readings more than ``limit`` sample deviations from their sensor's mean.

    Raw readings: aggregate and join, so that a sensor holding a large share of the rows is
    combined before the shuffle.  On a ``scaffold`` a sensor's rows are bounded by the axis and
    already partitioned, so a window does it without touching the input twice.  A single reading
    has no deviation and is kept.
    """
    mean, sd = F.avg(value), F.stddev_samp(value)
    if scaffold:
        own = Window.partitionBy(key)
        rows = df.withColumn("_m", mean.over(own)).withColumn("_s", sd.over(own))
    else:
        rows = df.join(df.groupBy(key).agg(mean.alias("_m"), sd.alias("_s")), key)
    far = F.abs((F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))) > limit
    return rows.withColumn(value, F.when(~F.coalesce(far, F.lit(False)), F.col(value))).drop("_m", "_s")


def outlier_counts(df: DataFrame, limit: float = 3.0, key: str = "sensor_id", value: str = "value") -> DataFrame:
    """Number of outliers per sensor."""
    kept = zscore_to_null(df.withColumn("_raw", F.col(value)), limit, key, value)
    return kept.groupBy(key).agg((F.count("_raw") - F.count(value)).alias("n_outliers"))


def sparse_hours_to_null(scaffold: DataFrame, min_reporting: float = 0.3, ts: str = "ts", value: str = "value") -> DataFrame:
    """Null an hour when at most int(min_reporting * sites) of its sensors report.

    Every hour of a scaffold has one row per site: the number of sites is the hour's row count,
    and the hour windows are of equal size.
    """
    hour = Window.partitionBy(ts)
    ok = F.count(value).over(hour) > F.floor(F.lit(float(min_reporting)) * F.count(F.lit(1)).over(hour))
    return scaffold.withColumn("_ok", ok).withColumn(value, F.when(F.col("_ok"), F.col(value))).drop("_ok")
