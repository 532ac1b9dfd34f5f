"""Summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hourgrid.functions.columns import one_row
from hourgrid.functions.quantiles import exact_quantiles, stored
from hourgrid.operators.samples import shuffle_key

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def rows_per(df: DataFrame, *keys: str) -> DataFrame:
    """A1, A16"""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def uptime(df: DataFrame, keys: Sequence[str] = ("sensor_id",), ts: str = "ts") -> DataFrame:
    """A1: share of the table's time steps each sensor has, highest first."""
    steps = df.select(ts).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return (rows_per(df, *keys).withColumn("uptime_pct", F.col("n_rows") / steps * 100)
                               .orderBy(F.desc("uptime_pct"), *keys))


def hourly_network_mean(df: DataFrame, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """A2, A7"""
    return df.groupBy(ts).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def to_series(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide columns to (series, value) rows."""
    return df.unpivot(list(keep), list(columns), "series", "value")


def describe(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, split-safe for hot keys."""
    return exact_quantiles(df, keys, value, QUARTILES, [
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max")])


def share_of(df: DataFrame, predicates: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """A5: percentage of rows that meet each predicate."""
    return df.groupBy(*keys).agg(*[(F.avg(F.coalesce(p, F.lit(False)).cast("int")) * 100).alias(n)
                                   for n, p in predicates.items()])


def mean_and_spread(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and population deviation."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def channel_stats(grid: DataFrame, keys: Sequence[str] = ("channel",), value: str = "value") -> DataFrame:
    """A8"""
    return grid.groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        (F.count_if(F.col(value) != 0) / F.count(F.lit(1)) * 100).alias("nonzero_pct"))


def histogram(df: DataFrame, value: str = "value", bins: int = 30) -> DataFrame:
    """Equal bins over [min, max]; the maximum belongs to the last bin."""
    bounds = one_row(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    at = F.floor((F.col(value) - F.col("_p.lo")) * bins / (F.col("_p.hi") - F.col("_p.lo")))
    return (df.where(F.col(value).isNotNull()).withColumn("_p", bounds)
              .select(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


def box_stats(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """A10: quartiles, whiskers at the last value inside 1.5 IQR, mean."""
    keys = list(keys)
    q = exact_quantiles(df, keys, value, QUARTILES)
    if keys:
        q = stored(q, "quartiles")
    reach = 1.5 * (F.col("p75") - F.col("p25"))
    inside = F.col(value).between(F.col("p25") - reach, F.col("p75") + reach)
    return (df.join(q, keys).groupBy(*keys).agg(
        F.first("p25").alias("p25"), F.first("p50").alias("p50"), F.first("p75").alias("p75"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"), F.avg(value).alias("mean")))


def channel_target_correlation(samples: DataFrame, target: str, key: str = "channel", value: str = "value") -> DataFrame:
    """Pearson correlation of every channel with the future target."""
    return samples.groupBy(key).agg(F.corr(value, target).alias("correlation"))


def sample_channel_means(samples: DataFrame, channels: Sequence[str], value: str = "value") -> DataFrame:
    """One row per sample, one mean per channel over frames and cells."""
    return samples.groupBy("sample_id").agg(*[
        F.avg(F.when(F.col("channel") == c, F.col(value))).alias(f"mean_{c}") for c in channels])


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """A13"""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def ablation(runs: DataFrame, flags: Sequence[str], metrics: Sequence[str], rank_by: str) -> DataFrame:
    """Mean of the metrics over the runs that include a channel, best first, plus one baseline
    row for the runs that include none of them."""
    long = runs.unpivot(list(metrics), list(flags), "channel", "used").where(F.col("used") == 1)
    none = runs.where(sum((F.col(f) for f in flags), F.lit(0)) == 0).withColumn("channel", F.lit("baseline"))
    rows = long.select("channel", *metrics).unionByName(none.select("channel", *metrics))
    return (rows.groupBy("channel").agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_runs"))
                .orderBy(rank_by, "channel"))


def active_window(grid: DataFrame, inside: Column, ts: str = "ts", value: str = "value", required: bool = True) -> DataFrame:
    """First and last hour with any cell above zero; no activity is an error, or unless ``required`` a row of NULLs."""
    span = grid.where(inside & (F.col(value) > 0)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    if not required:
        return span
    checked = F.assert_true(F.col("first_ts").isNotNull(), F.lit("no activity in the search span"))
    return span.where(checked.isNull())


def merge_counts(sensors: DataFrame) -> DataFrame:
    """Sensors against the pixels they share."""
    pixels = sensors.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_n"))
    return pixels.agg(F.sum("_n").alias("n_sensors"), F.count(F.lit(1)).alias("n_pixels"))


def sample_frames(df: DataFrame, n: int, seed: int, key: str = "ts") -> DataFrame:
    """``n`` frames drawn without replacement, the same ones for the same seed."""
    picked = (df.select(key).distinct()
                .orderBy(shuffle_key(key, seed), key).limit(n))
    return df.join(picked, key, "left_semi")
