"""Forecast scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hourgrid.functions import rolling
from hourgrid.functions.columns import one_row

# Bucket edges of the station ranking.
RMSE_BUCKETS = ((1.5, "excellent"), (3.0, "good"), (5.0, "fair"))
RELIABLE_RMSE = 3.0
EPS = 2.220446049250313e-16  # double rounding unit, floor of the relative-error divisor


def error_metrics(true: str = "y_true", pred: str = "y_pred", prefix: str = "", when: Column | None = None) -> list[Column]:
    """M1-M4 as one pass of combinable aggregates over (optionally conditional) rows."""
    t, p = F.col(true), F.col(pred)
    if when is not None:
        t, p = F.when(when, t), F.when(when, p)
    rmse = F.sqrt(F.avg(F.pow(p - t, 2)))
    paired = F.when(p.isNotNull(), t)
    return [
        rmse.alias(f"{prefix}rmse"),
        F.avg(F.abs(p - t)).alias(f"{prefix}mae"),
        (1 - F.sum(F.pow(t - p, 2)) / F.nullif(F.var_pop(paired) * F.count(paired), F.lit(0.0))).alias(f"{prefix}r2"),
        (rmse / F.nullif(F.avg(paired), F.lit(0.0)) * 100).alias(f"{prefix}nrmse"),
        (F.avg(F.abs(p - t) / F.greatest(F.abs(t), F.lit(EPS))) * 100).alias(f"{prefix}mape"),
    ]


def score(forecasts: DataFrame, *keys: str, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """M1-M5, M7, M8: metrics pooled per key (none: over everything)."""
    return forecasts.groupBy(*keys).agg(*error_metrics(true, pred))


def rmse_matrix(forecasts: DataFrame, horizons: Sequence[int], sensor: str = "sensor_id",
                horizon: str = "horizon") -> DataFrame:
    """M6: RMSE per sensor and hour; margins are means of the cell RMSEs, not pooled RMSEs.

    The row labelled ``all`` holds the column means and the overall mean.
    """
    cell = forecasts.groupBy(sensor, horizon).agg(F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("y_true"), 2))).alias("r"))
    hours = [F.avg(F.when(F.col(horizon) == h, F.col("r"))).alias(f"h{h}") for h in horizons]
    rows = cell.groupBy(F.col(sensor).cast("string").alias(sensor)).agg(*hours, F.avg("r").alias("mean_rmse"))
    foot = cell.agg(*hours, F.avg("r").alias("mean_rmse")).select(F.lit("all").alias(sensor), "*")
    return rows.unionByName(foot)


def bucket(rmse: str = "rmse") -> Column:
    out = None
    for edge, name in RMSE_BUCKETS:
        out = (F.when if out is None else out.when)(F.col(rmse) < edge, name)
    return out.otherwise("poor")


def station_ranking(forecasts: DataFrame, sensor: str = "sensor_id") -> DataFrame:
    """M7: RMSE per station, best first, with its quality bucket."""
    return score(forecasts, sensor).select(sensor, "rmse", bucket().alias("bucket")).orderBy("rmse", sensor)


def station_summary(forecasts: DataFrame, sensor: str = "sensor_id") -> DataFrame:
    """M7: best and worst station, mean, range, count per bucket and reliable share."""
    r = station_ranking(forecasts, sensor)
    counts = [F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in ("excellent", "good", "fair", "poor")]
    return r.agg(F.min_by(sensor, F.struct("rmse", sensor)).alias("best"),
                 F.max_by(sensor, F.struct("rmse", sensor)).alias("worst"),
                 F.avg("rmse").alias("mean_rmse"), (F.max("rmse") - F.min("rmse")).alias("rmse_range"), *counts,
                 (F.count_if(F.col("rmse") < RELIABLE_RMSE) / F.count(F.lit(1)) * 100).alias("reliable_pct"))


def sensor_hour_table(forecasts: DataFrame, sensor: str = "sensor_id", horizon: str = "horizon") -> DataFrame:
    """M8: all metrics per (hour, sensor) and whether the sensor is the hour's best or worst."""
    table = forecasts.groupBy(horizon, sensor).agg(
        *error_metrics(), F.avg("y_true").alias("mean_true"), F.avg("y_pred").alias("mean_pred"))
    ends = table.groupBy(horizon).agg(F.min(F.struct("rmse", sensor)).alias("_b"), F.max(F.struct("rmse", sensor)).alias("_w"))
    return (table.join(ends, horizon)
                 .withColumn("is_best", F.col(sensor) == F.col(f"_b.{sensor}"))
                 .withColumn("is_worst", F.col(sensor) == F.col(f"_w.{sensor}")).drop("_b", "_w", "mape"))


def worst_pairs(forecasts: DataFrame, n: int = 5, sensor: str = "sensor_id", horizon: str = "horizon") -> DataFrame:
    """M9"""
    return (score(forecasts, sensor, horizon).select(sensor, horizon, "rmse")
            .orderBy(F.desc("rmse"), sensor, horizon).limit(n))


def persistence_report(forecasts: DataFrame, keys: Sequence[str] = ("sensor_id", "horizon"),
                       order: str = "sample_id", first_frame_only: bool = False) -> DataFrame:
    """The naive baseline (next truth against this one), the model, and the model shifted
    by one sample, all against consecutive samples of one station and hour."""
    if first_frame_only:
        forecasts = forecasts.where(F.col("horizon") == 1)
    w = Window.partitionBy(*keys).orderBy(order)
    rows = forecasts.withColumn("_next_true", F.lead("y_true").over(w)).withColumn("_next_pred", F.lead("y_pred").over(w))
    pairs = F.explode(F.array(
        F.struct(F.lit("baseline").alias("kind"), F.col("y_true").alias("t"), F.col("_next_true").alias("p")),
        F.struct(F.lit("model").alias("kind"), F.col("y_true").alias("t"), F.col("y_pred").alias("p")),
        F.struct(F.lit("model_shifted").alias("kind"), F.col("y_true").alias("t"), F.col("_next_pred").alias("p"))))
    return (rows.select(pairs.alias("e")).select("e.*").where(F.col("p").isNotNull())
                .groupBy("kind").agg(*error_metrics("t", "p")))


def extreme_weeks(forecasts: DataFrame, rows: int, keys: Sequence[str] = ("sensor_id",), order: str = "sample_id") -> DataFrame:
    """Start of the best and worst run of ``rows`` consecutive samples by NRMSE.

    The last possible start is excluded; the first wins a tie.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    placed = forecasts.select(
        *keys, order, "y_true", "y_pred", F.row_number().over(w).cast("long").alias("_i"),
        F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    sized = rolling.frame_sums(placed, keys, "_i", 0, rows - 1, {
        "_square": F.pow(F.col("y_pred") - F.col("y_true"), 2), "_true": F.col("y_true")})
    mean = lambda c: F.col(f"{c}.total") / F.nullif(F.col(f"{c}.n"), F.lit(0))
    runs = (sized.where(F.col("_i") <= F.col("_n") - rows)
                 .withColumn("nrmse", F.sqrt(mean("_square")) / F.nullif(mean("_true"), F.lit(0.0)) * 100))
    best, worst = F.struct("nrmse", order), F.struct(F.col("nrmse"), -F.col(order))
    return runs.groupBy(*keys).agg(
        F.min_by(order, best).alias("best_start"), F.min("nrmse").alias("best_nrmse"),
        F.max_by(order, worst).alias("worst_start"), F.max("nrmse").alias("worst_nrmse"))


def extreme_samples(forecasts: DataFrame, n: int = 10, sample: str = "sample_id") -> DataFrame:
    """The ``n`` samples with the smallest and the ``n`` with the largest RMSE."""
    r = score(forecasts, sample).select(sample, "rmse").where(F.col("rmse").isNotNull())
    best = r.orderBy("rmse", sample).limit(n).withColumn("kind", F.lit("best"))
    worst = r.orderBy(F.desc("rmse"), F.desc(sample)).limit(n).withColumn("kind", F.lit("worst"))
    return best.unionByName(worst)


def region_scores(forecasts: DataFrame, regions: DataFrame, horizon: str = "horizon") -> DataFrame:
    """NRMSE per region and hour, and the region's mean over hours.

    ``regions`` (region, x, y) has at most three rows per grid cell.
    """
    rows = forecasts.join(regions, ["x", "y"])
    hourly = rows.groupBy("region", horizon).agg(
        (F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("y_true"), 2))) / (F.avg("y_true") + 1e-8) * 100).alias("nrmse"))
    return hourly.withColumn("region_mean", F.avg("nrmse").over(Window.partitionBy("region")))


def weighted_mae(forecasts: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean of |t - p| * w, not divided by the sum of weights."""
    return (forecasts.join(weights, ["x", "y"])
                     .agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred")) * F.col("weight")).alias("weighted_mae")))


def sensor_error_series(forecasts: DataFrame, horizon: int, sensor: str = "sensor_id") -> DataFrame:
    """Truth, prediction and error of one horizon, with the sensor's MAE on every row."""
    rows = forecasts.where(F.col("horizon") == horizon).withColumn("abs_error", F.abs(F.col("y_pred") - F.col("y_true")))
    return rows.join(rows.groupBy(sensor).agg(F.avg("abs_error").alias("mae")), sensor)


def best_epoch(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Epoch of the smallest validation loss, the first on ties."""
    return log.groupBy(run).agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"),
                                F.min("val_loss").alias("best_val_loss"))


def leaderboard(runs: DataFrame, by: str, n: int = 10, tie: str = "run_id") -> DataFrame:
    """M19"""
    return runs.orderBy(by, tie).limit(n)


def error_grid(forecasts: DataFrame) -> DataFrame:
    """Signed error per cell with the shared colour range of the whole table."""
    span = one_row(forecasts.agg(
        F.least(F.min("y_true"), F.min("y_pred")).alias("range_min"),
        F.greatest(F.max("y_true"), F.max("y_pred")).alias("range_max"),
        F.max(F.abs(F.col("y_pred") - F.col("y_true"))).alias("max_abs_error")))
    return (forecasts.withColumn("error", F.col("y_pred") - F.col("y_true")).withColumn("_p", span)
                     .select("*", "_p.*").drop("_p"))
