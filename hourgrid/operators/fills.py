"""Scaffolds, gap filling, recursive smoothing and series encodings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hourgrid.functions import rolling
from hourgrid.functions.columns import hour_floor, hour_index, ntz, plus_hours


def hours_axis(spark: SparkSession, start: str, end: str, name: str = "ts") -> DataFrame:
    """All hours of [start, end)."""
    n = int((pd.Timestamp(end) - pd.Timestamp(start)) / pd.Timedelta(hours=1))
    return spark.range(n).select(plus_hours(ntz(start), F.col("id").cast("int")).alias(name))


def on_axis(start: str, end: str, ts: str = "ts") -> Column:
    return (F.col(ts) >= ntz(start)) & (F.col(ts) < ntz(end))


def each_hour(start: str, end: str) -> Column:
    """Explode one row into the hours of [start, end)."""
    return F.explode(F.sequence(ntz(start), plus_hours(ntz(end), -1), F.expr("INTERVAL 1 HOUR")))


def hour_scaffold(obs: DataFrame, start: str, end: str, keys: Sequence[str] = ("sensor_id",),
                  ts: str = "ts") -> DataFrame:
    """One row per sensor and hour for every sensor that reports inside the range.

    ``obs`` holds at most one row per (sensor, hour), so a sensor's rows are bounded by the axis.
    Each reading is unrolled over the hours up to the next one (the first also over those before
    it): one shuffle by sensor, no join of axis and sensors, the readings are computed once, and
    the windows that follow find their partitioning in place.  Readings that are not on a whole
    hour have no slot on the axis and drop out; round or aggregate them to hours first (T1, J2).
    """
    hour = F.expr("INTERVAL 1 HOUR")
    w = Window.partitionBy(*keys).orderBy(ts)
    low = F.when(F.row_number().over(w) == 1, ntz(start)).otherwise(F.col(ts))
    high = plus_hours(F.coalesce(F.lead(ts).over(w), ntz(end)), -1)
    whole = F.col(ts) == hour_floor(ts)
    spans = obs.where(on_axis(start, end, ts) & whole).withColumn("_low", low).withColumn("_high", high)
    slots = spans.withColumn("_slot", F.explode(F.sequence("_low", "_high", hour)))
    own = F.col("_slot") == F.col(ts)
    rest = [c for c in obs.columns if c not in (*keys, ts)]
    return slots.select(*keys, F.col("_slot").alias(ts), *[F.when(own, F.col(c)).alias(c) for c in rest])


def last_write_per_hour(obs: DataFrame, hour: Column, order: str, key: str = "sensor_id",
                        value: str = "value") -> DataFrame:
    """Several readings for one (sensor, hour): the last written one stays."""
    return (obs.withColumn("_h", hour).groupBy(key, "_h")
               .agg(F.max_by(value, order).alias(value)).withColumnRenamed("_h", "ts"))


def fill_series(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ("sensor_id",), ts: str = "ts",
                backward: bool = True) -> DataFrame:
    """Forward fill, then back fill, within a sensor's hourly rows (bounded by the axis).

    After the forward fill only leading rows are open, and all of them take the first value of
    the series: one pass over the whole partition.  A frame that runs from each row to the end
    would cost the square of the axis.
    """
    w = Window.partitionBy(*key).orderBy(ts)
    past, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in columns:
        filled = F.last(c, ignorenulls=True).over(past)
        if backward:
            filled = F.coalesce(filled, F.first(c, ignorenulls=True).over(whole))
        df = df.withColumn(c, filled)
    return df


def fill_dead_hours(df: DataFrame, key: str = "sensor_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """Only hours in which no sensor reports take the filled values.

    Runs on a scaffold: every hour has one row per sensor, so the hour windows are of equal size.
    """
    both = fill_series(df.withColumn("_raw", F.col(value)), [value], [key], ts)
    dead = F.count("_raw").over(Window.partitionBy(ts)) == 0
    return both.withColumn(value, F.when(dead, F.col(value)).otherwise(F.col("_raw"))).drop("_raw")


# ------------------------------------------------------------------ frame-level rules
def frame_sources(axis: DataFrame, frames: DataFrame, lead_back_fill: str = "all", ts: str = "ts") -> DataFrame:
    """For every hour, the hour whose frame it shows (``src_ts``), or NULL.

    ``frames`` is one row per frame that holds data.  The window runs over the axis only: a
    few rows per day, never pixels.  ``lead_back_fill``: ``all`` leading hours take the first
    frame, ``first`` only the very first hour does, ``none`` leaves them open.
    """
    marked = axis.join(frames.select(F.col(ts), F.col(ts).alias("_has")), ts, "left")
    w = Window.orderBy(ts)
    carried = F.last("_has", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    opening = F.first("_has", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    if lead_back_fill == "all":
        carried = F.coalesce(carried, opening)
    elif lead_back_fill == "first":
        carried = F.coalesce(carried, F.when(F.row_number().over(w) == 1, opening))
    return marked.select(ts, F.col("_has").isNotNull().alias("is_valid"), carried.alias("src_ts"))


def carry_frames(grid: DataFrame, axis: DataFrame, lead_back_fill: str = "all", ts: str = "ts",
                 value: str = "value") -> DataFrame:
    """An hour without any reading repeats the last frame; leading hours are back filled."""
    frames = grid.where(F.col(value).isNotNull()).select(ts).distinct()
    source = frame_sources(axis, frames, lead_back_fill, ts)
    return (source.join(grid.withColumnRenamed(ts, "src_ts"), "src_ts", "left")
                  .where(F.col(value).isNotNull()).select(ts, "src_ts", "x", "y", value))


def fill_status(axis: DataFrame, granules: DataFrame, ts: str = "ts") -> DataFrame:
    """T14 log: ``granules`` has one row per delivered hour with ``ok`` = passed the quality gate."""
    marked = axis.join(granules.select(ts, "ok"), ts, "left")
    w = Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    source = F.last(F.when(F.col("ok"), F.col(ts)), ignorenulls=True).over(w)
    out = marked.withColumn("src_ts", source)
    status = (F.when(F.col("ok"), "valid")
               .when(F.col("src_ts").isNull(), "zero_no_prior")
               .when(F.col("ok").isNull(), "forward_fill_missing")
               .otherwise("forward_fill_bad_qa"))
    return out.select(ts, "src_ts", status.alias("status"))


def carry_or_zero(grid: DataFrame, status: DataFrame, dim: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Show the carried frame, or a zero frame when nothing came before."""
    frame = F.explode(F.sequence(F.lit(0), F.lit(dim * dim - 1)))
    slots = (status.withColumn("_k", frame)
                   .select(ts, "src_ts", "status", F.expr(f"_k div {dim}").cast("int").alias("x"),
                           (F.col("_k") % dim).cast("int").alias("y")))
    held = grid.select(F.col(ts).alias("src_ts"), "x", "y", value)
    empty = F.when(F.col("src_ts").isNull(), F.lit(0.0))
    return slots.join(held, ["src_ts", "x", "y"], "left").select(
        ts, "x", "y", "status", F.coalesce(F.col(value), empty).alias(value))


def fill_audit(shown: DataFrame, status: DataFrame, grid: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """T14 self-check: hours per status, and shown cells that differ from the frame they repeat."""
    held = grid.select(F.col(ts).alias("src_ts"), "x", "y", F.col(value).alias("_held"))
    pairs = shown.drop("status").join(status, ts).join(held, ["src_ts", "x", "y"], "left")
    wrong = ~F.col(value).eqNullSafe(F.when(F.col("src_ts").isNull(), F.lit(0.0)).otherwise(F.col("_held")))
    cells = pairs.groupBy("status").agg(F.count_if(wrong).alias("n_wrong_cells"))
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n_hours")).join(cells, "status")


def zero_missing_hours(grid: DataFrame, axis: DataFrame, dim: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """An hour with no frame at all becomes a zero frame; gaps inside a frame stay open."""
    have = grid.select(ts).distinct()
    frame = F.explode(F.sequence(F.lit(0), F.lit(dim * dim - 1)))
    zero = axis.join(have, ts, "left_anti").withColumn("_k", frame).select(
        ts, F.expr(f"_k div {dim}").cast("int").alias("x"), (F.col("_k") % dim).cast("int").alias("y"),
        F.lit(0.0).alias(value))
    return grid.select(ts, "x", "y", value).unionByName(zero)


def zero_background(grid: DataFrame, sparse_product: Column, value: str = "value") -> DataFrame:
    """Missing pixels of sparse products (fire mask, temperature, area, power) are 0, not gaps."""
    return grid.withColumn(value, F.when(sparse_product, F.coalesce(F.col(value), F.lit(0.0))).otherwise(F.col(value)))


def fill_with_frame_mean(grid: DataFrame, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """T16"""
    mean = grid.groupBy(*frame).agg(F.avg(value).alias("_mean"))
    return grid.join(mean, list(frame)).withColumn(value, F.coalesce(F.col(value), F.col("_mean"))).drop("_mean")


def gap_neighbours(days: DataFrame, have: DataFrame, day: str = "day") -> DataFrame:
    """T17 plan per day: the data day before and after, and the position inside the gap."""
    marked = days.join(have.select(day, F.col(day).alias("_has")), day, "left")
    w = Window.orderBy(day)
    before = F.last("_has", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_has", ignorenulls=True).over(Window.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(w)
    return (marked.select(day, before.alias("before_day"), after.alias("after_day"), n.alias("_n"),
                          F.max(F.when(F.col("_has").isNotNull(), n)).over(
                              w.rowsBetween(Window.unboundedPreceding, 0)).alias("_last"))
                  .select(day, "before_day", "after_day", (F.col("_n") - F.col("_last")).cast("int").alias("gap_pos")))


def fill_day_gaps(grid: DataFrame, days: DataFrame, day: str = "day", value: str = "value") -> DataFrame:
    """The j-th missing day of a gap is after + (before - after) / 2^j; one-sided gaps copy.  A day
    whose values are all missing or zero counts as missing.

    Windows run over the day table; pixels only meet equi-joins.
    """
    have = grid.groupBy(day).agg(F.sum(F.abs(value)).alias("_level")).where("_level > 0").select(day)
    plan = gap_neighbours(days, have, day)
    side = lambda d, v: grid.select(F.col(day).alias(d), "x", "y", F.col(value).alias(v))
    # Per day the cells of either neighbour: union keeps it an equi-join on both sides.
    wanted = (plan.join(side("before_day", "_b"), "before_day")
                  .select(day, "x", "y", "gap_pos", F.col("_b"), F.lit(None).cast("double").alias("_a"))
                  .unionByName(plan.join(side("after_day", "_a"), "after_day")
                  .select(day, "x", "y", "gap_pos", F.lit(None).cast("double").alias("_b"), F.col("_a"))))
    both = wanted.groupBy(day, "x", "y").agg(F.max("gap_pos").alias("gap_pos"), F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    mixed = F.col("_a") + (F.col("_b") - F.col("_a")) / F.pow(F.lit(2.0), F.col("gap_pos"))
    out = F.when(F.col("gap_pos") == 0, F.col("_b")).otherwise(F.coalesce(mixed, F.col("_b"), F.col("_a")))
    return both.select(day, "x", "y", out.alias(value))


def frame_state(grid: DataFrame, measure: str = "abs_sum", channel: str = "channel", ts: str = "ts", value: str = "value") -> DataFrame:
    """Per (channel, frame): does it hold data (``_full``), and did a full frame come before it (``_after``)?"""
    level = F.sum(F.abs(value)) if measure == "abs_sum" else F.max(value)
    state = grid.groupBy(channel, ts).agg(F.coalesce(level > 0, F.lit(False)).alias("_full"))
    first = F.min(F.when(F.col("_full"), F.col(ts))).over(Window.partitionBy(channel))     # frames, not pixels
    return state.withColumn("_after", F.coalesce(F.col(ts) > first, F.lit(False)))


def recursive_smooth(grid: DataFrame, keep: float, fade: float = 1.0, measure: str = "abs_sum",
                     channel: str = "channel", ts: str = "ts", value: str = "value", state: DataFrame | None = None) -> DataFrame:
    """s(t) = keep*s(t-1) + (1-keep)*v(t); an empty frame shows fade*s(t-1), and so does a
    missing pixel.  A cell without any value so far stays missing and starts with its first one.

    Whether a frame is empty is decided on all its cells (``frame_state``, or a given one).  The
    recursion then runs over the hours of one row of cells at a time, a vector step per hour.
    """
    marked = grid.join(frame_state(grid, measure, channel, ts, value) if state is None else state, [channel, ts])
    marked = marked.select(channel, ts, "x", "y", value, "_full", "_after")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hour, times = pd.factorize(pdf[ts], sort=True)
        cell, cells = pd.factorize(pdf["y"], sort=True)
        v = np.full((len(times), len(cells)), np.nan)
        v[hour, cell] = pdf[value].to_numpy(float)
        full, after = np.zeros(len(times), bool), np.zeros(len(times), bool)
        full[hour], after[hour] = pdf["_full"], pdf["_after"]
        state = np.full(len(cells), np.nan)
        for t in range(len(times)):
            if after[t]:
                new = v[t] * (1.0 - keep) + state * keep if full[t] else np.full(len(cells), np.nan)
                v[t] = np.where(np.isnan(new), np.where(np.isnan(state), v[t] if full[t] else np.nan, state * fade), new)
            state = np.where(np.isnan(v[t]), state, v[t])
        out = v[hour, cell]
        return pd.DataFrame({channel: pdf[channel], ts: pdf[ts], "x": pdf["x"], "y": pdf["y"], value: out})

    schema = marked.select(channel, ts, "x", "y", value).schema
    return marked.groupBy(channel, "x").applyInPandas(run, schema)


# ------------------------------------------------------------------ series
def nowcast(scaffold: DataFrame, key: Sequence[str] = ("sensor_id",), ts: str = "ts", value: str = "value",
            out: str = "nowcast", window: int = 12) -> DataFrame:
    """Weighted mean of the last ``window`` hours, truncated to 0.1.

    NULL with fewer than ``window`` rows or two of the last three hours missing; 0 when the
    largest is 0.  The weighted sums are folded oldest to newest, which needs no powers.
    """
    w = Window.partitionBy(*key).orderBy(ts)
    past = [F.lag(value, k).over(w) if k else F.col(value) for k in range(window - 1, -1, -1)]
    names = [f"_v{i}" for i in range(window)]
    wide = scaffold.select("*", F.row_number().over(w).alias("_n"), *[p.alias(n) for p, n in zip(past, names)])
    seen = [F.col(n) for n in names]
    high, low = F.greatest(*seen), F.least(*seen)
    wide = wide.withColumn("_hi", high).withColumn("_w", F.greatest(F.lit(0.5), 1 - (high - low) / F.nullif(high, F.lit(0.0))))
    num, den = F.lit(0.0), F.lit(0.0)
    for v in seen:
        num = num * F.col("_w") + F.coalesce(v, F.lit(0.0))
        den = den * F.col("_w") + F.when(v.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    missing = sum((v.isNull().cast("int") for v in seen[-3:]), F.lit(0))
    res = num / F.nullif(den, F.lit(0.0))
    cut = F.greatest(F.lit(0.0), F.when(res >= 0, F.floor(res * 10)).otherwise(F.ceil(res * 10)) / 10)
    value_of = (F.when((F.col("_n") < window) | (missing >= 2), F.lit(None).cast("double"))
                 .when(F.col("_hi") == 0, F.lit(0.0)).otherwise(cut))
    return wide.withColumn(out, value_of).drop("_n", "_hi", "_w", *names)


def rolling_mean(df: DataFrame, n: int, key: Sequence[str] = ("sensor_id",), ts: str = "ts",
                 value: str = "value", out: str | None = None) -> DataFrame:
    """Mean of the last ``n`` rows, full windows without gaps only.  Long frames cost no more than short ones."""
    w, out = Window.partitionBy(*key).orderBy(ts), out or f"mean_{n}"
    if n <= rolling.SHORT:
        own = w.rowsBetween(-(n - 1), 0)
        return df.withColumn(out, F.when(F.count(value).over(own) == n, F.avg(value).over(own)))
    placed = df.withColumn("_row", F.row_number().over(w).cast("long"))
    sums = rolling.frame_sums(placed, key, "_row", -(n - 1), 0, {"_frame": F.col(value)})
    return sums.withColumn(out, F.when(F.col("_frame.n") == n, F.col("_frame.total") / n)).drop("_row", "_frame")


def climatology(grid: DataFrame, start: str, days: int = 30, key: Sequence[str] = ("x", "y"),
                ts: str = "ts", value: str = "value", out: str = "climatology") -> DataFrame:
    """Mean of the same hour of day over the ``days`` days before; own value if none.

    The frame goes by days, not by rows: over a gap fewer values count.
    """
    hour = hour_index(ts, start).cast("long")
    days_of = (grid.withColumn("_hour", F.pmod(hour, F.lit(24)))
                   .withColumn("_day", ((hour - F.col("_hour")) / 24).cast("long")))
    sums = rolling.frame_sums(days_of, [*key, "_hour"], "_day", -days, -1, {"_frame": F.col(value)})
    return (sums.withColumn(out, F.coalesce(F.col("_frame.total") / F.nullif("_frame.n", F.lit(0)), F.col(value)))
                .drop("_hour", "_day", "_frame"))


def lagged(df: DataFrame, n: int, out: str, key: Sequence[str] = ("sensor_id",), ts: str = "ts",
           value: str = "value") -> DataFrame:
    """T24 (n < 0 leads) and the shifted column of T23."""
    return df.withColumn(out, F.lag(value, n).over(Window.partitionBy(*key).orderBy(ts)))


def autocorrelation(df: DataFrame, lag: int = 1, key: Sequence[str] = ("sensor_id",), ts: str = "ts",
                    value: str = "value") -> DataFrame:
    """T23"""
    return lagged(df, lag, "_lag", key, ts, value).groupBy(*key).agg(F.corr(value, "_lag").alias("autocorrelation"))


def hourly_difficulty(df: DataFrame, key: Sequence[str] = ("sensor_id",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean absolute hour-to-hour change in percent of the mean."""
    step = lagged(df, 1, "_lag", key, ts, value)
    return step.groupBy(*key).agg(
        (F.avg(F.abs(F.col(value) - F.col("_lag"))) / F.avg(value) * 100).alias("difficulty_pct"))


def station_policy(df: DataFrame, signed: Sequence[str], unsigned: Sequence[str], key: str = "station",
                   order: str = "ts", info: Sequence[str] = ("lat", "lon"), report: str = "valid") -> DataFrame:
    """Missing stays NULL for signed variables and is -1 for others; report time defaults
    to 1900-01-01; station facts are back filled along the axis."""
    w = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    cols = [F.col(key), F.col(order)]
    cols += [F.last(c, ignorenulls=True).over(w).alias(c) for c in info]
    cols += [F.coalesce(F.col(report), ntz("1900-01-01")).alias(report)]
    cols += [F.col(c) for c in signed] + [F.coalesce(F.col(c), F.lit(-1.0)).alias(c) for c in unsigned]
    return df.select(*cols)
