"""A1-A19."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.operators import stats as A
from hourgrid.workload.base import CHANNELS, Tables, query, r6, rounded, s6
from hourgrid.workload.gridding import LAYER, layer


@query("a1_rows_per_hour", "SELECT hour, count(*) AS n_rows FROM readings GROUP BY hour")
def _(t: Tables):
    return A.rows_per(t.readings, "hour")


@query("a1_uptime", f"SELECT sensor_id, count(*) AS n_rows, {s6('count(*) / CAST((SELECT count(DISTINCT ts) FROM hourly) AS DOUBLE) * 100')} AS uptime_pct FROM hourly GROUP BY sensor_id")
def _(t: Tables):
    return rounded(A.uptime(t.hourly), "uptime_pct")


@query("a2_network_mean", f"SELECT ts, {s6('avg(value)')} AS mean_value, {s6('avg(n)')} AS mean_n FROM hourly GROUP BY ts")
def _(t: Tables):
    return rounded(A.hourly_network_mean(t.hourly, ["value", "n"]), "mean_value", "mean_n")


def _describe_sql(src: str, key: str) -> str:
    q = ", ".join(f"{s6(f'quantile_cont(value, {p})')} AS p{n}" for p, n in ((0.25, 25), (0.5, 50), (0.75, 75)))
    return f"SELECT {key}, count(value) AS n, {s6('avg(value)')} AS mean, {s6('stddev_samp(value)')} AS std, min(value) AS min, max(value) AS max, {q} FROM {src} GROUP BY {key}"


_MOMENTS = ("mean", "std", "p25", "p50", "p75")


@query("a3_series_summary", "+ w AS (SELECT 'price' AS series, l_extendedprice AS value FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem) " + _describe_sql("w", "series"))
def _(t: Tables):
    wide = t.raw("lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return rounded(A.describe(A.to_series(wide, wide.columns), ["series"]), *_MOMENTS)


@query("a4_describe_per_sensor", _describe_sql("readings", "sensor_id"))
def _(t: Tables):
    return rounded(A.describe(t.readings, ["sensor_id"]), *_MOMENTS)


@query("a5_predicate_shares", "SELECT channel, " + ", ".join(f"{s6(f'avg(CAST({p} AS INTEGER)) * 100')} AS {n}" for n, p in (("negative", "value < 0"), ("zero", "value = 0"), ("below_half", "value < 0.5e0"), ("below_one", "value < 1"))) + " FROM readings GROUP BY channel")
def _(t: Tables):
    v = F.col("value")
    preds = {"negative": v < 0, "zero": v == 0, "below_half": v < 0.5, "below_one": v < 1}
    return rounded(A.share_of(t.readings, preds, ["channel"]), *preds)


@query("a6_split_statistics", f"SELECT CASE WHEN ts < TIMESTAMP '2024-01-22' THEN 'train' WHEN ts < TIMESTAMP '2024-01-26 12:00:00' THEN 'valid' ELSE 'test' END AS split, {s6('avg(value)')} AS mean, {s6('stddev_pop(value)')} AS std FROM hourly GROUP BY 1")
def _(t: Tables):
    split = F.when(F.col("ts") < "2024-01-22", "train").when(F.col("ts") < "2024-01-26 12:00:00", "valid").otherwise("test")
    return rounded(A.mean_and_spread(t.hourly.withColumn("split", split), ["split"]), "mean", "std")


@query("a7_spatial_mean_series", f"SELECT channel, ts, {s6('avg(value)')} AS value FROM grid GROUP BY channel, ts")
def _(t: Tables):
    return t.grid.groupBy("channel", "ts").agg(r6(F.avg("value"), "value"))


@query("a8_channel_statistics", f"SELECT channel, min(value) AS min, max(value) AS max, {s6('avg(value)')} AS mean, {s6('stddev_pop(value)')} AS std, {s6('count(*) FILTER (WHERE value <> 0) / CAST(count(*) AS DOUBLE) * 100')} AS nonzero_pct FROM (SELECT channel, CASE WHEN value < 5 THEN 0e0 ELSE value END AS value FROM readings) GROUP BY channel")
def _(t: Tables):
    rows = t.readings.select("channel", F.when(F.col("value") < 5, 0.0).otherwise(F.col("value")).alias("value"))
    return rounded(A.channel_stats(rows), "mean", "std", "nonzero_pct")


@query("a9_histogram", "+ b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n FROM events, b GROUP BY 1")
def _(t: Tables):
    return A.histogram(t.raw("events"), "value", 30)


@query("a10_box_statistics", f"""+ q AS (SELECT channel, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM readings GROUP BY channel)
SELECT q.channel, {s6('any_value(p25)')} AS p25, {s6('any_value(p50)')} AS p50, {s6('any_value(p75)')} AS p75, min(value) FILTER (WHERE value BETWEEN p25 - 1.5e0 * (p75 - p25) AND p75 + 1.5e0 * (p75 - p25)) AS whisker_low, max(value) FILTER (WHERE value BETWEEN p25 - 1.5e0 * (p75 - p25) AND p75 + 1.5e0 * (p75 - p25)) AS whisker_high, {s6('avg(value)')} AS mean FROM readings r JOIN q ON q.channel = r.channel GROUP BY q.channel""")
def _(t: Tables):
    return rounded(A.box_stats(t.readings, ["channel"]), "p25", "p50", "p75", "mean")


_FUT = "m AS (SELECT channel, hour AS ts, avg(value) AS value FROM readings GROUP BY channel, hour), f AS (SELECT hour - INTERVAL 1 HOUR AS ts, avg(value) AS target FROM readings GROUP BY hour), s AS (SELECT m.channel, m.ts, m.value, f.target FROM m JOIN f ON f.ts = m.ts)"


def _future(t: Tables):
    r = t.readings
    m = r.groupBy("channel", F.col("hour").alias("ts")).agg(F.avg("value").alias("value"))
    f = r.groupBy(F.timestamp_add("HOUR", F.lit(-1), F.col("hour")).alias("ts")).agg(F.avg("value").alias("target"))
    return m.join(f, "ts")


@query("a11_channel_target_correlation", f"+ {_FUT} SELECT channel, {s6('corr(value, target)')} AS correlation FROM s GROUP BY channel")
def _(t: Tables):
    return rounded(A.channel_target_correlation(_future(t), "target"), "correlation")


@query("a12_sample_channel_means", "SELECT date_diff('day', (SELECT lo FROM axis_span), ts) AS sample_id, " + ", ".join(f"{s6(chr(97) + f'vg(value) FILTER (WHERE channel = {c!r})')} AS mean_{c}" for c in CHANNELS) + f", {s6('avg(value)')} AS mean_all FROM grid GROUP BY 1")
def _(t: Tables):
    rows = t.grid.withColumn("sample_id", F.timestamp_diff("DAY", F.lit(t.start).cast("timestamp_ntz"), F.col("ts")))
    means = A.sample_channel_means(rows, CHANNELS)
    overall = rows.groupBy("sample_id").agg(F.avg("value").alias("mean_all"))
    return rounded(means.join(overall, "sample_id"), *[f"mean_{c}" for c in CHANNELS], "mean_all")


@query("a13_linear_fit", f"+ {LAYER}, p AS (SELECT f.x, f.y, avg(f.value) AS pm, any_value(l.value) AS elevation FROM frame f JOIN layer l ON l.x = f.x AND l.y = f.y GROUP BY f.x, f.y) SELECT {s6('regr_slope(pm, elevation)')} AS slope, {s6('regr_intercept(pm, elevation)')} AS intercept FROM p")
def _(t: Tables):
    means = t.frame.groupBy("x", "y").agg(F.avg("value").alias("pm"))
    return rounded(A.linear_fit(means.join(layer(t).withColumnRenamed("value", "elevation"), ["x", "y"]), "pm", "elevation"), "slope", "intercept")


_FLAGS = ("smoke", "wind", "fire")


def _runs(t: Tables):
    k = F.col("p_partkey")
    flags = [F.when(k % m == 0, 1.0).otherwise(0.0).alias(n) for n, m in zip(_FLAGS, (2, 3, 5))]
    return t.raw("part").select(k.alias("run_id"), *flags, (F.col("p_retailprice") / 100).alias("nrmse"), F.col("p_size").cast("double").alias("rmse"))


@query("a14_channel_ablation", "+ r AS (SELECT p_partkey AS k, p_retailprice / 100 AS nrmse, CAST(p_size AS DOUBLE) AS rmse FROM part), u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS channel, nrmse, rmse FROM r WHERE k % {m} = 0" for n, m in zip(_FLAGS, (2, 3, 5))) + f" UNION ALL SELECT 'baseline', nrmse, rmse FROM r WHERE k % 2 <> 0 AND k % 3 <> 0 AND k % 5 <> 0) SELECT channel, {s6('avg(nrmse)')} AS nrmse, {s6('avg(rmse)')} AS rmse, count(*) AS n_runs FROM u GROUP BY channel")
def _(t: Tables):
    return rounded(A.ablation(_runs(t), _FLAGS, ["nrmse", "rmse"], "nrmse"), "nrmse", "rmse")


@query("a15_active_window", "SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM frame WHERE ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-20' AND value > 150")
def _(t: Tables):
    span = (F.col("ts") >= "2024-01-07") & (F.col("ts") < "2024-01-20")
    return A.active_window(t.frame.withColumn("value", F.col("value") - 150), span, required=False)


@query("a16_provider_counts", "SELECT provider, count(*) AS n_rows FROM stations GROUP BY provider")
def _(t: Tables):
    return A.rows_per(t.stations, "provider")


@query("a17_merge_counts", "SELECT count(*) AS n_sensors, count(DISTINCT (x, y)) AS n_pixels FROM stations")
def _(t: Tables):
    return A.merge_counts(t.stations)


@query("a18_layer_statistics", f"+ {LAYER} SELECT count(value) AS n, {s6('avg(value)')} AS mean, {s6('stddev_samp(value)')} AS std, {s6('min(value)')} AS min, {s6('max(value)')} AS max, " + ", ".join(f"{s6(f'quantile_cont(value, {p})')} AS p{n}" for p, n in ((0.25, 25), (0.5, 50), (0.75, 75))) + " FROM layer")
def _(t: Tables):
    return rounded(A.describe(layer(t), []), "min", "max", *_MOMENTS)


@query("a19_random_frames", f"+ p AS (SELECT ts FROM (SELECT DISTINCT ts FROM frame) ORDER BY md5('7:' || CAST(ts AS VARCHAR)), ts LIMIT 20) SELECT ts, x, y, {s6('value')} AS value FROM frame WHERE ts IN (SELECT ts FROM p)")
def _(t: Tables):
    return rounded(A.sample_frames(t.frame, 20, 7), "value")
