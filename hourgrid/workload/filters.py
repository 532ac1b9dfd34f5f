"""F1-F27, T10, T11."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.functions import columns as C
from hourgrid.operators import cleaning as K
from hourgrid.workload.base import Tables, query, r6, s6

INNER = (-118.5, -117.3, 33.7, 34.3)


@query("f1_extent_inclusive", "SELECT sensor_id, lat, lon FROM stations WHERE lat BETWEEN 33.7e0 AND 34.3e0 AND lon BETWEEN -118.5e0 AND -117.3e0")
def _(t: Tables):
    return t.stations.where(C.in_extent(INNER)).select("sensor_id", "lat", "lon")


@query("f1_extent_exclusive", "SELECT sensor_id, lat, lon + 360 AS lon360 FROM stations WHERE lat > 33.7e0 AND lat < 34.3e0 AND lon + 360 > 241.5e0 AND lon + 360 < 242.7e0")
def _(t: Tables):
    rows = t.stations.withColumn("lon360", F.col("lon") + 360)
    return rows.where(C.in_extent((241.5, 242.7, 33.7, 34.3), lon="lon360", inclusive=False)).select("sensor_id", "lat", "lon360")


@query("f2_extent_validation", """+ e AS (SELECT c_nationkey, min(c_acctbal) / 50 AS lon_min, max(c_acctbal) / 50 AS lon_max, min(c_acctbal) / 100 AS lat_min, avg(c_acctbal) / 100 AS lat_max FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, (lon_min < lon_max AND lat_min < lat_max AND lon_min >= -180 AND lon_max <= 180 AND lat_min >= -90 AND lat_max <= 90) AS ok FROM e""")
def _(t: Tables):
    bal = F.col("c_acctbal")
    e = t.raw("customer").groupBy("c_nationkey").agg(
        (F.min(bal) / 50).alias("lon_min"), (F.max(bal) / 50).alias("lon_max"),
        (F.min(bal) / 100).alias("lat_min"), (F.avg(bal) / 100).alias("lat_max"))
    return e.select("c_nationkey", C.extent_ok("lon_min", "lon_max", "lat_min", "lat_max").alias("ok"))


@query("f3_site_whitelist", "SELECT channel, count(*) AS n FROM readings WHERE channel IN ('click', 'view') GROUP BY channel")
def _(t: Tables):
    return K.keep_names(t.readings, ["click", "view"], "channel").groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("f4_provider_whitelist", "SELECT user_id, count(*) AS n FROM readings WHERE user_id IN (SELECT sensor_id FROM stations WHERE provider IN ('reference', 'community')) GROUP BY user_id")
def _(t: Tables):
    _, obs = K.keep_providers(t.stations, t.readings.drop("sensor_id").withColumnRenamed("user_id", "sensor_id"), ["reference", "community"])
    return obs.groupBy(F.col("sensor_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))


@query("f5_operating_interval", """+ life AS (SELECT sensor_id, CASE WHEN sensor_id % 7 <> 0 THEN first_ts + (sensor_id % 20) * INTERVAL 1 DAY END AS first_ts, CASE WHEN sensor_id % 11 <> 0 THEN last_ts - (sensor_id % 25) * INTERVAL 1 DAY END AS last_ts FROM stations)
SELECT sensor_id FROM life WHERE coalesce(last_ts, TIMESTAMP '2024-01-10') > TIMESTAMP '2024-01-10' AND coalesce(first_ts, TIMESTAMP '2024-01-15') < TIMESTAMP '2024-01-15'""")
def _(t: Tables):
    s = F.col("sensor_id")
    life = t.stations.select(
        "sensor_id",
        F.when(s % 7 != 0, F.timestamp_add("DAY", (s % 20).cast("int"), F.col("first_ts"))).alias("first_ts"),
        F.when(s % 11 != 0, F.timestamp_add("DAY", -(s % 25).cast("int"), F.col("last_ts"))).alias("last_ts"))
    return K.operating_between(life, "2024-01-10", "2024-01-15").select("sensor_id")


_CHAN_USERS = "(SELECT user_id AS sensor_id, hour AS ts, avg(value) AS value FROM readings GROUP BY user_id, hour)"


@query("f6_min_uptime_rows", f"""+ o AS {_CHAN_USERS} SELECT sensor_id, count(*) AS n FROM o GROUP BY sensor_id
HAVING count(*) / CAST((SELECT count(DISTINCT ts) FROM o) AS DOUBLE) > 0.085e0""")
def _(t: Tables):
    o = t.readings.groupBy(F.col("user_id").alias("sensor_id"), F.col("hour").alias("ts")).agg(F.avg("value").alias("value"))
    return K.min_uptime_rows(o, 0.085).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"))


@query("f7_min_uptime_share", "SELECT sensor_id, count(value) AS n FROM scaffold GROUP BY sensor_id HAVING count(value) / CAST(count(*) AS DOUBLE) >= 0.12e0")
def _(t: Tables):
    return K.min_uptime_share(t.scaffold, 0.12).groupBy("sensor_id").agg(F.count("value").alias("n"))


_BAL = "SELECT c_custkey, c_acctbal AS raw, {e} AS value FROM customer"


@query("f8_invalid_to_null", _BAL.format(e="CASE WHEN c_acctbal >= 0 THEN c_acctbal END"))
def _(t: Tables):
    return t.raw("customer").select("c_custkey", F.col("c_acctbal").alias("raw"), C.negative_to_null("c_acctbal").alias("value"))


@query("f9_floor_low_values", "SELECT event_id, CASE WHEN value > 0 AND value < 1 THEN 1e0 ELSE value END AS value FROM events")
def _(t: Tables):
    return t.raw("events").select("event_id", C.floor_low("value").alias("value"))


@query("f10_negative_to_zero", _BAL.format(e="greatest(c_acctbal, 0e0)"))
def _(t: Tables):
    return t.raw("customer").select("c_custkey", F.col("c_acctbal").alias("raw"), C.negative_to_zero("c_acctbal").alias("value"))


@query("f11_hard_cap", "SELECT event_id, CASE WHEN value <= 100.5e0 THEN value END AS above_cap, CASE WHEN value < 100.5e0 THEN value END AS at_cap FROM events")
def _(t: Tables):
    return t.raw("events").select("event_id", C.cap_to_null("value", 100.5).alias("above_cap"),
                                  C.cap_to_null("value", 100.5, inclusive=True).alias("at_cap"))


_MASK = "SELECT DISTINCT x, y, CASE WHEN (x + y) % 3 = 0 THEN 0 ELSE 1 END AS value FROM stations"


def _mask(t: Tables):
    return t.stations.select("x", "y").distinct().withColumn("value", F.when((F.col("x") + F.col("y")) % 3 == 0, 0).otherwise(1))


@query("f12_mask_cells", f"+ m AS ({_MASK}) SELECT f.ts, f.x, f.y, {s6('f.value')} AS value FROM frame f JOIN m ON m.x = f.x AND m.y = f.y WHERE m.value <> 0")
def _(t: Tables):
    return K.mask_cells(t.frame.withColumnRenamed("value", "v"), _mask(t)).select("ts", "x", "y", r6("v", "value"))


@query("f12_mask_report", f"+ m AS ({_MASK}) SELECT count(*) AS n_sensors, count(*) FILTER (WHERE m.value <> 0) AS n_kept, count(*) FILTER (WHERE m.value = 0) AS n_masked FROM stations s JOIN m ON m.x = s.x AND m.y = s.y")
def _(t: Tables):
    return K.mask_report(t.stations, _mask(t))


@query("f13_quality_categorical", "SELECT order_key, \"row\", col, granule_ts, value FROM pixels WHERE flag % 4 IN (0, 1)")
def _(t: Tables):
    p = t.pixels.withColumn("dqf", F.col("flag") % 4)
    return p.where(C.quality_categorical("dqf", "aerosol_depth")).select("order_key", "row", "col", "granule_ts", "value")


@query("f14_quality_bit_field", "SELECT flag, l_linestatus, count(*) AS n FROM pixels WHERE CASE WHEN l_linestatus = 'O' THEN (flag & 12) IN (0, 4) ELSE (flag & 12) IN (12, 4) END GROUP BY flag, l_linestatus")
def _(t: Tables):
    p = t.pixels.withColumn("has_index", F.col("l_linestatus") == "O")
    return p.where(C.quality_bits("flag", "has_index")).groupBy("flag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("f15_quality_cloud", f"SELECT \"row\", col, count(*) AS n, count(v) AS n_passed, {s6('avg(v)')} AS mean FROM (SELECT \"row\", col, CASE WHEN qa - 0.02e0 <= 0 AND cloud * 10 < 0.5e0 THEN value END AS v FROM pixels) GROUP BY \"row\", col")
def _(t: Tables):
    p = t.pixels.select("row", "col", C.quality_cloud("value", F.col("qa") - 0.02, F.col("cloud") * 10).alias("v"))
    return p.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_passed"), r6(F.avg("v"), "mean"))


@query("f16_quality_score", f"SELECT \"row\", col, count(v) AS n_passed, {s6('avg(v)')} AS mean FROM (SELECT \"row\", col, CASE WHEN quantity / 50 > 0.75e0 THEN value END AS v FROM pixels) GROUP BY \"row\", col")
def _(t: Tables):
    p = t.pixels.select("row", "col", C.quality_score("value", F.col("quantity") / 50).alias("v"))
    return p.groupBy("row", "col").agg(F.count("v").alias("n_passed"), r6(F.avg("v"), "mean"))


_COVER = "(SELECT granule_ts AS ts, \"row\", col, CASE WHEN flag % 4 IN (0, 1) THEN value END AS value FROM pixels)"


@query("f17_coverage_gate", f"""+ p AS {_COVER}, g AS (SELECT *, count(value) OVER (PARTITION BY ts) / CAST(count(*) OVER (PARTITION BY ts) AS DOUBLE) AS share FROM p)
SELECT ts, count(*) AS n, count(CASE WHEN share >= 0.6e0 THEN value END) AS n_kept FROM g GROUP BY ts""")
def _(t: Tables):
    p = t.pixels.select(F.col("granule_ts").alias("ts"), "row", "col",
                        F.when(C.quality_categorical(F.col("flag") % 4, "aerosol_depth"), F.col("value")).alias("value"))
    return K.coverage_gate(p, 0.6).groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_kept"))


@query("f18_temperature_floor", "SELECT event_id, CASE WHEN value > 100 THEN value END AS value FROM events")
def _(t: Tables):
    return t.raw("events").select("event_id", C.kelvin_floor("value").alias("value"))


@query("f19_optical_depth_range", "SELECT event_id, CASE WHEN v < -0.1e0 OR v > 5 THEN NULL WHEN v < 0 THEN 0e0 ELSE v END AS value FROM (SELECT event_id, (value - 5) / 20 AS v FROM events)")
def _(t: Tables):
    return t.raw("events").select("event_id", C.optical_depth_range((F.col("value") - 5) / 20).alias("value"))


@query("f20_nodata_to_zero", _BAL.format(e="CASE WHEN c_acctbal = 0 OR c_acctbal < -100 THEN 0e0 ELSE c_acctbal END"))
def _(t: Tables):
    return t.raw("customer").select("c_custkey", F.col("c_acctbal").alias("raw"), C.nodata_to_zero("c_acctbal", 0.0).alias("value"))


@query("f21_event_window", "SELECT event_id, ts FROM events WHERE (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles') > TIMESTAMP '2024-01-08' AND (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles') < TIMESTAMP '2024-01-14'")
def _(t: Tables):
    return K.event_window(t.raw("events").select("event_id", "ts"), "2024-01-11", days=3, zone="America/Los_Angeles")


@query("f21_forward_window", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-10 12:00:00'")
def _(t: Tables):
    return K.event_window(t.raw("events").select("event_id", "ts"), "2024-01-08", until="2024-01-10 12:00:00")


@query("f22_trim_outliers", """+ s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem, s WHERE abs(l_quantity - mq) < 1.5e0 * sq AND abs(l_extendedprice - mp) < 1.5e0 * sp""")
def _(t: Tables):
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return K.trim_outliers(rows, ["l_quantity", "l_extendedprice"], 1.5)


@query("f23_drop_dead_readings", "SELECT sensor_id, horizon, count(*) AS n FROM (SELECT *, CASE WHEN y_true < 20 THEN 0e0 ELSE y_true END AS z FROM forecasts) WHERE z <> 0 GROUP BY sensor_id, horizon")
def _(t: Tables):
    rows = t.forecasts.withColumn("z", F.when(F.col("y_true") < 20, 0.0).otherwise(F.col("y_true")))
    return K.drop_dead_readings(rows, "z").groupBy("sensor_id", "horizon").agg(F.count(F.lit(1)).alias("n"))


@query("f24_bounded_or_all", "SELECT 'inside' AS kind, sensor_id FROM stations WHERE lat > 34 UNION ALL SELECT 'fallback', sensor_id FROM stations")
def _(t: Tables):
    inside = K.bounded_or_all(t.stations, F.col("lat") > 34).select(F.lit("inside").alias("kind"), "sensor_id")
    nowhere = K.bounded_or_all(t.stations, F.col("lat") > 60).select(F.lit("fallback").alias("kind"), "sensor_id")
    return inside.unionByName(nowhere)


@query("f25_channel_selection", "SELECT channel, count(*) AS n FROM grid WHERE channel IN ('click', 'view', 'error') GROUP BY channel")
def _(t: Tables):
    return K.select_channels(t.grid, ["browse", "error"], {"browse": ["click", "view"]}).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("f26_target_subset", "SELECT sample_id, sensor_id, horizon FROM forecasts WHERE horizon <= 2 AND sensor_id IN (1, 4, 7)")
def _(t: Tables):
    return K.subset_targets(t.forecasts, 2, [1, 4, 7]).select("sample_id", "sensor_id", "horizon")


_SYN = [("interest", "impression", 1), ("interest", "view", 2), ("interest", "click", 3), ("sale", "purchase", 1), ("fault", "error", 1), ("fault", "crash", 2)]


@query("f27_variable_synonyms", "+ syn(variable, name, priority) AS (VALUES " + ", ".join(f"('{a}', '{b}', {p})" for a, b, p in _SYN) + """),
chosen AS (SELECT variable, arg_min(name, priority) AS name FROM syn WHERE name IN (SELECT DISTINCT channel FROM readings) GROUP BY variable)
SELECT variable, name, count(*) AS n FROM readings JOIN chosen ON name = channel GROUP BY variable, name""")
def _(t: Tables):
    syn = t.spark.createDataFrame(_SYN, "variable string, name string, priority int")
    rows = K.resolve_variables(t.readings.withColumnRenamed("channel", "name"), syn)
    return rows.groupBy("variable", "name").agg(F.count(F.lit(1)).alias("n"))


_Z = """z AS (SELECT s.*, avg(value) OVER (PARTITION BY sensor_id) AS m, stddev_samp(value) OVER (PARTITION BY sensor_id) AS sd FROM {t} s),
c AS (SELECT sensor_id, ts, value AS raw, CASE WHEN abs((value - m) / sd) > {k} THEN NULL ELSE value END AS value FROM z)"""


@query("t11_zscore_outliers", "+ " + _Z.format(t="readings", k=2) + " SELECT sensor_id, count(raw) AS n, count(value) AS n_kept, " + s6("max(value)") + " AS max_kept FROM c GROUP BY sensor_id")
def _(t: Tables):
    out = K.zscore_to_null(t.readings.withColumn("raw", F.col("value")), 2.0)
    return out.groupBy("sensor_id").agg(F.count("raw").alias("n"), F.count("value").alias("n_kept"), r6(F.max("value"), "max_kept"))


@query("t11_outlier_counts", "+ " + _Z.format(t="readings", k=3) + " SELECT sensor_id, count(raw) - count(value) AS n_outliers FROM c GROUP BY sensor_id")
def _(t: Tables):
    return K.outlier_counts(t.readings, 3.0)


@query("t10_sparse_hours", f"""+ n AS (SELECT ts, count(value) AS n FROM scaffold GROUP BY ts)
SELECT s.sensor_id, s.ts, CASE WHEN n.n > floor(0.7e0 * (SELECT count(DISTINCT sensor_id) FROM scaffold)) THEN {s6('s.value')} END AS value FROM scaffold s JOIN n ON n.ts = s.ts""")
def _(t: Tables):
    return K.sparse_hours_to_null(t.scaffold, 0.7).select("sensor_id", "ts", r6("value"))
