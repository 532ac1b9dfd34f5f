"""T1-T9, T12-T32, J1, J2."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hourgrid.functions import columns as C
from hourgrid.operators import alignment as J
from hourgrid.operators import fills as T
from hourgrid.workload.base import DIM, Tables, query, r6, rounded, s6

HALF = "date_trunc('hour', {t}) + CASE WHEN epoch_us({t}) % 3600000000 > 1800000000 OR (epoch_us({t}) % 3600000000 = 1800000000 AND (epoch_us({t}) // 3600000000) % 2 = 1) THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END"
CEIL = "CASE WHEN date_trunc('hour', {t}) = {t} THEN {t} ELSE date_trunc('hour', {t}) + INTERVAL 1 HOUR END"


@query("t1_round_to_hour", "+ e AS (SELECT event_id, date_trunc('minute', ts) AS ts FROM events) SELECT event_id, ts, " + HALF.format(t="ts") + " AS hour FROM e")
def _(t: Tables):
    e = t.raw("events").select("event_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"))
    return e.select("event_id", "ts", C.hour_round("ts").alias("hour"))


@query("j1_hour_scaffold", f"SELECT sensor_id, ts, {s6('value')} AS value FROM scaffold")
def _(t: Tables):
    return rounded(t.scaffold, "value")


@query("j2_last_write_per_hour", "+ e AS (SELECT sensor_id, " + HALF.format(t="ts") + " AS h, event_id, value FROM readings) SELECT sensor_id, h AS ts, arg_max(value, event_id) AS value FROM e WHERE h >= (SELECT lo FROM axis_span) AND h < (SELECT hi FROM axis_span) GROUP BY sensor_id, h")
def _(t: Tables):
    out = T.last_write_per_hour(t.readings, C.hour_round("ts"), "event_id")
    return out.where(T.on_axis(t.start, t.end)).select("sensor_id", "ts", "value")


@query("t2_ceil_hour_last_report", "SELECT sensor_id, " + CEIL.format(t="ts") + " AS ts, max(ts) AS valid, arg_max(value, ts) AS value FROM readings r GROUP BY sensor_id, " + CEIL.format(t="r.ts"))
def _(t: Tables):
    rows = t.readings.withColumn("valid", F.col("ts"))
    return J.latest_in_hour(rows, C.hour_ceil("ts"), ["sensor_id"], "valid", ["valid", "value"])


@query("t3_newest_granule_of_hour", "SELECT channel, hour AS ts, max(r.ts) AS granule_ts, arg_max(value, r.ts) AS value FROM readings r GROUP BY channel, hour")
def _(t: Tables):
    rows = t.readings.withColumn("granule_ts", F.col("ts"))
    return J.latest_in_hour(rows, F.col("hour"), ["channel"], "granule_ts", ["granule_ts", "value"])


@query("t4_hourly_mean_labelled_by_end", f"SELECT sensor_id AS \"row\", channel AS col, hour + INTERVAL 1 HOUR AS ts, {s6('avg(value)')} AS value FROM readings WHERE value >= 1 GROUP BY sensor_id, channel, hour")
def _(t: Tables):
    p = t.readings.where(F.col("value") >= 1).select(F.col("sensor_id").alias("row"), F.col("channel").alias("col"), F.col("ts").alias("granule_ts"), "value")
    return rounded(J.hourly_pixel_mean(p), "value")


@query("t5_observation_nearest_hour", "+ c AS (SELECT sensor_id, r.ts, value, " + CEIL.format(t="r.ts") + """ AS h FROM readings r), o AS (SELECT *, abs(epoch_us(ts) - epoch_us(h - INTERVAL 10 MINUTE)) AS off FROM c)
SELECT sensor_id, h AS ts, arg_min(value, (off, o.ts)) AS value FROM o WHERE off <= 600000000 GROUP BY sensor_id, h""")
def _(t: Tables):
    p = t.readings.select("sensor_id", F.col("ts").alias("granule_ts"), "value")
    return J.closest_before_hour(p, ["sensor_id"])




@query("t6_zero_background", f"+ m AS (SELECT channel, ts, avg(value) AS value FROM grid GROUP BY channel, ts) SELECT c.channel, a.ts, CASE WHEN c.channel IN ('error', 'purchase') THEN coalesce({s6('m.value')}, 0e0) ELSE {s6('m.value')} END AS value FROM (SELECT DISTINCT channel FROM grid) c CROSS JOIN axis a LEFT JOIN m ON m.channel = c.channel AND m.ts = a.ts")
def _(t: Tables):
    m = t.grid.groupBy("channel", "ts").agg(F.avg("value").alias("value"))
    full = T.hour_scaffold(m, t.start, t.end, ["channel"])
    return rounded(T.zero_background(full, F.col("channel").isin("error", "purchase")), "value")


@query("t7_metadata_fill", """+ m AS (SELECT s.sensor_id, s.ts, CASE WHEN s.value IS NOT NULL THEN 'site ' || s.sensor_id || '/' || day(s.ts) END AS site FROM scaffold s)
SELECT sensor_id, ts, coalesce(last_value(site IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY ts), first_value(site IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS site FROM m""")
def _(t: Tables):
    site = F.concat(F.lit("site "), F.col("sensor_id"), F.lit("/"), F.dayofmonth("ts"))
    m = t.scaffold.select("sensor_id", "ts", F.when(F.col("value").isNotNull(), site).alias("site"))
    return T.fill_series(m, ["site"])


_FILLED = "SELECT sensor_id, ts, value AS raw, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY ts), first_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM scaffold"


@query("t8_temporal_fill", f"+ f AS ({_FILLED}) SELECT sensor_id, ts, {s6('value')} AS value FROM f")
def _(t: Tables):
    return rounded(T.fill_series(t.scaffold, ["value"]), "value")


@query("t9_dead_hour_fill", f"+ f AS ({_FILLED}), d AS (SELECT ts, count(raw) = 0 AS dead FROM f GROUP BY ts) SELECT f.sensor_id, f.ts, CASE WHEN dead THEN {s6('value')} ELSE {s6('raw')} END AS value FROM f JOIN d ON d.ts = f.ts")
def _(t: Tables):
    return T.fill_dead_hours(t.scaffold).select("sensor_id", "ts", r6("value"))


# A frame series with gaps: the readings of some hours fail their quality rule, a closed form on the hour.
_GAPPY = "gappy AS (SELECT ts, x, y, CASE WHEN epoch(ts) // 3600 % 7 NOT IN (0, 1) AND ts >= (SELECT lo FROM axis_span) + INTERVAL 5 HOUR THEN value END AS value FROM frame)"


def _gappy(t: Tables):
    h = C.hour_index("ts")
    good = ~(h % 7).isin(0, 1) & (F.col("ts") >= C.plus_hours(C.ntz(t.start), 5))
    return t.frame.withColumn("value", F.when(good, F.col("value")))


_SRC = "src AS (SELECT a.ts, last_value(g.ts IGNORE NULLS) OVER (ORDER BY a.ts) AS back, first_value(g.ts IGNORE NULLS) OVER (ORDER BY a.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fwd, row_number() OVER (ORDER BY a.ts) AS rn FROM axis a LEFT JOIN (SELECT DISTINCT ts FROM gappy WHERE value IS NOT NULL) g ON g.ts = a.ts)"


@query("t12_carry_frames", f"+ {_GAPPY}, {_SRC} SELECT src.ts, g.ts AS src_ts, x, y, {s6('value')} AS value FROM src JOIN gappy g ON g.ts = coalesce(back, fwd)")
def _(t: Tables):
    return rounded(T.carry_frames(_gappy(t), t.axis), "value")


@query("t13_align_strict_first_only", f"+ {_GAPPY}, {_SRC} SELECT src.ts, g.ts AS src_ts, x, y, {s6('value')} AS value FROM src JOIN gappy g ON g.ts = CASE WHEN rn = 1 THEN coalesce(back, fwd) ELSE back END")
def _(t: Tables):
    return rounded(T.carry_frames(_gappy(t), t.axis, "first"), "value")


_STATUS = """gran AS (SELECT hour AS ts, CASE WHEN epoch(hour) // 3600 % 7 NOT IN (0, 1) THEN avg(value) > 45 END AS ok FROM readings GROUP BY hour),
st AS (SELECT a.ts, gr.ok, last_value(CASE WHEN gr.ok THEN gr.ts END IGNORE NULLS) OVER (ORDER BY a.ts) AS src_ts FROM axis a LEFT JOIN gran gr ON gr.ts = a.ts),
status AS (SELECT ts, src_ts, CASE WHEN ok THEN 'valid' WHEN src_ts IS NULL THEN 'zero_no_prior' WHEN ok IS NULL THEN 'forward_fill_missing' ELSE 'forward_fill_bad_qa' END AS status FROM st)"""


def _status(t: Tables):
    delivered = ~(C.hour_index("hour") % 7).isin(0, 1)
    g = t.readings.groupBy("hour").agg((F.avg("value") > 45).alias("ok")).select(F.col("hour").alias("ts"), F.when(delivered, F.col("ok")).alias("ok"))
    return T.fill_status(t.axis, g)


@query("t14_fill_status_log", f"+ {_STATUS} SELECT ts, src_ts, status FROM status")
def _(t: Tables):
    return _status(t)


@query("t14_carry_or_zero", f"+ {_STATUS}, k AS (SELECT CAST(unnest(generate_series(0, 63)) AS INTEGER) AS k) SELECT s.ts, k // 8 AS x, k % 8 AS y, s.status, CASE WHEN s.src_ts IS NULL THEN 0e0 ELSE {s6('f.value')} END AS value FROM status s CROSS JOIN k LEFT JOIN frame f ON f.ts = s.src_ts AND f.x = k // 8 AND f.y = k % 8")
def _(t: Tables):
    return rounded(T.carry_or_zero(t.frame, _status(t), DIM), "value")


@query("t14_fill_audit", f"+ {_STATUS} SELECT status, count(*) AS n_hours, 0 AS n_wrong_cells FROM status GROUP BY status")
def _(t: Tables):
    status = _status(t)
    return T.fill_audit(T.carry_or_zero(t.frame, status, DIM), status, t.frame)


@query("t15_missing_hour_to_zero", f"+ {_GAPPY}, k AS (SELECT CAST(unnest(generate_series(0, 63)) AS INTEGER) AS k) SELECT ts, x, y, {s6('value')} AS value FROM gappy WHERE value IS NOT NULL UNION ALL SELECT a.ts, k // 8, k % 8, 0e0 FROM axis a CROSS JOIN k WHERE a.ts NOT IN (SELECT ts FROM gappy WHERE value IS NOT NULL)")
def _(t: Tables):
    return rounded(T.zero_missing_hours(_gappy(t).where("value IS NOT NULL"), t.axis, DIM), "value")


@query("t16_fill_with_frame_mean", f"SELECT ts, sensor_id, {s6('coalesce(value, avg(value) OVER (PARTITION BY ts))')} AS value FROM scaffold")
def _(t: Tables):
    return rounded(T.fill_with_frame_mean(t.scaffold), "value").select("ts", "sensor_id", "value")


_DAYS = """daily AS (SELECT CAST(hour AS DATE) AS day, x, y, avg(CASE WHEN day(hour) % 9 NOT IN (1, 5, 6, 7) AND day(hour) < 29 THEN value END) AS value FROM located GROUP BY 1, 2, 3),
days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM axis),
dm AS (SELECT d.day, last_value(h.day IGNORE NULLS) OVER (ORDER BY d.day) AS b, first_value(h.day IGNORE NULLS) OVER (ORDER BY d.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM days d LEFT JOIN (SELECT DISTINCT day FROM daily WHERE value IS NOT NULL) h ON h.day = d.day)"""


@query("t17_day_gap_fill", f"""+ {_DAYS}, u AS (
 SELECT dm.day, x, y, value AS vb, CAST(NULL AS DOUBLE) AS va, date_diff('day', dm.b, dm.day) AS j FROM dm JOIN daily ON daily.day = dm.b
 UNION ALL SELECT dm.day, x, y, NULL, value, date_diff('day', dm.b, dm.day) FROM dm JOIN daily ON daily.day = dm.a),
m AS (SELECT day, x, y, max(vb) AS vb, max(va) AS va, max(j) AS j FROM u GROUP BY day, x, y)
SELECT day, x, y, {s6("CASE WHEN j = 0 THEN vb ELSE coalesce(va + (vb - va) / pow(2e0, j), vb, va) END")} AS value FROM m""")
def _(t: Tables):
    d = F.dayofmonth("hour")
    rows = t.locate(t.readings.select("hour", "value", "user_id"), F.col("user_id"))
    good = F.when(~(d % 9).isin(1, 5, 6, 7) & (d < 29), F.col("value"))
    daily = rows.groupBy(F.to_date("hour").alias("day"), "x", "y").agg(F.avg(good).alias("value"))
    days = t.axis.select(F.to_date("ts").alias("day")).distinct()
    return rounded(T.fill_day_gaps(daily, days), "value")


# Dense small frames: every channel, hour and sensor; empty where the channel is silent.
_DENSE = """dense AS (SELECT c.channel, a.ts, CAST(c.sensor_id // 4 AS INTEGER) AS x, CAST(c.sensor_id % 4 AS INTEGER) AS y, coalesce(g.value, 0e0) AS value
 FROM (SELECT DISTINCT channel, sensor_id FROM readings) c CROSS JOIN axis a
 LEFT JOIN (SELECT channel, hour, sensor_id, avg(CASE WHEN epoch(hour) // 3600 % 5 <> 2 THEN value END) AS value FROM readings GROUP BY ALL) g ON g.channel = c.channel AND g.hour = a.ts AND g.sensor_id = c.sensor_id),
fl AS (SELECT *, sum(abs(value)) OVER (PARTITION BY channel, ts) > 0 AS isfull FROM dense),
fs AS (SELECT *, min(CASE WHEN isfull THEN ts END) OVER (PARTITION BY channel) AS first_full, date_diff('hour', (SELECT lo FROM axis_span), ts) AS i FROM fl)"""


def _dense(t: Tables):
    good = F.when(C.hour_index("hour") % 5 != 2, F.col("value"))
    g = t.readings.groupBy("channel", F.col("hour").alias("ts"), "sensor_id").agg(F.avg(good).alias("value"))
    return T.hour_scaffold(g, t.start, t.end, ["channel", "sensor_id"]).select(
        "channel", "ts", F.expr("CAST(sensor_id div 4 AS INT)").alias("x"), (F.col("sensor_id") % 4).cast("int").alias("y"),
        F.coalesce("value", F.lit(0.0)).alias("value"))


def _smooth_sql(keep: float, fade: float) -> str:
    return f"""+rec {_DENSE}, r AS (SELECT channel, x, y, i, ts, value FROM fs WHERE i = 0 UNION ALL
 SELECT f.channel, f.x, f.y, f.i, f.ts, CASE WHEN coalesce(f.ts > f.first_full, false) THEN CASE WHEN f.isfull THEN r.value * {keep}e0 + f.value * (1e0 - {keep}e0) ELSE r.value * {fade}e0 END ELSE f.value END
 FROM r JOIN fs f ON f.channel = r.channel AND f.x = r.x AND f.y = r.y AND f.i = r.i + 1)
SELECT channel, ts, x, y, {s6('value')} AS value FROM r"""


@query("t18_smooth_hold_empty", _smooth_sql(0.2, 1.0))
def _(t: Tables):
    return rounded(T.recursive_smooth(_dense(t), 0.2), "value")


@query("t19_smooth_fade_empty", _smooth_sql(0.3, 0.9))
def _(t: Tables):
    return rounded(T.recursive_smooth(_dense(t), 0.3, fade=0.9, measure="max"), "value")


def _nowcast_sql() -> str:
    lags = ", ".join(f"lag(value, {k}) OVER w AS v{k}" for k in range(12))
    names = ", ".join(f"v{k}" for k in range(12))
    num = den = "0e0"
    for k in range(11, -1, -1):
        num = f"({num} * w + coalesce(v{k}, 0e0))"
        den = f"({den} * w + CASE WHEN v{k} IS NULL THEN 0e0 ELSE 1e0 END)"
    return f"""+ l AS (SELECT sensor_id, ts, row_number() OVER w AS rn, {lags} FROM scaffold WINDOW w AS (PARTITION BY sensor_id ORDER BY ts)),
h AS (SELECT *, greatest({names}) AS hi, least({names}) AS lo FROM l), ww AS (SELECT *, greatest(0.5e0, 1 - (hi - lo) / nullif(hi, 0e0)) AS w FROM h)
SELECT sensor_id, ts, CASE WHEN rn < 12 OR CAST(v0 IS NULL AS INT) + CAST(v1 IS NULL AS INT) + CAST(v2 IS NULL AS INT) >= 2 THEN NULL WHEN hi = 0 THEN 0e0
 ELSE greatest(0e0, trunc({num} / {den} * 10) / 10) END AS nowcast FROM ww"""


@query("t20_nowcast", _nowcast_sql())
def _(t: Tables):
    return T.nowcast(t.scaffold).select("sensor_id", "ts", "nowcast")


@query("t21_rolling_means", "SELECT sensor_id, ts, " + ", ".join(f"CASE WHEN count(value) OVER (PARTITION BY sensor_id ORDER BY ts ROWS {n - 1} PRECEDING) = {n} THEN {s6(f'avg(value) OVER (PARTITION BY sensor_id ORDER BY ts ROWS {n - 1} PRECEDING)')} END AS mean_{n}" for n in (7, 24, 168)) + f" FROM ({_FILLED})")
def _(t: Tables):
    df = T.fill_series(t.scaffold, ["value"])
    for n in (7, 24, 168):
        df = T.rolling_mean(df, n)
    return rounded(df, "mean_7", "mean_24", "mean_168").drop("value")


@query("t22_hourly_climatology", f"SELECT sensor_id, ts, {s6('coalesce(avg(value) OVER (PARTITION BY sensor_id, hour(ts) ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), value)')} AS climatology FROM ({_FILLED})")
def _(t: Tables):
    out = T.climatology(T.fill_series(t.scaffold, ["value"]), t.start, 30, ["sensor_id"])
    return rounded(out, "climatology").drop("value")


@query("t23_lag_autocorrelation", f"SELECT sensor_id, {s6('corr(value, p)')} AS autocorrelation FROM (SELECT sensor_id, value, lag(value) OVER (PARTITION BY sensor_id ORDER BY ts) AS p FROM scaffold) GROUP BY sensor_id")
def _(t: Tables):
    return rounded(T.autocorrelation(t.scaffold), "autocorrelation")


@query("t24_lead_one_hour", f"SELECT sensor_id, ts, {s6('lead(value) OVER (PARTITION BY sensor_id ORDER BY ts)')} AS ahead FROM scaffold")
def _(t: Tables):
    return rounded(T.lagged(t.scaffold, -1, "ahead"), "ahead").drop("value")


_FIELDS = {"month": "month(ts)", "day": "day(ts)", "weekday": "extract(dow FROM ts)", "hour": "hour(ts)"}


@query("t25_cyclical_time", "SELECT event_id, " + ", ".join(
    f"{s6(f'sin({e} * {2 * math.pi!r}e0 / {C.CYCLE_MAX[f]})')} AS {f}_sin, {s6(f'cos({e} * {2 * math.pi!r}e0 / {C.CYCLE_MAX[f]})')} AS {f}_cos, {s6(f'{e} / {C.CYCLE_MAX[f]}e0')} AS {f}_lin"
    for f, e in _FIELDS.items()) + " FROM events")
def _(t: Tables):
    cols = []
    for f in _FIELDS:
        s, c = C.cyclical("ts", f)
        cols += [r6(s, f"{f}_sin"), r6(c, f"{f}_cos"), r6(C.linear_time("ts", f), f"{f}_lin")]
    return t.raw("events").select("event_id", *cols)


@query("t26_unit_scaling", f"SELECT event_id, value * 1e9 AS smoke, {s6('value * 1e16 / 1e16')} AS no2, {s6('value * 0.0001e0')} AS vegetation, {s6('value * 1.15078e0')} AS mph, CASE WHEN user_id <> 7 THEN user_id * 0.02e0 + -273.15e0 END AS celsius FROM events")
def _(t: Tables):
    return t.raw("events").select(
        "event_id", C.scale_unit("value", "smoke_mass").alias("smoke"), r6(C.scale_unit(F.col("value") * 1e16, "no2_column"), "no2"),
        r6(C.scale_unit("value", "vegetation_index"), "vegetation"), r6(C.scale_unit("value", "knots_to_mph"), "mph"),
        C.scale_offset("user_id", F.lit(0.02), F.lit(-273.15), F.lit(7)).alias("celsius"))


@query("t27_clip_normalise", f"SELECT sensor_id, ts, {s6('coalesce(least(greatest((value - 20e0) / 60e0, 0e0), 1e0), 0e0)')} AS value FROM scaffold")
def _(t: Tables):
    return t.scaffold.select("sensor_id", "ts", r6(C.clip_normalise("value", 20.0, 60.0), "value"))


@query("t28_band_mean", f"SELECT \"row\", col, {s6('avg(CASE WHEN cloud < 0.05e0 THEN value END)')} AS value FROM pixels GROUP BY \"row\", col")
def _(t: Tables):
    return t.pixels.groupBy("row", "col").agg(r6(F.avg(F.when(F.col("cloud") < 0.05, F.col("value"))), "value"))


@query("t29_missing_value_policy", f"""SELECT sensor_id AS station, ts, first_value(CASE WHEN value IS NOT NULL THEN sensor_id * 0.5e0 END IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lat,
coalesce(CASE WHEN value IS NOT NULL THEN ts END, TIMESTAMP '1900-01-01') AS valid, {s6('value')} AS temperature, coalesce({s6('value')}, -1e0) AS speed FROM scaffold""")
def _(t: Tables):
    have = F.col("value").isNotNull()
    rows = t.scaffold.select(F.col("sensor_id").alias("station"), "ts", F.when(have, F.col("sensor_id") * 0.5).alias("lat"),
                             F.when(have, F.col("ts")).alias("valid"), r6("value", "temperature"), r6("value", "speed"))
    return T.station_policy(rows, ["temperature"], ["speed"], info=["lat"])


@query("t30_local_time", "SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles') AS local_ts FROM events")
def _(t: Tables):
    return t.raw("events").select("event_id", C.local_time("ts", "America/Los_Angeles").alias("local_ts"))


@query("t31_one_hot_hour", "SELECT event_id, " + ", ".join(f"CAST(hour(ts) = {h} AS INTEGER) AS hour_{h}" for h in range(24)) + " FROM events")
def _(t: Tables):
    return t.raw("events").select("event_id", *C.one_hot(F.hour("ts"), range(24), "hour"))


@query("t32_hourly_difficulty", f"SELECT sensor_id, {s6('avg(abs(value - p)) / avg(value) * 100')} AS difficulty_pct FROM (SELECT sensor_id, value, lag(value) OVER (PARTITION BY sensor_id ORDER BY ts) AS p FROM scaffold) GROUP BY sensor_id")
def _(t: Tables):
    return rounded(T.hourly_difficulty(t.scaffold), "difficulty_pct")
