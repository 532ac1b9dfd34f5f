"""J3-J23 (J1, J2 and J6 are with the temporal and gridding queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.functions import columns as C
from hourgrid.operators import alignment as J
from hourgrid.workload.base import CHANNELS, Tables, query, r6, rounded, s6
from hourgrid.workload.gridding import LAYER, layer


@query("j3_locations_with_cells", "SELECT s.sensor_id, s.x, s.y, count(*) AS n FROM stations s JOIN readings r ON r.user_id = s.sensor_id GROUP BY ALL")
def _(t: Tables):
    rows = t.readings.select(F.col("user_id").alias("sensor_id"), "value")
    return J.with_cells(rows.groupBy("sensor_id").agg(F.count("value").alias("n")), t.stations)


_KEPT = "kept AS (SELECT s.* FROM stations s WHERE provider = 'reference' OR NOT EXISTS (SELECT 1 FROM stations r WHERE r.provider = 'reference' AND r.x = s.x AND r.y = s.y))"


@query("j4_drop_colliding_sensors", f"+ {_KEPT} SELECT sensor_id, provider, x, y FROM kept")
def _(t: Tables):
    return J.drop_colliding(t.stations, F.col("provider") == "reference").select("sensor_id", "provider", "x", "y")


@query("j5_drop_their_measurements", f"+ {_KEPT} SELECT user_id AS sensor_id, count(*) AS n FROM readings WHERE user_id IN (SELECT sensor_id FROM kept) GROUP BY user_id")
def _(t: Tables):
    kept = J.drop_colliding(t.stations, F.col("provider") == "reference").select("sensor_id")
    obs = t.readings.select(F.col("user_id").alias("sensor_id"))
    return obs.join(kept, "sensor_id", "left_semi").groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"))


# One report per (sensor, minute): exact ties around the hour do occur.
_REP = "rep AS (SELECT sensor_id, date_trunc('minute', ts) AS valid, avg(value) AS value FROM readings GROUP BY 1, 2), sl AS (SELECT s.sensor_id, a.ts FROM (SELECT DISTINCT sensor_id FROM rep) s CROSS JOIN axis a)"


def _reports(t: Tables):
    return (t.readings.groupBy("sensor_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("valid"))
             .agg(F.avg("value").alias("value")))


def _slots(t: Tables):
    from hourgrid.operators.fills import each_hour
    return t.readings.select("sensor_id").distinct().withColumn("ts", each_hour(t.start, t.end))


def _near_sql(op: str) -> str:
    return f"""+ {_REP}, b AS (SELECT sl.*, r.valid AS bv, r.value AS bx FROM sl ASOF LEFT JOIN rep r ON r.sensor_id = sl.sensor_id AND r.valid <= sl.ts),
f AS (SELECT sl.*, r.valid AS fv, r.value AS fx FROM sl ASOF LEFT JOIN rep r ON r.sensor_id = sl.sensor_id AND r.valid >= sl.ts),
m AS (SELECT b.sensor_id, b.ts, bv, bx, fv, fx, bv IS NULL OR (fv IS NOT NULL AND epoch_us(fv) - epoch_us(b.ts) {op} epoch_us(b.ts) - epoch_us(bv)) AS use_f FROM b JOIN f ON f.sensor_id = b.sensor_id AND f.ts = b.ts)
SELECT sensor_id, ts, CASE WHEN use_f THEN fv ELSE bv END AS valid, {s6('CASE WHEN use_f THEN fx ELSE bx END')} AS value FROM m"""


@query("j7_nearest_time_first_on_tie", _near_sql("<"))
def _(t: Tables):
    return rounded(J.nearest_report(_slots(t), _reports(t), ["sensor_id"], ["value"], later_on_tie=False), "value")


@query("j8_nearest_reindex", _near_sql("<="))
def _(t: Tables):
    return rounded(J.nearest_report(_slots(t), _reports(t), ["sensor_id"], ["value"]), "value")


def acquisition(t: Tables):
    """Every hour belongs to the acquisition of its five days, at seven o'clock of the first."""
    return C.plus_hours(C.ntz(t.start), (F.floor(C.hour_index("hour", t.start) / 120) * 120 + 7).cast("int"))


_ACQ = "acq AS (SELECT (SELECT lo FROM axis_span) + CAST(date_diff('day', (SELECT lo FROM axis_span), hour) // 5 * 5 AS INTEGER) * INTERVAL 1 DAY + INTERVAL 7 HOUR AS acq_ts, x, y, avg(value) AS value FROM located GROUP BY 1, 2, 3)"


@query("j9_step_function", f"""+ {_ACQ}, st AS (SELECT a.ts, coalesce((SELECT max(acq_ts) FROM acq WHERE acq_ts <= a.ts), (SELECT min(acq_ts) FROM acq)) AS acq_ts FROM axis a)
SELECT st.ts, st.acq_ts, x, y, {s6('value')} AS value FROM st JOIN acq ON acq.acq_ts = st.acq_ts""")
def _(t: Tables):
    rows = t.locate(t.readings.select("hour", "value", "user_id"), F.col("user_id"))
    acq = rows.groupBy(acquisition(t).alias("acq_ts"), "x", "y").agg(F.avg("value").alias("value"))
    steps = J.step_function(t.axis, acq.select("acq_ts").distinct())
    return rounded(steps.join(acq, "acq_ts"), "value")


@query("j10_daily_to_hours", f"+ d AS (SELECT CAST(hour AS DATE) AS day, avg(value) AS value FROM readings GROUP BY 1) SELECT ts, day, {s6('value')} AS value FROM axis JOIN d ON d.day = CAST(ts AS DATE)")
def _(t: Tables):
    daily = t.readings.groupBy(F.to_date("hour").alias("day")).agg(F.avg("value").alias("value"))
    return rounded(J.daily_to_hours(t.axis, daily), "value")


_RUN = "date_trunc('day', h.ts - INTERVAL 24 HOUR) + (hour(h.ts - INTERVAL 24 HOUR) // 6 * 6) * INTERVAL 1 HOUR"


@query("j11_model_run_and_lead", f"SELECT h.sensor_id, h.ts, {_RUN} AS run_ts, date_diff('hour', {_RUN}, h.ts) AS lead, {s6('r.value')} AS run_value FROM hourly h JOIN hourly r ON r.sensor_id = h.sensor_id AND r.ts = {_RUN}")
def _(t: Tables):
    wanted = J.with_model_run(t.hourly.select("sensor_id", "ts"))
    runs = t.hourly.select("sensor_id", F.col("ts").alias("run_ts"), F.col("value").alias("run_value"))
    return rounded(wanted.join(runs, ["sensor_id", "run_ts"]), "run_value")


@query("j12_latest_usable_run", """+ runs AS (SELECT hour - (hour(hour) % 6) * INTERVAL 1 HOUR AS run_ts, avg(value) > 40 AS available FROM readings GROUP BY 1),
u AS (SELECT max(run_ts) AS run_ts FROM runs WHERE run_ts < TIMESTAMP '2024-01-20 09:00:00' AND available AND run_ts >= TIMESTAMP '2024-01-19' AND date_diff('hour', run_ts, TIMESTAMP '2024-01-20 09:00:00') + 24 <= 48)
SELECT run_ts, date_diff('hour', run_ts, TIMESTAMP '2024-01-20 09:00:00') AS "offset", unnest(generate_series(date_diff('hour', run_ts, TIMESTAMP '2024-01-20 09:00:00') + 1, date_diff('hour', run_ts, TIMESTAMP '2024-01-20 09:00:00') + 24)) AS lead FROM u WHERE run_ts IS NOT NULL""")
def _(t: Tables):
    runs = t.readings.groupBy(C.plus_hours("hour", -(F.hour("hour") % 6)).alias("run_ts")).agg((F.avg("value") > 40).alias("available"))
    return J.latest_usable_run(runs, "2024-01-20 09:00:00")


def run_of(ts: str):
    """The forecast run of 3, 6 or 12 o'clock that an hour belongs to."""
    base = C.plus_hours(ts, -3)
    h = F.hour(base)
    return C.plus_hours(F.date_trunc("day", base).cast("timestamp_ntz"), F.when(h < 3, 3).when(h < 9, 6).otherwise(12))


def run_of_sql(ts: str) -> str:
    h = f"hour({ts} - INTERVAL 3 HOUR)"
    return f"date_trunc('day', {ts} - INTERVAL 3 HOUR) + CASE WHEN {h} < 3 THEN 3 WHEN {h} < 9 THEN 6 ELSE 12 END * INTERVAL 1 HOUR"


_FC = f"fc AS (SELECT i.init_ts, i.init_ts + k * INTERVAL 1 HOUR AS valid_ts, i.x, i.y, i.value + k AS value FROM (SELECT {run_of_sql('ts')} AS init_ts, x, y, avg(value) AS value FROM frame GROUP BY 1, 2, 3) i CROSS JOIN (SELECT CAST(unnest(generate_series(1, 30)) AS INTEGER) AS k))"
_SEL = """hv AS (SELECT DISTINCT init_ts, valid_ts FROM fc), rk AS (SELECT *, row_number() OVER (PARTITION BY init_ts ORDER BY valid_ts) AS r FROM hv),
sel AS (SELECT init_ts, valid_ts FROM rk WHERE r <= CASE hour(init_ts) WHEN 6 THEN 6 WHEN 12 THEN 18 WHEN 3 THEN 24 END AND valid_ts >= TIMESTAMP '2024-01-10' AND valid_ts < TIMESTAMP '2024-01-25'),
used AS (SELECT fc.* FROM fc JOIN sel ON sel.init_ts = fc.init_ts AND sel.valid_ts = fc.valid_ts)"""


def _forecast_files(t: Tables):
    init = t.frame.groupBy(run_of("ts").alias("init_ts"), "x", "y").agg(F.avg("value").alias("value"))
    k = init.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(30))))
    return k.select("init_ts", C.plus_hours("init_ts", F.col("k")).alias("valid_ts"), "x", "y", (F.col("value") + F.col("k")).alias("value"))


def _selected(t: Tables):
    wanted = t.axis.where((F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-25"))
    return J.select_valid_hours(_forecast_files(t), wanted)


@query("j13_valid_hours_per_file", f"+ {_FC}, {_SEL} SELECT init_ts, valid_ts, x, y, {s6('value')} AS value FROM used")
def _(t: Tables):
    return rounded(_selected(t).select("init_ts", "valid_ts", "x", "y", "value"), "value")


@query("j14_later_run_overrides", f"+ {_FC}, {_SEL} SELECT valid_ts, x, y, {s6('arg_max(value, init_ts)')} AS value, max(init_ts) AS init_ts FROM used GROUP BY valid_ts, x, y")
def _(t: Tables):
    return rounded(J.latest_run_wins(_selected(t), ["valid_ts", "x", "y"]), "value")


@query("j15_run_back_off", """+ r AS (SELECT o_orderkey, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS start_ts, o_orderdate + (48 + o_custkey % 24) * INTERVAL 1 HOUR AS end_ts FROM orders)
SELECT *, CASE WHEN hour(start_ts) < 6 THEN start_ts - INTERVAL 1 DAY ELSE start_ts END AS model_start, CASE WHEN hour(start_ts) > 6 AND hour(start_ts) <= 12 THEN 0 ELSE 1 END AS start_steps,
CASE WHEN hour(end_ts) < 6 THEN end_ts - INTERVAL 1 DAY ELSE end_ts END AS model_end, CASE WHEN hour(end_ts) > 6 AND hour(end_ts) <= 12 THEN -1 ELSE 0 END AS end_steps FROM r""")
def _(t: Tables):
    o = t.raw("orders")
    ranges = o.select("o_orderkey", C.plus_hours("o_orderdate", (F.col("o_orderkey") % 24).cast("int")).alias("start_ts"),
                      C.plus_hours("o_orderdate", (48 + F.col("o_custkey") % 24).cast("int")).alias("end_ts"))
    return J.run_back_off(ranges)


@query("j16_stack_channels", f"SELECT channel, count(*) AS n, {s6('avg(value)')} AS mean FROM (SELECT 'all' AS channel, value FROM frame UNION ALL SELECT channel, value FROM grid WHERE channel IN ('click', 'view')) GROUP BY channel")
def _(t: Tables):
    g = t.grid
    stacked = J.stack_channels({"all": t.frame, **{c: g.where(F.col("channel") == c).drop("channel") for c in ("click", "view")}})
    return stacked.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"))


@query("j16_channels_side_by_side", f"SELECT ts, x, y, {s6('max(value) FILTER (WHERE channel = ' + chr(39) + 'click' + chr(39) + ')')} AS click, {s6('max(value) FILTER (WHERE channel = ' + chr(39) + 'view' + chr(39) + ')')} AS view FROM grid GROUP BY ts, x, y HAVING max(value) FILTER (WHERE channel = 'click') IS NOT NULL AND max(value) FILTER (WHERE channel = 'view') IS NOT NULL")
def _(t: Tables):
    return rounded(J.channels_side_by_side(t.grid, ["click", "view"]), "click", "view")


@query("j17_common_hours", f"SELECT channel, ts, x, y, {s6('value')} AS value FROM grid WHERE ts IN (SELECT ts FROM grid GROUP BY ts HAVING count(DISTINCT channel) = (SELECT count(DISTINCT channel) FROM grid))")
def _(t: Tables):
    return rounded(J.common_hours(t.grid).select("channel", "ts", "x", "y", "value"), "value")


@query("j17_shortest_length", "+ i AS (SELECT channel, date_diff('hour', (SELECT lo FROM axis_span), ts) AS ts_idx FROM grid) SELECT channel, count(*) AS n, max(ts_idx) AS last_idx FROM i WHERE ts_idx <= (SELECT min(m) FROM (SELECT max(ts_idx) AS m FROM i GROUP BY channel)) GROUP BY channel")
def _(t: Tables):
    i = t.grid.select("channel", C.hour_index("ts", t.start).alias("ts_idx"))
    return J.shortest_length(i).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.max("ts_idx").alias("last_idx"))


@query("j18_static_layer", f"+ {LAYER} SELECT f.ts, f.x, f.y, {s6('f.value')} AS value, {s6('l.value')} AS elevation FROM frame f LEFT JOIN layer l ON l.x = f.x AND l.y = f.y")
def _(t: Tables):
    return rounded(J.attach_static(t.frame, layer(t), "elevation"), "value", "elevation")


@query("j19_pick_sensor_cells", f"SELECT s.sensor_id, f.ts, f.x, f.y, {s6('f.value')} AS value FROM frame f JOIN sensors s ON s.x = f.x AND s.y = f.y ")
def _(t: Tables):
    return rounded(J.pick_cells(t.frame, t.sensors).select("sensor_id", "ts", "x", "y", "value"), "value")


@query("j20_grid_against_next_target", f"+ e AS (SELECT s.sensor_id, avg(abs(f.value - h.value)) AS m FROM hourly h JOIN sensors s ON s.sensor_id = h.sensor_id JOIN frame f ON f.x = s.x AND f.y = s.y AND f.ts = h.ts - INTERVAL 1 HOUR GROUP BY s.sensor_id) SELECT sensor_id, {s6('m')} AS mean_error, {s6('(SELECT avg(m) FROM e)')} AS mean_of_means FROM e")
def _(t: Tables):
    targets = t.locate(t.hourly, F.col("sensor_id"))
    return rounded(J.grid_against_next_target(t.frame, targets), "mean_error", "mean_of_means")


@query("j21_collect_runs", "SELECT p_partkey AS run_id, p_brand, p_retailprice FROM part")
def _(t: Tables):
    runs = t.raw("part").select(F.col("p_partkey").alias("run_id"), "p_brand", "p_retailprice")
    first, second = runs.where(F.col("run_id") % 3 != 0), runs.where(F.col("run_id") % 3 != 1)
    return first.unionByName(second).dropDuplicates()


@query("j22_series_side_by_side", f"+ m AS (SELECT ts, avg(value) AS v, count(*) AS n FROM hourly GROUP BY ts) SELECT a.ts, {s6('a.v')} AS network_mean, CAST(a.n AS DOUBLE) AS reporting, {s6('b.v')} AS next_hour FROM m a JOIN m b ON b.ts = a.ts + INTERVAL 1 HOUR")
def _(t: Tables):
    m = t.hourly.groupBy("ts").agg(F.avg("value").alias("value"), F.count(F.lit(1)).cast("double").alias("n"))
    ahead = m.select(C.plus_hours("ts", -1).alias("ts"), "value")
    out = J.side_by_side({"network_mean": m.select("ts", "value"), "reporting": m.select("ts", F.col("n").alias("value")), "next_hour": ahead})
    return rounded(out, "network_mean", "next_hour")


@query("j23_channel_lookup", "SELECT channel, CASE WHEN channel IN ('click', 'view') THEN 'browse' ELSE 'other' END AS \"group\", CAST(row_number() OVER (ORDER BY channel) AS INTEGER) AS position, count(*) AS n FROM grid GROUP BY channel")
def _(t: Tables):
    table = t.spark.createDataFrame([(c, "browse" if c in ("click", "view") else "other", i + 1) for i, c in enumerate(CHANNELS)],
                                    "channel string, group string, position int")
    return J.label_channels(t.grid, F.broadcast(table)).groupBy("channel", "group", "position").agg(F.count(F.lit(1)).alias("n"))
