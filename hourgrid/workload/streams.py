"""ST1-ST4: streams over the event files, run until all landed files are processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.sources.tables import scratch_path
from hourgrid.streaming import live
from hourgrid.workload.base import Tables, locate_sql, query, rounded, s6

INNER = (-118.5, -117.3, 33.7, 34.3)


def _stream(t: Tables):
    rows = live.read_stream(t.spark, t.sf_dir, "events.parquet")
    return rows.select("event_id", "ts", (F.col("user_id") % 10).alias("sensor_id"), "value")


def _run(t: Tables, stream, label: str):
    base = scratch_path(t.spark, label)
    out = live.run_to_table(stream, f"{base}/out", f"{base}/checkpoint")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_MARK = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@query("st1_tumbling_hour_mean", f"SELECT sensor_id, ts, {s6('value')} AS value, n FROM hourly WHERE ts + INTERVAL 1 HOUR <= {_MARK}")
def _(t: Tables):
    return rounded(_run(t, live.hourly_means(_stream(t)), "hour-means"), "value")


@query("st2_clean_on_arrival", f"""+ st AS (SELECT sensor_id, avg(value) AS m, stddev_samp(value) AS s FROM readings GROUP BY sensor_id),
l AS (SELECT r.event_id, r.sensor_id, r.ts, CASE WHEN value > 0 AND value < 1 THEN 1e0 WHEN value >= 0 THEN value END AS v, {locate_sql('r.sensor_id')} FROM readings r),
c AS (SELECT l.*, CASE WHEN abs(v - m) / nullif(s, 0e0) > 3 THEN NULL ELSE v END AS z FROM l JOIN st ON st.sensor_id = l.sensor_id)
SELECT event_id, sensor_id, ts, CASE WHEN z <= 250 THEN z END AS value FROM c WHERE lat BETWEEN 33.7e0 AND 34.3e0 AND lon BETWEEN -118.5e0 AND -117.3e0""")
def _(t: Tables):
    stats = t.readings.groupBy("sensor_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    rows = t.locate(_stream(t), F.col("sensor_id"))
    return _run(t, live.clean_on_arrival(rows, stats, INNER, cap=250.0).select("event_id", "sensor_id", "ts", "value"), "clean")


def _nowcast_sql() -> str:
    names = ", ".join(f"v{k}" for k in range(12))
    lags = ", ".join(f"lag(value, {k}) OVER w AS v{k}" for k in range(12))
    num = den = "0e0"
    for k in range(11, -1, -1):
        num, den = f"({num} * w + coalesce(v{k}, 0e0))", f"({den} * w + CASE WHEN v{k} IS NULL THEN 0e0 ELSE 1e0 END)"
    return f"""+ g AS (SELECT *, CASE WHEN date_diff('hour', lag(ts) OVER (PARTITION BY sensor_id ORDER BY ts), ts) <= 12 THEN 0 ELSE 1 END AS fresh FROM hourly),
ss AS (SELECT *, sum(fresh) OVER (PARTITION BY sensor_id ORDER BY ts) AS sess FROM g), span AS (SELECT sensor_id, sess, min(ts) AS a, max(ts) + INTERVAL 11 HOUR AS b FROM ss GROUP BY sensor_id, sess),
em AS (SELECT span.sensor_id, sess, x.ts, h.value FROM span JOIN axis x ON x.ts BETWEEN a AND b AND x.ts + INTERVAL 1 HOUR <= {_MARK} LEFT JOIN hourly h ON h.sensor_id = span.sensor_id AND h.ts = x.ts),
l AS (SELECT sensor_id, ts, last_value(value IGNORE NULLS) OVER w AS carried, row_number() OVER w AS rn, {lags} FROM em WINDOW w AS (PARTITION BY sensor_id, sess ORDER BY ts)),
h2 AS (SELECT *, greatest({names}) AS hi, least({names}) AS lo FROM l), ww AS (SELECT *, greatest(0.5e0, 1 - (hi - lo) / nullif(hi, 0e0)) AS w FROM h2)
SELECT sensor_id, ts, {s6('carried')} AS carried, CASE WHEN rn < 12 OR CAST(v0 IS NULL AS INT) + CAST(v1 IS NULL AS INT) + CAST(v2 IS NULL AS INT) >= 2 THEN NULL WHEN hi = 0 THEN 0e0 ELSE greatest(0e0, trunc({num} / {den} * 10) / 10) END AS nowcast FROM ww"""


@query("st3_carry_and_nowcast", _nowcast_sql())
def _(t: Tables):
    with live.use_rocksdb(t.spark):
        return rounded(_run(t, live.carry_and_nowcast(_stream(t)), "nowcast"), "carried")


@query("st4_deduplicated_append", "SELECT event_id, sensor_id, ts, value FROM readings")
def _(t: Tables):
    twice = _stream(t).unionByName(_stream(t))
    base = scratch_path(t.spark, "append")
    out = live.append_once(twice, f"{base}/out", f"{base}/checkpoint")
    return out.select("event_id", "sensor_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
