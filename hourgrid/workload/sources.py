"""IO1-IO21: documents and tables that Spark writes from the event tables and reads back."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from hourgrid.functions import columns as C
from hourgrid.operators import samples as S
from hourgrid.sources import catalog, documents as D, tables as TB
from hourgrid.workload.base import DIM, Tables, query, rounded, s6
from hourgrid.workload.samples import _frames, _series

DOC = 40        # records per landed document


def _station_docs(t: Tables) -> str:
    """Documents of at most DOC records: most with UTC, some with observed date and hour instead,
    some with neither, some service errors, some empty."""
    e = t.raw("events")
    k = F.col("event_id")
    no_utc = k % 11 == 0
    rec = F.struct(
        (F.lit(33.0) + F.col("user_id") % 10 * F.lit(0.1)).alias("Latitude"), (F.lit(-118.0) - F.col("user_id") % 7 * F.lit(0.1)).alias("Longitude"),
        F.when(~no_utc, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("UTC"),
        F.when(no_utc & (k % 3 != 0), F.date_format("ts", "yyyy-MM-dd")).alias("DateObserved"),
        F.when(no_utc, F.format_string("%d.0", F.hour("ts"))).alias("HourObserved"),
        F.when(k % 5 != 0, F.col("value")).alias("Value"), (F.col("value") * 2).alias("RawConcentration"),
        F.concat(F.lit("Site "), F.col("user_id")).alias("SiteName"), F.col("event_type").alias("AgencyName"),
        F.lpad(F.col("user_id").cast("string"), 9, "0").alias("FullAQSCode"))
    doc = F.floor(k / DOC)
    docs = e.groupBy(doc.alias("doc")).agg(F.to_json(F.collect_list(rec)).alias("text"))
    noise = docs.where(F.col("doc") % 4 == 0).select(F.explode(F.array(F.lit("[]"), F.lit('[{"WebServiceError":[{"Message":"limit"}]}]'))).alias("text"))
    path = TB.scratch_path(t.spark, "station-docs")
    docs.select("text").unionByName(noise).write.text(path)
    return path


_TIME = "CASE WHEN event_id % 11 <> 0 THEN date_trunc('minute', ts) WHEN event_id % 3 <> 0 THEN date_trunc('hour', ts) END"


@query("io1_station_records", f"SELECT lpad(CAST(user_id AS VARCHAR), 9, '0') AS sensor_id, 'Site ' || user_id AS site_name, event_type AS agency, {_TIME} AS ts, CASE WHEN event_id % 5 <> 0 THEN value ELSE value * 2 END AS value, value * 2 AS raw_value FROM events WHERE {_TIME} IS NOT NULL")
def _(t: Tables):
    return D.read_station_records(t.spark, _station_docs(t), multi_line=False).drop("lat", "lon")


@query("io2_error_documents", f"SELECT count(*) AS n_rows FROM events WHERE {_TIME} IS NOT NULL")
def _(t: Tables):
    return D.read_station_records(t.spark, _station_docs(t), multi_line=False).agg(F.count(F.lit(1)).alias("n_rows"))


@query("io3_time_from_date_and_hour", f"SELECT {_TIME} AS ts, event_id % 11 = 0 AS rebuilt, count(*) AS n, {s6('sum(value * 2)')} AS raw_sum FROM events WHERE {_TIME} IS NOT NULL GROUP BY 1, 2")
def _(t: Tables):
    rows = D.read_station_records(t.spark, _station_docs(t), multi_line=False, flag_rebuilt=True)
    return rounded(rows.groupBy("ts", "rebuilt").agg(F.count(F.lit(1)).alias("n"), F.sum("raw_value").alias("raw_sum")), "raw_sum")


def _location_docs(t: Tables) -> str:
    s = t.stations
    sub = lambda k, p: F.struct((F.col("sensor_id") * 10 + k).alias("id"), F.struct(F.lit(p).alias("id")).alias("parameter"))
    stamp = lambda c: F.struct(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"))
    rec = F.struct(
        F.col("sensor_id").alias("id"), F.concat(F.lit("Place "), F.col("sensor_id")).alias("name"), F.struct(F.col("provider").alias("name")).alias("provider"),
        F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("coordinates"),
        F.when(F.col("sensor_id") % 9 != 0, stamp("first_ts")).alias("datetimeFirst"), stamp("last_ts").alias("datetimeLast"),
        F.when(F.col("sensor_id") % 6 == 0, F.array(sub(1, 1))).otherwise(F.array(sub(1, 1), sub(2, 2), sub(3, 19))).alias("sensors"))
    docs = s.groupBy(F.floor(F.col("sensor_id") / DOC).alias("doc")).agg(F.to_json(F.struct(F.collect_list(rec).alias("results"))).alias("text"))
    path = TB.scratch_path(t.spark, "location-docs")
    docs.select("text").write.text(path)
    return path


@query("io4_locations_document", "SELECT sensor_id AS location_id, 'Place ' || sensor_id AS name, provider, lat, lon, CASE WHEN sensor_id % 9 <> 0 THEN date_trunc('second', first_ts) END AS first_ts, date_trunc('second', last_ts) AS last_ts FROM stations WHERE sensor_id % 6 <> 0")
def _(t: Tables):
    return D.read_locations(t.spark, _location_docs(t), multi_line=False).drop("sensor_id")


@query("io5_fine_particle_subsensor", "SELECT sensor_id AS location_id, sensor_id * 10 + 2 AS sensor_id FROM stations WHERE sensor_id % 6 <> 0")
def _(t: Tables):
    return D.read_locations(t.spark, _location_docs(t), multi_line=False).select("location_id", "sensor_id")


def _measurement_docs(t: Tables) -> str:
    """measurements/sensor_id=../span=FIRST_LAST/ with one document per ten readings."""
    r = t.readings
    week = F.floor(F.datediff("ts", F.lit(t.start)) / 7)
    first = F.date_add(F.lit(t.start).cast("date"), (week * 7).cast("int"))
    span = F.concat_ws("_", first.cast("string"), F.date_add(first, 7).cast("string"))
    rec = F.struct(F.col("value"), F.struct(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")).alias("datetimeFrom")).alias("period"))
    docs = (r.withColumn("span", span).groupBy("sensor_id", "span", F.floor(F.col("event_id") / 100).alias("doc"))
             .agg(F.struct(F.struct(F.lit(">1000").alias("found")).alias("meta"), F.collect_list(rec).alias("results")).alias("d")))
    path = TB.scratch_path(t.spark, "measurement-docs") + "/measurements"
    docs.select("sensor_id", "span", "d.*").write.partitionBy("sensor_id", "span").json(path)
    return path


@query("io6_measurement_documents", "SELECT sensor_id, date_trunc('second', ts) AS ts, value FROM readings")
def _(t: Tables):
    return D.read_measurements(t.spark, _measurement_docs(t), multi_line=False).drop("path")


@query("io7_date_range_from_path", "SELECT sensor_id, count(*) AS n FROM readings WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY sensor_id")
def _(t: Tables):
    rows = D.read_measurements(t.spark, _measurement_docs(t), "2024-01-10", "2024-01-19", multi_line=False)
    return rows.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"))


@query("io8_wide_csv_summary", f"SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.000') AS ts, 'sensor ' || sensor_id || '.a' AS name, {s6('value')} AS value FROM scaffold WHERE ts IN (SELECT ts FROM hourly)")
def _(t: Tables):
    path = TB.scratch_path(t.spark, "wide")
    named = t.hourly.withColumn("sensor_id", F.concat(F.lit("sensor "), F.col("sensor_id"), F.lit(".a")))
    D.write_wide_csv(named, path, [f"sensor {k}.a" for k in range(10)])
    return rounded(D.read_wide_csv(t.spark, path), "value")


@query("io9_station_weather_csv", "SELECT 'K' || user_id AS station, date_trunc('minute', ts) AS valid, CASE WHEN event_id % 4 <> 0 THEN value END AS tmpf, CASE WHEN event_id % 7 NOT IN (0, 1) THEN CAST(user_id AS DOUBLE) END AS sped FROM events")
def _(t: Tables):
    e, k = t.raw("events"), F.col("event_id")
    line = F.concat_ws(",", F.concat(F.lit("K"), F.col("user_id")), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("M"), F.lit("NA"),
                       F.when(k % 4 == 0, "M").otherwise(F.col("value").cast("string")), F.lit("M"), F.lit(""), F.lit("0"),
                       F.when(k % 7 == 0, "NA").when(k % 7 == 1, "calm").otherwise(F.col("user_id").cast("string")), F.lit("M"), F.lit("M"), F.lit("M"))
    path = TB.scratch_path(t.spark, "weather")
    lines = e.select(F.explode(F.when(k % 50 == 0, F.array(F.lit("#DEBUG: note"), line)).otherwise(F.array(line))).alias("line"))
    lines.write.text(path)
    # The header line is the declared schema; landed files carry it as their first line.
    from hourgrid import schemas
    raw = t.spark.read.option("comment", "#").schema(schemas.STATION_WEATHER).csv(path)
    return D.coerce_station_weather(raw).select("station", "valid", "tmpf", "sped")


@query("io10_json_records", f"SELECT sensor_id, ts, {s6('value')} AS value FROM hourly")
def _(t: Tables):
    path = TB.scratch_path(t.spark, "records")
    D.write_records(t.hourly.select("sensor_id", "ts", "value"), path)
    return rounded(t.spark.read.schema("sensor_id bigint, ts timestamp_ntz, value double").json(path), "value")


def _stored(t: Tables) -> str:
    path = TB.scratch_path(t.spark, "series")
    TB.save_series(t.grid, path, {"start": t.start, "end": t.end, "dim": DIM})
    return path


@query("io11_save_and_load_series", f"SELECT channel, ts, x, y, {s6('value')} AS value FROM grid WHERE channel IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'")
def _(t: Tables):
    out = TB.load_series(t.spark, _stored(t), ["click", "view"], "2024-01-05", "2024-01-25")
    return rounded(out.select("channel", "ts", "x", "y", "value"), "value")


@query("io12_cache_acceptance", "SELECT count(DISTINCT ts) AS n_hours, count(DISTINCT channel) AS n_channels, count(DISTINCT ts) = (SELECT date_diff('hour', lo, hi) FROM axis_span) AND count(DISTINCT channel) = 5 AS accepted FROM grid")
def _(t: Tables):
    return TB.series_accepted(t.spark, _stored(t), t.n_hours, 5)


@query("io13_incremental_load", "SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20') AND ts < TIMESTAMP '2024-01-28'")
def _(t: Tables):
    e, path = t.raw("events").select("event_id", "ts", F.col("event_type").alias("channel")), TB.scratch_path(t.spark, "resumed")
    TB.save_series(e.where(F.col("ts") < "2024-01-20"), path)
    return TB.resume_rows(t.spark, path, e.drop("channel"), "2024-01-28")


@query("io14_range_chunks", """+ r AS (SELECT o_custkey, min(o_orderdate) AS start_ts, max(o_orderdate) AS end_ts FROM orders GROUP BY o_custkey),
c AS (SELECT *, CAST(unnest(generate_series(0, 40)) AS INTEGER) AS chunk_no FROM r), d AS (SELECT *, start_ts + chunk_no * INTERVAL 3 MONTH AS chunk_start FROM c)
SELECT *, least(chunk_start + INTERVAL 3 MONTH, end_ts) AS chunk_end FROM d WHERE chunk_start < end_ts""")
def _(t: Tables):
    r = t.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("start_ts"), F.max("o_orderdate").alias("end_ts"))
    return TB.chunk_ranges(r.where(F.col("start_ts") < F.col("end_ts")), "3 MONTH")


# The days from the 16th on arrive ten days later, so that the stored series has a gap inside.
_LATE = "sh AS (SELECT channel, ts + CASE WHEN ts >= lo + INTERVAL 15 DAY THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END AS ts, x, y, value FROM grid, axis_span)"


@query("io15_append_chunks", f"""+ {_LATE}, d AS (SELECT CAST(unnest(generate_series(lo - INTERVAL 3 DAY, hi + INTERVAL 11 DAY, INTERVAL 1 DAY)) AS TIMESTAMP) AS day FROM axis_span),
m AS (SELECT day, day - row_number() OVER (ORDER BY day) * INTERVAL 1 DAY AS island FROM d WHERE day NOT IN (SELECT date_trunc('day', ts) FROM sh))
SELECT channel, ts, CAST(NULL AS TIMESTAMP) AS missing_until, x, y, {s6('value')} AS value FROM sh UNION ALL SELECT NULL, min(day), max(day) + INTERVAL 1 DAY, NULL, NULL, NULL FROM m GROUP BY island""")
def _(t: Tables):
    path, low, high = TB.scratch_path(t.spark, "chunks"), date.fromisoformat(t.start), date.fromisoformat(t.end)
    middle = C.ntz(str(low + timedelta(days=15)))
    late = t.grid.withColumn("ts", F.when(F.col("ts") >= middle, F.timestamp_add("DAY", F.lit(10), F.col("ts"))).otherwise(F.col("ts")))
    for _ in range(2):
        TB.append_chunks(late, path)
    asked = str(low - timedelta(days=3)), str(high + timedelta(days=12))
    rows = rounded(TB.load_chunks(t.spark, path, *asked).withColumn("missing_until", F.lit(None).cast("timestamp_ntz")), "value")
    missing = TB.missing_ranges(t.spark, path, *asked).select(F.col("start_ts").alias("ts"), F.col("end_ts").alias("missing_until"))
    return rows.unionByName(missing, allowMissingColumns=True)


_TILES = "'MOD13A2.A' || strftime(o_orderdate, '%Y%j') || '.h' || lpad(CAST(o_custkey % 36 AS VARCHAR), 2, '0') || 'v05.061.' || strftime(o_orderdate + INTERVAL 20 DAY, '%Y%j') || '123456.hdf'"


@query("io16_tile_file_names", f"SELECT {_TILES} AS name, 'MOD13A2' AS product, 'h' || lpad(CAST(o_custkey % 36 AS VARCHAR), 2, '0') || 'v05' AS tile, '061' AS version, CAST(o_orderdate AS DATE) AS acq_date, CAST(o_orderdate + INTERVAL 20 DAY AS DATE) AS production_date FROM orders")
def _(t: Tables):
    o = t.raw("orders")
    name = F.concat(F.lit("MOD13A2.A"), F.date_format("o_orderdate", "yyyyDDD"), F.lit(".h"), F.lpad((F.col("o_custkey") % 36).cast("string"), 2, "0"),
                    F.lit("v05.061."), F.date_format(F.timestamp_add("DAY", F.lit(20), F.col("o_orderdate")), "yyyyDDD"), F.lit("123456.hdf"))
    return catalog.tile_metadata(o.select(name.alias("name")))


@query("io16_granule_file_names", "SELECT event_id, date_trunc('second', ts) AS granule_ts FROM events")
def _(t: Tables):
    name = F.concat(F.lit("TRACE_NO2_L3_V03_"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("Z_S010.nc"))
    return catalog.granule_time(t.raw("events").select("event_id", name.alias("name"))).drop("name")


_INV = "inv AS (SELECT CAST(o_orderdate AS DATE) AS model_day, CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 12 ELSE 18 END AS INTEGER) AS init_hour, CASE WHEN o_custkey % 3 = 0 THEN 'ave_1hr_o3_bc' ELSE 'ave_1hr_pm25_bc' END || '.' || o_orderkey AS name FROM orders)"


@query("io17_forecast_inventory", f"+ {_INV}, p AS (SELECT *, row_number() OVER (ORDER BY model_day, init_hour, name) - 1 AS position, count(*) OVER () AS n FROM inv WHERE name LIKE '%ave_1hr_pm25_bc%' AND init_hour IN (6, 12) AND model_day BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') SELECT model_day, init_hour, name, position FROM p WHERE position >= 1 AND position < n - 1")
def _(t: Tables):
    o, k = t.raw("orders"), F.col("o_orderkey") % 4
    files = o.select(F.to_date("o_orderdate").alias("model_day"), F.when(k == 0, 0).when(k == 1, 6).when(k == 2, 12).otherwise(18).alias("init_hour"),
                     F.concat(F.when(F.col("o_custkey") % 3 == 0, "ave_1hr_o3_bc").otherwise("ave_1hr_pm25_bc"), F.lit("."), F.col("o_orderkey")).alias("name"))
    return catalog.forecast_inventory(files, "pm25", "1996-01-01", "1997-12-31", 1, -1)


_GR = "gr AS (SELECT l_orderkey, l_linenumber, l_shipdate + INTERVAL 24 YEAR AS granule_ts, CASE WHEN l_linenumber < 3 THEN 'ABI-L2-AODC' WHEN l_linenumber < 5 THEN 'ABI-L2-ADPC' ELSE 'ABI-L2-FDCC' END AS product, CASE WHEN l_linenumber IN (1, 3) THEN 'AOD' WHEN l_linenumber = 4 THEN 'Smoke' ELSE 'Power' END AS subproduct FROM lineitem)"


@query("io18_satellite_routing", f"+ {_GR} SELECT CASE WHEN granule_ts < TIMESTAMP '2022-05-01' THEN 17 ELSE 18 END AS satellite, product, subproduct, count(*) AS n FROM gr WHERE granule_ts >= TIMESTAMP '2018-09-01' AND (product, subproduct) IN (('ABI-L2-AODC', 'AOD'), ('ABI-L2-ADPC', 'Smoke'), ('ABI-L2-FDCC', 'Power')) GROUP BY ALL")
def _(t: Tables):
    ln = F.col("l_linenumber")
    gr = t.raw("lineitem").select(
        F.timestamp_add("YEAR", F.lit(24), F.col("l_shipdate")).alias("granule_ts"),
        F.when(ln < 3, "ABI-L2-AODC").when(ln < 5, "ABI-L2-ADPC").otherwise("ABI-L2-FDCC").alias("product"),
        F.when(ln.isin(1, 3), "AOD").when(ln == 4, "Smoke").otherwise("Power").alias("subproduct"))
    return catalog.route_satellite(gr).groupBy("satellite", "product", "subproduct").agg(F.count(F.lit(1)).alias("n"))


def _windows(t: Tables):
    frames = S.rebase(S.temporal_split(_frames(t), "ts_idx", t.n_hours), keys=("channel",))
    return S.sliding_windows(frames, 8, 4, 4, keys=("split", "channel"))


def _exported(t: Tables) -> str:
    path = TB.scratch_path(t.spark, "windows")
    w = _windows(t)
    TB.save_windows(w, path, S.fit_scalers(_series(t), (), split=None), {"frames": 8, "targets": 4})
    return path


_SPLITS = "SELECT split, (len - 12) // 4 + 1 AS n FROM (VALUES ('train', CAST(trunc((SELECT date_diff('hour', lo, hi) FROM axis_span) * 0.7e0) AS INTEGER)), ('valid', CAST(trunc((SELECT date_diff('hour', lo, hi) FROM axis_span) * 0.85e0) AS INTEGER) - CAST(trunc((SELECT date_diff('hour', lo, hi) FROM axis_span) * 0.7e0) AS INTEGER)), ('test', (SELECT date_diff('hour', lo, hi) FROM axis_span) - CAST(trunc((SELECT date_diff('hour', lo, hi) FROM axis_span) * 0.85e0) AS INTEGER))) v(split, len), (SELECT count(*) AS c FROM events) WHERE c > 0"


@query("io19_export_windows", f"SELECT split, n AS n_samples, n * 80 AS n_values FROM ({_SPLITS})")
def _(t: Tables):
    x = t.spark.read.parquet(_exported(t) + "/x")
    return x.groupBy("split").agg(F.count(F.lit(1)).alias("n_samples"), F.sum(F.size(F.flatten("frames"))).alias("n_values"))


@query("io20_integrity_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice * 100 >= 10000000")
def _(t: Tables):
    o = t.raw("orders")
    files = o.select("o_orderkey", (F.col("o_totalprice") * 100).alias("length"))
    return catalog.intact_files(o.select("o_orderkey", "o_custkey"), files, key="o_orderkey")


@query("io21_split_feature_table", f"SELECT split, 'pm' AS channel, n AS n_samples FROM ({_SPLITS}) WHERE split = 'valid'")
def _(t: Tables):
    rows = TB.load_windows(t.spark, _exported(t), "x", "valid", ["pm"])
    return rows.groupBy("split", "channel").agg(F.count(F.lit(1)).alias("n_samples"))
