"""Composite jobs over the event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.functions import columns as C
from hourgrid.operators import fills as T
from hourgrid.operators import gridding as G
from hourgrid.operators import samples as S
from hourgrid.plans import gridded, ground, learning
from hourgrid.workload.base import DIM, EXTENT, Tables, query, r6, rounded, s6
from hourgrid.workload.gridding import ELEV, SPAN, XY, _J6, _line_sql, elevation
from hourgrid.workload.joins import acquisition, run_of, run_of_sql
from hourgrid.workload.samples import N, WIND, _tile, _union_sql
from hourgrid.workload.scoring import _CELL, _PARTS, F_TP
from hourgrid.workload.temporal import _DENSE, _dense, _nowcast_sql

def _axis(t: Tables) -> ground.Axis:
    return ground.Axis(t.start, t.end)


INNER = (-118.6, -117.1, 33.55, 34.5)
_IN = "lat BETWEEN 33.55e0 AND 34.5e0 AND lon BETWEEN -118.6e0 AND -117.1e0"


# ------------------------------------------------------------------ SQL building blocks
def _full_cte(out: str, src: str) -> str:
    return f"{out} AS (SELECT s.sensor_id, a.ts, h.value FROM (SELECT DISTINCT sensor_id FROM {src}) s CROSS JOIN axis a LEFT JOIN {src} h ON h.sensor_id = s.sensor_id AND h.ts = a.ts)"


def _zscore_cte(out: str, src: str, cap: str) -> str:
    return (f"{out}z AS (SELECT *, avg(value) OVER (PARTITION BY sensor_id) AS m, stddev_samp(value) OVER (PARTITION BY sensor_id) AS sd FROM {src}), "
            f"{out} AS (SELECT sensor_id, ts, CASE WHEN v {cap} THEN NULL ELSE v END AS value FROM (SELECT sensor_id, ts, CASE WHEN abs((value - m) / sd) > 3 THEN NULL ELSE value END AS v FROM {out}z))")


def _sparse_cte(out: str, src: str) -> str:
    return f"{out} AS (SELECT s.sensor_id, s.ts, CASE WHEN n.n > floor(0.3e0 * (SELECT count(DISTINCT sensor_id) FROM {src})) THEN s.value END AS value FROM {src} s JOIN (SELECT ts, count(value) AS n FROM {src} GROUP BY ts) n ON n.ts = s.ts)"


def _idw_cte(out: str, src: str, k: int = 10) -> str:
    return (f"{out}d AS (SELECT f.ts, k.x, k.y, f.value AS v, f.x AS px, f.y AS py, pow(k.x - f.x, 2) + pow(k.y - f.y, 2) AS d FROM {src} f CROSS JOIN k WHERE f.value IS NOT NULL), "
            f"{out}n AS (SELECT *, row_number() OVER (PARTITION BY ts, x, y ORDER BY d, px, py) AS r FROM {out}d), "
            f"{out} AS (SELECT ts, x, y, coalesce(max(CASE WHEN d = 0 THEN v END), sum(v / nullif(d, 0e0)) / sum(1 / nullif(d, 0e0))) AS value FROM {out}n WHERE r <= {k} OR d = 0 GROUP BY ts, x, y)")


def _carry_cte(out: str, src: str) -> str:
    return (f"{out}s AS (SELECT a.ts, coalesce(last_value(g.ts IGNORE NULLS) OVER (ORDER BY a.ts), first_value(g.ts IGNORE NULLS) OVER (ORDER BY a.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS src FROM axis a LEFT JOIN (SELECT DISTINCT ts FROM {src} WHERE value IS NOT NULL) g ON g.ts = a.ts), "
            f"{out} AS (SELECT s.ts, g.x, g.y, g.value FROM {out}s s JOIN {src} g ON g.ts = s.src WHERE g.value IS NOT NULL)")


def _resize_cte(out: str, src: str, n_in: int, dim: int, rule: str, keys: str = "ts") -> str:
    on = ", ".join(f"h.{k}" for k in keys.split(", "))
    return (f"{_line_sql(out + 'l', n_in, dim, rule)}, {out}q AS (SELECT o, count(*) AS n FROM {out}l GROUP BY o), "
            f"{out}a AS (SELECT {on}, r.o AS x, c.o AS y, sum(h.value * r.w * c.w) AS s, count(h.value) AS c FROM {src} h JOIN {out}l r ON r.i = h.x JOIN {out}l c ON c.i = h.y GROUP BY {on}, r.o, c.o), "
            f"{out} AS (SELECT {keys}, a.x, a.y, CASE WHEN a.c = nr.n * nc.n THEN a.s END AS value FROM {out}a a JOIN {out}q nr ON nr.o = a.x JOIN {out}q nc ON nc.o = a.y)")


def _near_cte(out: str, src: str, dim: int, keys: str = "ts") -> str:
    on = ", ".join(f"f.{k}" for k in keys.split(", "))
    return (f"{out}k AS (SELECT CAST(g // {dim} AS INTEGER) AS x, CAST(g % {dim} AS INTEGER) AS y FROM (SELECT unnest(generate_series(0, {dim * dim - 1})) AS g)), "
            f"{out} AS (SELECT {on}, k.x, k.y, arg_min(f.value, (pow(k.x - f.x, 2) + pow(k.y - f.y, 2), f.x, f.y)) AS value FROM {src} f CROSS JOIN {out}k k WHERE f.value IS NOT NULL GROUP BY {on}, k.x, k.y)")


def _status_cte(out: str, gran: str) -> str:
    return f"{out} AS (SELECT ts, src_ts, CASE WHEN ok THEN 'valid' WHEN src_ts IS NULL THEN 'zero_no_prior' WHEN ok IS NULL THEN 'forward_fill_missing' ELSE 'forward_fill_bad_qa' END AS status FROM (SELECT a.ts, g.ok, last_value(CASE WHEN g.ok THEN g.ts END IGNORE NULLS) OVER (ORDER BY a.ts) AS src_ts FROM axis a LEFT JOIN {gran} g ON g.ts = a.ts))"


def _show_cte(out: str, src: str, status: str, dim: int) -> str:
    return (f"{out}k AS (SELECT CAST(g // {dim} AS INTEGER) AS x, CAST(g % {dim} AS INTEGER) AS y FROM (SELECT unnest(generate_series(0, {dim * dim - 1})) AS g)), "
            f"{out} AS (SELECT s.ts, k.x, k.y, s.status, CASE WHEN s.src_ts IS NULL THEN 0e0 ELSE g.value END AS value FROM {status} s CROSS JOIN {out}k k LEFT JOIN {src} g ON g.ts = s.src_ts AND g.x = k.x AND g.y = k.y)")


def _smooth_cte(src: str, keep: float, fade: float, full: str, state: str | None = None) -> str:
    """``state``: the frames that decide which hours are empty, where they are not ``src`` itself."""
    return f"""sl AS (SELECT ts, {full} > 0 AS isfull FROM {state or src} GROUP BY ts), sf AS (SELECT s.*, sl.isfull FROM {src} s JOIN sl ON sl.ts = s.ts), sg AS (SELECT *, min(CASE WHEN isfull THEN ts END) OVER () AS ff, date_diff('hour', (SELECT lo FROM axis_span), ts) AS i FROM sf),
sm AS (SELECT x, y, i, ts, value FROM sg WHERE i = 0 UNION ALL SELECT f.x, f.y, f.i, f.ts, CASE WHEN coalesce(f.ts > f.ff, false) THEN CASE WHEN f.isfull THEN r.value * {keep}e0 + f.value * (1e0 - {keep}e0) ELSE r.value * {fade}e0 END ELSE f.value END FROM sm r JOIN sg f ON f.x = r.x AND f.y = r.y AND f.i = r.i + 1)"""


# ------------------------------------------------------------------ ground sensors
_OBS = "ob AS (SELECT h.sensor_id, h.ts, h.value, s.lat, s.lon FROM hourly h JOIN sensors s ON s.sensor_id = h.sensor_id)"
_UP = "up AS (SELECT sensor_id FROM ob GROUP BY sensor_id HAVING count(*) / CAST((SELECT count(DISTINCT ts) FROM ob) AS DOUBLE) > {m}e0)"
_P1 = (f"{_OBS}, {_UP.format(m=0.1)}, fl AS (SELECT sensor_id, ts, CASE WHEN value > 0 AND value < 1 THEN 1e0 WHEN value >= 0 THEN value END AS value FROM ob WHERE sensor_id IN (SELECT sensor_id FROM up) AND {_IN}), "
       f"{_full_cte('fu', 'fl')}, {_zscore_cte('zc', 'fu', '> 120')}, {_sparse_cte('cl', 'zc')}")


def _obs(t: Tables):
    return t.locate(t.hourly.select("sensor_id", "ts", "value"), F.col("sensor_id")).drop("x", "y")


def _p1(t: Tables):
    return ground.station_clean(_obs(t), _axis(t), INNER, min_uptime=0.1, cap=120.0)


@query("p1_station_clean", f"+ {_P1} SELECT sensor_id, ts, {s6('value')} AS value FROM cl")
def _(t: Tables):
    return rounded(_p1(t).select("sensor_id", "ts", "value"), "value")


_P2 = f"{_P1}, {XY}, pl AS (SELECT c.ts, s.x, s.y, arg_max(c.value, c.sensor_id) AS value FROM cl c JOIN sensors s ON s.sensor_id = c.sensor_id WHERE c.value >= 0 GROUP BY c.ts, s.x, s.y), {_carry_cte('ca', 'pl')}, {_idw_cte('iw', 'ca')}"


def _p2(t: Tables):
    return ground.station_grids(_p1(t), t.axis, EXTENT, DIM)


@query("p2_station_grids", f"+ {_P2} SELECT ts, x, y, {s6('value')} AS value FROM iw")
def _(t: Tables):
    return rounded(_p2(t), "value")


@query("p3_station_clean_filled", f"+ {_OBS}, {_UP.format(m=0.15)}, fl AS (SELECT sensor_id, ts, CASE WHEN value >= 0 THEN value END AS value FROM ob WHERE sensor_id IN (SELECT sensor_id FROM up)), {_full_cte('fu', 'fl')}, {_zscore_cte('zc', 'fu', '> 1e9')} SELECT sensor_id, ts, {s6('coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY ts), first_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS value FROM zc")
def _(t: Tables):
    return rounded(ground.station_clean_filled(_obs(t), _axis(t), 0.15).select("sensor_id", "ts", "value"), "value")


def _network_sql(src: str, uptime: float, cap: str, nowcast: bool = False, inside: str = _IN) -> str:
    parts = [src, _full_cte("f0", "ob").replace("f0 AS (", "f0 AS MATERIALIZED ("), f"f1 AS MATERIALIZED (SELECT f0.* FROM f0 WHERE sensor_id IN (SELECT sensor_id FROM f0 GROUP BY sensor_id HAVING count(value) / CAST(count(*) AS DOUBLE) >= {uptime}e0) AND sensor_id IN (SELECT sensor_id FROM net WHERE {inside}))"]
    last = "f1"
    if nowcast:
        body = _nowcast_sql()[1:].replace("scaffold", "f1")
        ctes, select = body.rsplit("\nSELECT ", 1)
        parts += [ctes.strip(), f"f2 AS (SELECT {select.replace('AS nowcast FROM ww', 'AS value FROM ww')})"]
        last = "f2"
    parts += [_zscore_cte("zc", last, cap),
              "fi AS MATERIALIZED (SELECT sensor_id, ts, value AS raw, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY ts), first_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM zc)",
              "fd AS MATERIALIZED (SELECT fi.sensor_id, fi.ts, CASE WHEN d.dead THEN filled ELSE raw END AS value FROM fi JOIN (SELECT ts, count(raw) = 0 AS dead FROM fi GROUP BY ts) d ON d.ts = fi.ts)",
              f"al AS MATERIALIZED (SELECT * FROM net WHERE {inside} AND sensor_id IN (SELECT sensor_id FROM fd))",
              "pc AS MATERIALIZED (SELECT s.* FROM al s LEFT JOIN (SELECT DISTINCT x, y FROM al WHERE provider = 'reference') r ON r.x = s.x AND r.y = s.y WHERE s.provider = 'reference' OR r.x IS NULL)",
              "nc AS MATERIALIZED (SELECT fd.* FROM fd WHERE sensor_id IN (SELECT sensor_id FROM pc))"]
    return ", ".join(parts)


_NET = "net AS (SELECT * FROM stations WHERE provider IN ('reference', 'community')), ob AS (SELECT r.user_id AS sensor_id, r.hour AS ts, avg(r.value) AS value FROM readings r WHERE r.user_id IN (SELECT sensor_id FROM net) GROUP BY 1, 2)"
def _ref():
    return F.col("provider") == "reference"


@query("p4_network_clean", "+ " + _network_sql(_NET, 0.05, ">= 150") + f" SELECT sensor_id, ts, {s6('value')} AS value FROM nc")
def _(t: Tables):
    obs = t.readings.groupBy(F.col("user_id").alias("sensor_id"), F.col("hour").alias("ts")).agg(F.avg("value").alias("value"))
    clean, _ = ground.network_clean(obs, t.stations, _axis(t), INNER, DIM, _ref(), ["reference", "community"], 0.05, cap=150.0)
    return rounded(clean.select("sensor_id", "ts", "value"), "value")


_TEN = "net AS (SELECT *, CASE WHEN sensor_id = 3 THEN 'reference' ELSE 'community' END AS provider FROM sensors), ob AS (SELECT sensor_id, ts, value FROM hourly)"


@query("p4_network_clean_nowcast", "+ " + _network_sql(_TEN, 0.05, ">= 150", nowcast=True) + f" SELECT sensor_id, ts, {s6('value')} AS value FROM nc")
def _(t: Tables):
    sensors = t.sensors.withColumn("provider", F.when(F.col("sensor_id") == 3, "reference").otherwise("community"))
    clean, _ = ground.network_clean(t.hourly.select("sensor_id", "ts", "value"), sensors, _axis(t), INNER, DIM, _ref(), (), 0.05, cap=150.0, use_nowcast=True)
    return rounded(clean.select("sensor_id", "ts", "value"), "value")


_HALF = "date_trunc('hour', ts) + CASE WHEN epoch_us(ts) % 3600000000 > 1800000000 OR (epoch_us(ts) % 3600000000 = 1800000000 AND (epoch_us(ts) // 3600000000) % 2 = 1) THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END"
_LIVE = f"net AS (SELECT * FROM stations WHERE last_ts > (SELECT lo FROM axis_span) AND first_ts < (SELECT hi FROM axis_span)), ob AS (SELECT user_id AS sensor_id, h AS ts, arg_max(value, event_id) AS value FROM (SELECT user_id, event_id, value, {_HALF} AS h FROM readings) WHERE user_id IN (SELECT sensor_id FROM net) GROUP BY 1, 2)"


@query("p5_network_grids", "+ " + _network_sql(_LIVE, 0.05, ">= 300", inside="true") + f", {XY}, mg AS (SELECT nc.ts, pc.x, pc.y, avg(nc.value) AS value FROM nc JOIN pc ON pc.sensor_id = nc.sensor_id GROUP BY nc.ts, pc.x, pc.y), {_idw_cte('iw', 'mg')} SELECT f.ts, k.x, k.y, {s6('iw.value')} AS value FROM (SELECT DISTINCT ts FROM mg) f CROSS JOIN k LEFT JOIN iw ON iw.ts = f.ts AND iw.x = k.x AND iw.y = k.y")
def _(t: Tables):
    raw = t.raw("events").select(F.col("user_id").alias("sensor_id"), "event_id", "ts", "value")
    return rounded(ground.network_series(raw, t.stations, _axis(t), EXTENT, DIM, _ref(), min_uptime=0.05, cap=300.0), "value")


# ------------------------------------------------------------------ gridded sources
_SWATH = "swath AS (SELECT event_id, ts AS granule_ts, hour, CAST(user_id % 3 AS INTEGER) AS x, CAST(event_id % 3 AS INTEGER) AS y, value FROM readings)"


def _swath(t: Tables):
    return t.readings.select("event_id", F.col("ts").alias("granule_ts"), "hour", (F.col("user_id") % 3).cast("int").alias("x"), (F.col("event_id") % 3).cast("int").alias("y"), "value")


@query("p6_geostationary_series", f"""+ {_SWATH}, fr AS (SELECT hour + INTERVAL 1 HOUR AS ts, x, y, avg(CASE WHEN event_id % 4 IN (0, 1) THEN value END) AS value FROM swath GROUP BY 1, 2, 3), {_resize_cte('rs', 'fr', 3, 4, 'half_pixel')},
gt AS (SELECT ts, x, y, CASE WHEN count(value) OVER (PARTITION BY ts) / CAST(count(*) OVER (PARTITION BY ts) AS DOUBLE) >= 0.2e0 THEN value END AS value FROM rs), {_near_cte('nf', 'gt', 4)}, gr AS (SELECT ts, count(value) > 0 AS ok FROM gt GROUP BY ts), {_status_cte('st', 'gr')}, {_show_cte('sh', 'nf', 'st', 4)}
SELECT ts, x, y, {s6('value')} AS value FROM sh""")
def _(t: Tables):
    px = _swath(t).select("event_id", "granule_ts", F.col("x").alias("row"), F.col("y").alias("col"), "value")
    return rounded(gridded.geostationary_series(px, C.quality_categorical(F.col("event_id") % 4, "aerosol_depth"), t.axis, (3, 3), 4), "value")


# A 6 x 6 lattice; the extent holds its rows 1 to 3 and columns 2 to 4.
_WIDE = "wide AS (SELECT event_id, ts AS granule_ts, hour, CAST(user_id % 6 AS INTEGER) AS x, CAST(event_id % 6 AS INTEGER) AS y, value FROM readings), swath AS (SELECT event_id, granule_ts, hour, x - 1 AS x, y - 2 AS y, value FROM wide WHERE x BETWEEN 1 AND 3 AND y BETWEEN 2 AND 4)"
_WIDE_EXTENT = (-117.9, -117.5, 33.65, 34.15)


def _wide(t: Tables):
    x, y = (F.col("user_id") % 6).cast("int"), (F.col("event_id") % 6).cast("int")
    return t.readings.select("event_id", F.col("ts").alias("granule_ts"), "hour", x.alias("x"), y.alias("y"), "value",
                             (F.lit(34.3) - x * F.lit(0.2)).alias("lat"), (F.lit(-118.2) + y * F.lit(0.17)).alias("lon"))


@query("p6_geostationary_extent", f"""+ {_WIDE}, fr AS (SELECT hour + INTERVAL 1 HOUR AS ts, x, y, avg(CASE WHEN event_id % 4 IN (0, 1) THEN value END) AS value FROM swath GROUP BY 1, 2, 3), {_resize_cte('rs', 'fr', 3, 4, 'half_pixel')},
gt AS (SELECT ts, x, y, CASE WHEN count(value) OVER (PARTITION BY ts) / CAST(count(*) OVER (PARTITION BY ts) AS DOUBLE) >= 0.2e0 THEN value END AS value FROM rs), {_near_cte('nf', 'gt', 4)}, gr AS (SELECT ts, count(value) > 0 AS ok FROM gt GROUP BY ts), {_status_cte('st', 'gr')}, {_show_cte('sh', 'nf', 'st', 4)}
SELECT ts, x, y, {s6('value')} AS value FROM sh""")
def _(t: Tables):
    px = _wide(t).select("event_id", "granule_ts", F.col("x").alias("row"), F.col("y").alias("col"), "lat", "lon", "value")
    quality = C.quality_categorical(F.col("event_id") % 4, "aerosol_depth")
    return rounded(gridded.geostationary_series(px, quality, t.axis, (6, 6), 4, extent=_WIDE_EXTENT), "value")


_BIN = "hour + (minute(granule_ts) // 20 * 20) * INTERVAL 1 MINUTE"


@query("p7_column_series", f"""+ {_SWATH}, px AS (SELECT {_BIN} AS granule_ts, hour AS ts, CAST(x % 2 AS INTEGER) AS x, CAST(event_id % 2 AS INTEGER) AS y, avg(value) * 1e15 AS value, min(event_id % 5) - 1 AS qa, min(event_id % 10) / 10e0 AS cloud FROM swath GROUP BY 1, 2, 3, 4),
nw AS (SELECT p.ts, p.x, p.y, CASE WHEN qa <= 0 AND cloud < 0.5e0 THEN value END AS value FROM px p JOIN (SELECT ts, max(granule_ts) AS g FROM px GROUP BY ts) m ON m.g = p.granule_ts),
gr AS (SELECT ts, count(value) / CAST(count(*) AS DOUBLE) >= 0.1e0 AS ok FROM nw GROUP BY ts), fm AS (SELECT nw.ts, x, y, coalesce(value, avg(value) OVER (PARTITION BY nw.ts)) AS value FROM nw JOIN gr ON gr.ts = nw.ts AND gr.ok), {_resize_cte('rs', 'fm', 2, 4, 'corner')},
fp AS (SELECT ts, 3 - x AS x, y, value / 1e16 AS value FROM rs), {_status_cte('st', 'gr')}, {_show_cte('sh', 'fp', 'st', 4)} SELECT ts, x, y, status, {s6('value')} AS value FROM sh""")
def _(t: Tables):
    s = _swath(t)
    g = F.timestamp_add("MINUTE", (F.floor(F.minute("granule_ts") / 20) * 20).cast("int"), F.col("hour"))
    px = s.groupBy(g.alias("granule_ts"), (F.col("x") % 2).cast("int").alias("row"), (F.col("event_id") % 2).cast("int").alias("col")).agg(
        (F.avg("value") * 1e15).alias("value"), (F.min(F.col("event_id") % 5) - 1).alias("qa"), (F.min(F.col("event_id") % 10) / 10).alias("cloud"))
    return rounded(gridded.column_series(px, t.axis, (2, 2), 4), "value").select("ts", "x", "y", "status", "value")


_MOD = "md AS (SELECT hour AS ts, user_id % 12 AS \"row\", user_id // 12 % 12 AS col, avg(value) AS value, avg(value) * 0.5e0 AS v2 FROM readings GROUP BY 1, 2, 3), ml AS (SELECT *, \"row\" * 12 + col AS pixel, 33.4e0 + \"row\" * 0.1e0 + col * 0.003e0 AS lat, -118.9e0 + col * 0.17e0 + \"row\" * 0.003e0 AS lon FROM md)"


def _model_px(t: Tables):
    u = F.col("user_id")
    m = t.readings.groupBy(F.col("hour").alias("ts"), (u % 12).alias("row"), (F.floor(u / 12) % 12).alias("col")).agg(F.avg("value").alias("value"))
    r, c = F.col("row"), F.col("col")
    return m.select("ts", "row", "col", "value", (F.col("value") * F.lit(0.5)).alias("v2"), (r * 12 + c).alias("pixel"),
                    (F.lit(33.4) + r * F.lit(0.1) + c * F.lit(0.003)).alias("lat"), (F.lit(-118.9) + c * F.lit(0.17) + r * F.lit(0.003)).alias("lon"))


_NODE_COLS = f"(34.5e0 - lat) / (1e0 / 7) AS fx, (lon - -118.75e0) / ({SPAN} / 7) AS fy"
_HITS = "hit AS (SELECT min(\"row\") AS r0, max(\"row\") AS r1, min(col) AS c0, max(col) AS c1 FROM ml WHERE lat BETWEEN 33.5e0 AND 34.5e0 AND lon BETWEEN -118.75e0 AND -117.05e0)"


@query("p8_model_series", f"""+ {XY}, {_MOD}, {_HITS}, wn AS (SELECT ml.ts, pixel, value * 1e9 AS value, {_NODE_COLS} FROM ml, hit WHERE "row" BETWEEN r0 - 2 AND r1 + 2 AND col BETWEEN c0 - 2 AND c1 + 2),
nn AS (SELECT wn.ts, k.x, k.y, arg_min(value, (round(pow(fx - k.x, 2) + pow(fy - k.y, 2), 12), pixel)) AS value FROM wn CROSS JOIN k GROUP BY wn.ts, k.x, k.y), {_carry_cte('ca', 'nn')} SELECT ts, x, y, round(value / 1e9, 6) AS value FROM ca""")
def _(t: Tables):
    out = gridded.model_series(_model_px(t), t.axis, EXTENT, DIM, "smoke_mass")
    return out.withColumn("value", F.round(F.col("value") / 1e9, 6))


_AL = "atan(tan(radians(lon + 97.5e0)) * 0.6225146366376195e0)"


@query("p8_model_wind_series", f"""+ {XY}, {_MOD}, {_HITS}, wn AS (SELECT ml.ts, pixel, value * cos({_AL}) + v2 * sin({_AL}) AS u, -value * sin({_AL}) + v2 * cos({_AL}) AS v, {_NODE_COLS} FROM ml, hit WHERE "row" BETWEEN r0 - 2 AND r1 + 2 AND col BETWEEN c0 - 2 AND c1 + 2),
n2 AS (SELECT wn.ts, k.x, k.y, arg_min(u, (round(pow(fx - k.x, 2) + pow(fy - k.y, 2), 12), pixel)) AS u, arg_min(v, (round(pow(fx - k.x, 2) + pow(fy - k.y, 2), 12), pixel)) AS v FROM wn CROSS JOIN k GROUP BY wn.ts, k.x, k.y),
nu AS (SELECT ts, x, y, u AS value FROM n2), nv AS (SELECT ts, x, y, v AS value FROM n2), {_carry_cte('cu', 'nu')}, {_carry_cte('cv', 'nv')} SELECT 'wind_u' AS channel, ts, x, y, {s6('value')} AS value FROM cu UNION ALL SELECT 'wind_v', ts, x, y, {s6('value')} FROM cv""")
def _(t: Tables):
    px = _model_px(t).select("*", F.col("value").alias("u"), F.col("v2").alias("v"))
    return rounded(gridded.model_wind_series(px, t.axis, EXTENT, DIM), "value").select("channel", "ts", "x", "y", "value")


_FILES = f"{_SWATH}, i0 AS (SELECT {run_of_sql('hour')} AS init_ts, x, y, avg(value) AS value FROM swath GROUP BY 1, 2, 3), fc AS (SELECT init_ts, init_ts + k * INTERVAL 1 HOUR AS valid_ts, x, y, value + k AS value FROM i0 CROSS JOIN (SELECT CAST(unnest(generate_series(1, 30)) AS INTEGER) AS k))"


@query("p9_forecast_series", f"""+ {_FILES}, rk AS (SELECT *, row_number() OVER (PARTITION BY init_ts ORDER BY valid_ts) AS r FROM (SELECT DISTINCT init_ts, valid_ts FROM fc)),
us AS (SELECT fc.* FROM fc JOIN rk ON rk.init_ts = fc.init_ts AND rk.valid_ts = fc.valid_ts WHERE r <= CASE hour(rk.init_ts) WHEN 6 THEN 6 WHEN 12 THEN 18 ELSE 24 END AND rk.valid_ts >= (SELECT lo FROM axis_span) AND rk.valid_ts < (SELECT hi FROM axis_span)), {_resize_cte('rs', 'us', 3, 5, 'half_pixel', 'init_ts, valid_ts')},
lw AS (SELECT valid_ts AS ts, x, y, arg_max_null(value, init_ts) AS value FROM rs GROUP BY 1, 2, 3), q AS (SELECT CAST(g // 5 AS INTEGER) AS x, CAST(g % 5 AS INTEGER) AS y FROM (SELECT unnest(generate_series(0, 24)) AS g))
SELECT ts, x, y, {s6('value')} AS value FROM lw UNION ALL SELECT a.ts, q.x, q.y, 0e0 FROM axis a CROSS JOIN q WHERE a.ts NOT IN (SELECT ts FROM lw)""")
def _(t: Tables):
    i0 = _swath(t).groupBy(run_of("hour").alias("init_ts"), "x", "y").agg(F.avg("value").alias("value"))
    k = i0.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(30))))
    fc = k.select("init_ts", C.plus_hours("init_ts", F.col("k")).alias("valid_ts"), "x", "y", (F.col("value") + F.col("k")).alias("value"))
    return rounded(gridded.forecast_series(fc, t.axis, (3, 3), 5), "value")


@query("p9_forecast_extent", f"""+ {_WIDE}, fc AS (SELECT date_trunc('day', hour) - INTERVAL 12 HOUR AS init_ts, hour + INTERVAL 1 HOUR AS valid_ts, x, y, avg(value) AS value FROM swath GROUP BY 1, 2, 3, 4), rk AS (SELECT *, row_number() OVER (PARTITION BY init_ts ORDER BY valid_ts) AS r FROM (SELECT DISTINCT date_trunc('day', hour) - INTERVAL 12 HOUR AS init_ts, hour + INTERVAL 1 HOUR AS valid_ts FROM wide)),
us AS (SELECT fc.* FROM fc JOIN rk ON rk.init_ts = fc.init_ts AND rk.valid_ts = fc.valid_ts WHERE r <= 18 AND rk.valid_ts >= (SELECT lo FROM axis_span) AND rk.valid_ts < (SELECT hi FROM axis_span)), {_resize_cte('rs', 'us', 3, 5, 'half_pixel', 'init_ts, valid_ts')},
lw AS (SELECT valid_ts AS ts, x, y, arg_max_null(value, init_ts) AS value FROM rs GROUP BY 1, 2, 3), q AS (SELECT CAST(g // 5 AS INTEGER) AS x, CAST(g % 5 AS INTEGER) AS y FROM (SELECT unnest(generate_series(0, 24)) AS g))
SELECT ts, x, y, {s6('value')} AS value FROM lw UNION ALL SELECT a.ts, q.x, q.y, 0e0 FROM axis a CROSS JOIN q WHERE a.ts NOT IN (SELECT ts FROM lw)""")
def _(t: Tables):
    day = F.date_trunc("day", "hour").cast("timestamp_ntz")
    fc = _wide(t).groupBy(C.plus_hours(day, -12).alias("init_ts"), C.plus_hours("hour", 1).alias("valid_ts"), "x", "y", "lat", "lon").agg(F.avg("value").alias("value"))
    return rounded(gridded.forecast_series(fc, t.axis, (6, 6), 5, _WIDE_EXTENT), "value")


_VEG = f"{_SWATH}, vg AS (SELECT (SELECT lo FROM axis_span) + CAST(date_diff('day', (SELECT lo FROM axis_span), hour) // 5 * 5 AS INTEGER) * INTERVAL 1 DAY + INTERVAL 7 HOUR AS acq_ts, x, y, avg(value) * 0.0001e0 AS value FROM swath GROUP BY 1, 2, 3), {_resize_cte('rs', 'vg', 3, 5, 'half_pixel', 'acq_ts')}, sp AS (SELECT a.ts, coalesce((SELECT max(acq_ts) FROM rs WHERE acq_ts <= a.ts), (SELECT min(acq_ts) FROM rs)) AS acq_ts FROM axis a)"


def _veg(t: Tables):
    px = _swath(t).groupBy(acquisition(t).alias("acq_ts"), "x", "y").agg(F.avg("value").alias("value"))
    return gridded.vegetation_series(px, t.axis, (3, 3), 5)


@query("p10_vegetation_series", f"+ {_VEG} SELECT sp.ts, sp.acq_ts, x, y, {s6('value')} AS value FROM sp JOIN rs ON rs.acq_ts = sp.acq_ts")
def _(t: Tables):
    return rounded(_veg(t)[0].select("ts", "acq_ts", "x", "y", "value"), "value")


@query("p10_vegetation_validity", f"+ {_VEG} SELECT sp.ts, count(value) AS n_valid, count(value) > 0 AS is_valid FROM sp JOIN rs ON rs.acq_ts = sp.acq_ts GROUP BY sp.ts")
def _(t: Tables):
    return _veg(t)[1]


_CEIL = "CASE WHEN date_trunc('hour', {t}) = {t} THEN {t} ELSE date_trunc('hour', {t}) + INTERVAL 1 HOUR END"
_P11 = f"""{ELEV}, {XY}, nd AS (SELECT x, y, 34.5e0 - x * (1e0 / 7) AS nlat, -118.75e0 + y * ({SPAN} / 7) AS nlon FROM k),
rp AS (SELECT sensor_id, valid, value FROM (SELECT sensor_id, {_CEIL.format(t='r.ts')} AS valid, value, row_number() OVER (PARTITION BY sensor_id, {_CEIL.format(t='r.ts')} ORDER BY r.ts DESC) AS o FROM readings r) WHERE o = 1),
sl AS (SELECT s.sensor_id, a.ts FROM (SELECT DISTINCT sensor_id FROM rp) s CROSS JOIN axis a),
b AS (SELECT sl.*, r.valid AS bv, r.value AS bx FROM sl ASOF LEFT JOIN rp r ON r.sensor_id = sl.sensor_id AND r.valid <= sl.ts), f AS (SELECT sl.*, r.valid AS fv, r.value AS fx FROM sl ASOF LEFT JOIN rp r ON r.sensor_id = sl.sensor_id AND r.valid >= sl.ts),
nr AS (SELECT b.sensor_id, b.ts, CASE WHEN bv IS NULL OR (fv IS NOT NULL AND epoch_us(fv) - epoch_us(b.ts) <= epoch_us(b.ts) - epoch_us(bv)) THEN fx ELSE bx END AS value FROM b JOIN f ON f.sensor_id = b.sensor_id AND f.ts = b.ts),
att AS (SELECT nr.*, s.lat, s.lon, s.x, s.y FROM nr JOIN sensors s ON s.sensor_id = nr.sensor_id)"""
_P11_WIND = f"""st AS (SELECT a.ts, a.lat, a.lon, -(a.value / 10) * sin(radians(a.value * 7 % 360)) AS u, -(a.value / 10) * cos(radians(a.value * 7 % 360)) AS v, e.value AS zs FROM att a JOIN elev e ON e.x = 7 - CAST(greatest(0, least(trunc((lat - 33.5e0) / 1e0 * 7), 7)) AS INTEGER) AND e.y = CAST(greatest(0, least(trunc((lon - -118.75e0) / {SPAN} * 7), 7)) AS INTEGER)),
d AS (SELECT st.ts, nd.x, nd.y, u, v, sqrt(pow(nlon - lon, 2) + pow(nlat - lat, 2)) AS d, abs(e.value - zs) AS dz, max(abs(e.value - zs)) OVER (PARTITION BY st.ts, nd.x, nd.y) AS top FROM st CROSS JOIN nd JOIN elev e ON e.x = nd.x AND e.y = nd.y),
w AS (SELECT *, 1 / (pow(d + 0.1e0 * (dz / CASE WHEN top > 0 THEN top ELSE 1e0 END), 0.2e0) + 1e-6) AS w FROM d), wv AS (SELECT ts, x, y, sum(w * u) / sum(w) AS u, sum(w * v) / sum(w) AS v FROM w GROUP BY ts, x, y)"""
_P11_T = f"""{_J6.format(z='', j='').replace('d AS (', 'jd AS (', 1).replace('FROM d)', 'FROM jd)').replace('stations', 'sensors')}, nb AS (SELECT * FROM r WHERE rank <= 10),
un AS (SELECT *, dist / coalesce(nullif(sqrt(sum(dist * dist) OVER (PARTITION BY x, y)), 0e0), 1e0) AS ud FROM nb), nw AS (SELECT x, y, sx, sy, pow(CASE WHEN ud = 0 THEN 2.220446049250313e-16 ELSE ud END, -2) AS w FROM un),
tm AS (SELECT a.ts, nw.x, nw.y, coalesce(max(CASE WHEN a.x = nw.x AND a.y = nw.y THEN a.value END), sum(w * a.value) / sum(w)) AS value FROM att a JOIN nw ON nw.sx = a.x AND nw.sy = a.y GROUP BY a.ts, nw.x, nw.y)"""


@query("p11_weather_series", f"+ {_P11}, {_P11_WIND}, {_P11_T} SELECT 'wind_u' AS channel, ts, x, y, {s6('u')} AS value FROM wv UNION ALL SELECT 'wind_v', ts, x, y, {s6('v')} FROM wv UNION ALL SELECT 'temperature', ts, x, y, {s6('value')} FROM tm")
def _(t: Tables):
    v = F.col("value")
    rep = t.locate(t.readings.select("sensor_id", F.col("ts").alias("valid"), "value"), F.col("sensor_id")).select(
        F.col("sensor_id").alias("station"), "valid", "lat", "lon", (v / 10).alias("sped"), (v * 7 % 360).alias("drct"), v.alias("temperature"))
    slots = rep.select("station").distinct().withColumn("ts", T.each_hour(t.start, t.end))
    out = gridded.weather_series(rep, slots, elevation(t), EXTENT, DIM, {"temperature": False})
    return rounded(out.select("channel", "ts", "x", "y", "value"), "value")


_LST = f"{_SWATH}, px AS (SELECT CAST(hour AS DATE) AS day, x, y, avg(CASE WHEN day(hour) % 6 <> 2 THEN value END) AS raw FROM swath GROUP BY 1, 2, 3), cn AS (SELECT d.day, CAST(g // 3 AS INTEGER) AS x, CAST(g % 3 AS INTEGER) AS y, coalesce(least(greatest((raw * 0.5e0 + 249e0 - 270e0) / 60e0, 0e0), 1e0), 0e0) AS value FROM (SELECT DISTINCT day FROM px) d CROSS JOIN (SELECT unnest(generate_series(0, 8)) AS g) LEFT JOIN px ON px.day = d.day AND px.x = g // 3 AND px.y = g % 3)"


def _gauss_pair(n: int, sigma: float) -> str:
    import math
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    taps = ", ".join(f"({k - r}, CAST('{v / sum(raw)!r}' AS DOUBLE))" for k, v in enumerate(raw))
    j = f"((o + d) % {2 * n} + {2 * n}) % {2 * n}"
    return f"taps(d, w) AS (VALUES {taps}), gl AS (SELECT o, i, sum(w) AS w FROM (SELECT o, CASE WHEN {j} < {n} THEN {j} ELSE {2 * n - 1} - {j} END AS i, w FROM (SELECT CAST(unnest(generate_series(0, {n - 1})) AS INTEGER) AS o), taps) GROUP BY o, i)"


@query("p12_surface_temperature_series", f"""+rec {_LST}, {_resize_cte('rs', 'cn', 3, 4, 'corner', 'day')}, {_gauss_pair(4, 1.0)}, gs AS (SELECT h.day, r.o AS x, c.o AS y, sum(h.value * r.w * c.w) AS value FROM rs h JOIN gl r ON r.i = h.x JOIN gl c ON c.i = h.y GROUP BY h.day, r.o, c.o),
q AS (SELECT CAST(g // 4 AS INTEGER) AS x, CAST(g % 4 AS INTEGER) AS y FROM (SELECT unnest(generate_series(0, 15)) AS g)), hh AS (SELECT a.ts, q.x, q.y, coalesce(gs.value, 0e0) AS value FROM axis a CROSS JOIN q LEFT JOIN gs ON gs.day = CAST(a.ts AS DATE) AND gs.x = q.x AND gs.y = q.y),
{_smooth_cte('hh', 0.3, 0.9, 'max(value)')} SELECT ts, x, y, {s6('value')} AS value FROM sm""")
def _(t: Tables):
    px = _swath(t).groupBy(F.to_date("hour").alias("day"), "x", "y").agg(F.avg(F.when(F.dayofmonth("hour") % 6 != 2, F.col("value"))).alias("value"))
    px = G.each_cell(px.select("day").distinct(), 3).join(px, ["day", "x", "y"], "left")
    px = px.withColumn("scale", F.lit(0.5)).withColumn("offset", F.lit(249.0)).withColumn("fill", F.lit(-1.0))
    return rounded(gridded.surface_temperature_series(px, t.axis, (3, 3), 4), "value").select("ts", "x", "y", "value")


@query("p13_aerosol_series", f"""+ {_SWATH}, bn AS (SELECT CAST(hour AS DATE) AS day, event_id % 2 AS band, x, y, max(value) * 0.02e0 + -0.5e0 AS value FROM swath GROUP BY 1, 2, 3, 4), mb AS (SELECT day, x, y, avg(value) AS v FROM bn GROUP BY 1, 2, 3),
rg AS (SELECT day, x, y, CASE WHEN v < -0.1e0 OR v > 5 THEN NULL WHEN v < 0 THEN 0e0 ELSE v END AS value FROM mb), {_resize_cte('rs', 'rg', 3, 4, 'corner', 'day')} SELECT a.ts, rs.day, x, y, {s6('value')} AS value FROM axis a JOIN rs ON rs.day = CAST(a.ts AS DATE)""")
def _(t: Tables):
    px = _swath(t).groupBy(F.to_date("hour").alias("day"), (F.col("event_id") % 2).alias("band"), "x", "y").agg(F.max("value").alias("value"))
    px = px.withColumn("scale", F.lit(0.02)).withColumn("offset", F.lit(-0.5)).withColumn("fill", F.lit(-1.0))
    return rounded(gridded.aerosol_series(px, t.axis, (3, 3), 4).select("ts", "day", "x", "y", "value"), "value")


_RE = f"""{_SWATH}, r0 AS (SELECT date_trunc('day', hour) + (hour(hour) // 3 * 3) * INTERVAL 1 HOUR + INTERVAL 90 MINUTE AS src_ts, x, y, avg(value) AS value FROM swath GROUP BY 1, 2, 3),
q3 AS (SELECT CAST(g // 3 AS INTEGER) AS x, CAST(g % 3 AS INTEGER) AS y FROM (SELECT unnest(generate_series(0, 8)) AS g)), na AS (SELECT f.src_ts, q3.x, q3.y, coalesce(r0.value, 0e0) AS value FROM (SELECT DISTINCT src_ts FROM r0) f CROSS JOIN q3 LEFT JOIN r0 ON r0.src_ts = f.src_ts AND r0.x = q3.x AND r0.y = q3.y),
pk AS (SELECT a.ts, arg_min(n.src_ts, (abs(epoch_us(n.src_ts) - epoch_us(a.ts)), n.src_ts)) AS src_ts FROM axis a CROSS JOIN (SELECT DISTINCT src_ts FROM na) n GROUP BY a.ts)"""


def _reanalysis(t: Tables):
    at = F.timestamp_add("MINUTE", (F.floor(F.hour("hour") / 3) * 180 + 90).cast("int"), F.date_trunc("day", "hour").cast("timestamp_ntz"))
    r0 = _swath(t).groupBy(at.alias("src_ts"), "x", "y").agg(F.avg("value").alias("value"))
    slots = G.each_cell(r0.select("src_ts").distinct(), 3)
    native = slots.join(r0, ["src_ts", "x", "y"], "left").select(F.lit("height").alias("channel"), "src_ts", "x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))
    return gridded.reanalysis_series(native, t.axis, (3, 3), 4)


@query("p14_reanalysis_native", f"+rec {_RE}, {_resize_cte('rs', 'na', 3, 4, 'corner', 'src_ts')}, hr AS (SELECT pk.ts, x, y, value FROM pk JOIN rs ON rs.src_ts = pk.src_ts), hh AS (SELECT pk.ts, x, y, value FROM pk JOIN na ON na.src_ts = pk.src_ts), {_smooth_cte('hh', 0.2, 1.0, 'sum(abs(value))', 'hr')} SELECT ts, x, y, {s6('value')} AS value FROM sm")
def _(t: Tables):
    return rounded(_reanalysis(t)["native"], "value").select("ts", "x", "y", "value")


@query("p14_reanalysis_resized", f"+rec {_RE}, {_resize_cte('rs', 'na', 3, 4, 'corner', 'src_ts')}, hh AS (SELECT pk.ts, x, y, value FROM pk JOIN rs ON rs.src_ts = pk.src_ts), {_smooth_cte('hh', 0.2, 1.0, 'sum(abs(value))')} SELECT ts, x, y, {s6('value')} AS value FROM sm")
def _(t: Tables):
    return rounded(_reanalysis(t)["resized"], "value").select("ts", "x", "y", "value")


@query("p14_reanalysis_extent", f"""+rec {_WIDE}, r0 AS (SELECT date_trunc('day', hour) + INTERVAL 90 MINUTE AS src_ts, x, y, avg(value) AS value FROM swath GROUP BY 1, 2, 3),
q3 AS (SELECT CAST(g // 3 AS INTEGER) AS x, CAST(g % 3 AS INTEGER) AS y FROM (SELECT unnest(generate_series(0, 8)) AS g)), na AS (SELECT f.src_ts, q3.x, q3.y, coalesce(r0.value, 0e0) AS value FROM (SELECT DISTINCT date_trunc('day', hour) + INTERVAL 90 MINUTE AS src_ts FROM wide) f CROSS JOIN q3 LEFT JOIN r0 ON r0.src_ts = f.src_ts AND r0.x = q3.x AND r0.y = q3.y),
pk AS (SELECT a.ts, arg_min(n.src_ts, (abs(epoch_us(n.src_ts) - epoch_us(a.ts)), n.src_ts)) AS src_ts FROM axis a CROSS JOIN (SELECT DISTINCT src_ts FROM na) n GROUP BY a.ts), {_resize_cte('rs', 'na', 3, 4, 'corner', 'src_ts')}, hh AS (SELECT pk.ts, x, y, value FROM pk JOIN rs ON rs.src_ts = pk.src_ts), {_smooth_cte('hh', 0.2, 1.0, 'sum(abs(value))')} SELECT ts, x, y, {s6('value')} AS value FROM sm""")
def _(t: Tables):
    at = F.timestamp_add("MINUTE", F.lit(90), F.date_trunc("day", "hour").cast("timestamp_ntz"))
    r0 = _wide(t).groupBy(at.alias("src_ts"), "x", "y").agg(F.avg("value").alias("value"))
    slots = G.each_cell(r0.select("src_ts").distinct(), 6)
    native = slots.join(r0, ["src_ts", "x", "y"], "left").select(F.lit("height").alias("channel"), "src_ts", "x", "y", F.coalesce("value", F.lit(0.0)).alias("value"),
                                                               (F.lit(34.3) - F.col("x") * F.lit(0.2)).alias("lat"), (F.lit(-118.2) + F.col("y") * F.lit(0.17)).alias("lon"))
    return rounded(gridded.reanalysis_series(native, t.axis, (6, 6), 4, _WIDE_EXTENT)["resized"], "value").select("ts", "x", "y", "value")


_POL = "po AS (SELECT CAST(hour AS DATE) AS day, event_id AS pixel, 33.4e0 + (event_id * 37 % 101) / 101e0 * 1.2e0 AS lat, -118.9e0 + (event_id * 53 % 103) / 103e0 * 2e0 AS lon, CASE WHEN day(hour) % 9 = 6 THEN 0e0 ELSE value END AS value FROM readings WHERE (event_id % 20) / 20e0 > CASE WHEN day(hour) % 8 IN (1, 4, 5) THEN 1e0 ELSE 0.75e0 END)"


@query("p15_polar_series", f"""+ {XY}, {_POL}, c AS (SELECT day, pixel, value, {_NODE_COLS} FROM po WHERE day IN (SELECT day FROM po GROUP BY day HAVING count(*) > 3)), g AS (SELECT c.day, k.x, k.y, arg_min(value, (round(pow(fx - k.x, 2) + pow(fy - k.y, 2), 12), pixel)) AS value FROM c CROSS JOIN k GROUP BY c.day, k.x, k.y),
dy AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM axis), hv AS (SELECT day FROM g GROUP BY day HAVING sum(abs(value)) > 0), dm AS (SELECT d.day, last_value(h.day IGNORE NULLS) OVER (ORDER BY d.day) AS b, first_value(h.day IGNORE NULLS) OVER (ORDER BY d.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM dy d LEFT JOIN hv h ON h.day = d.day),
fl AS (SELECT dm.day, k.x, k.y, CASE WHEN dm.b = dm.day THEN p.value ELSE coalesce(n.value + (p.value - n.value) / pow(2e0, date_diff('day', dm.b, dm.day)), p.value, n.value, 0e0) END AS value FROM dm CROSS JOIN k LEFT JOIN g p ON p.day = dm.b AND p.x = k.x AND p.y = k.y LEFT JOIN g n ON n.day = dm.a AND n.x = k.x AND n.y = k.y)
SELECT a.ts, fl.day, x, y, {s6('value')} AS value FROM axis a JOIN fl ON fl.day = CAST(a.ts AS DATE)""")
def _(t: Tables):
    k, d = F.col("event_id"), F.dayofmonth("hour")
    share = F.when((d % 8).isin(1, 4, 5), F.lit(0.0)).otherwise((k % 20) / F.lit(20.0))      # no point of these days is good enough
    px = t.readings.select(
        F.to_date("hour").alias("day"), k.alias("pixel"), (F.lit(33.4) + (k * 37 % 101) / F.lit(101.0) * F.lit(1.2)).alias("lat"),
        (F.lit(-118.9) + (k * 53 % 103) / F.lit(103.0) * F.lit(2.0)).alias("lon"), F.when(d % 9 == 6, F.lit(0.0)).otherwise(F.col("value")).alias("value"), share.alias("qa"))
    return rounded(gridded.polar_series(px, t.axis, EXTENT, DIM).select("ts", "day", "x", "y", "value"), "value")


# ------------------------------------------------------------------ learning
_PI2 = "6.283185307179586e0"
_P16 = f"""{_DENSE}, cl AS (SELECT ts, x, y, coalesce(avg(value) OVER (PARTITION BY x, y, hour(ts) ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), value) AS value FROM dense WHERE channel = 'view'),
pl AS (SELECT DISTINCT x, y FROM dense WHERE channel = 'view'), el AS (SELECT x, y, (x * 4 + y - min(x * 4 + y) OVER ()) / (max(x * 4 + y) OVER () - min(x * 4 + y) OVER () + 1e-8) AS value FROM pl),
v0 AS (SELECT x, y, value FROM dense WHERE channel = 'click' AND ts = (SELECT lo FROM axis_span)), vb AS (SELECT min(value) AS lo, max(value) AS hi FROM v0), ve AS (SELECT x, y, CASE WHEN lo >= -1 AND hi <= 1 THEN (value + 1) / 2 ELSE (value - lo) / (hi - lo + 1e-8) END AS value FROM v0, vb),
wv AS (SELECT channel, ts, x, y, value FROM dense UNION ALL SELECT 'climatology', ts, x, y, value FROM cl UNION ALL SELECT 'elevation', a.ts, x, y, value FROM axis a, el UNION ALL SELECT 'vegetation', a.ts, x, y, value FROM axis a, ve UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{f}_{w}', ts, x, y, {w}({f}(ts) * {_PI2} / {C.CYCLE_MAX[f]}) FROM dense WHERE channel = 'view'" for f in ("month", "hour") for w in ("sin", "cos")) + """),
cuts AS (SELECT CAST(trunc(date_diff('hour', lo, hi) * 0.7e0) AS BIGINT) AS c1, CAST(trunc(date_diff('hour', lo, hi) * 0.85e0) AS BIGINT) AS c2 FROM axis_span),
sp AS (SELECT *, CASE WHEN i < c1 THEN 'train' WHEN i < c2 THEN 'valid' ELSE 'test' END AS split FROM cuts, (SELECT *, date_diff('hour', (SELECT lo FROM axis_span), ts) AS i FROM wv)),
sc AS (SELECT channel, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1e0 ELSE stddev_pop(value) END AS s FROM sp WHERE split = 'train' AND channel NOT LIKE '%_sin' AND channel NOT LIKE '%_cos' AND channel NOT IN ('elevation', 'vegetation') GROUP BY channel),
xs AS (SELECT sp.split, sp.channel, i - CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN c1 ELSE c2 END AS i, x, y, value AS raw, CASE WHEN m IS NULL THEN value ELSE (value - m) / s END AS value FROM sp LEFT JOIN sc ON sc.channel = CASE WHEN sp.channel = 'signup' THEN 'view' ELSE sp.channel END),
ln AS (SELECT split, max(i) + 1 AS n FROM xs GROUP BY split), st AS (SELECT DISTINCT xs.split, i FROM xs JOIN ln ON ln.split = xs.split WHERE i % 12 = 0 AND i <= n - 36)"""


def _training(t: Tables):
    dense = _dense(t)
    place = dense.where("channel = 'view'").select("x", "y").distinct().withColumn("value", (F.col("x") * 4 + F.col("y")).cast("double"))
    layers = {"elevation": S.min_max(place), "vegetation": S.vegetation_layer(dense.where("channel = 'click'")).select("x", "y", "value")}
    return learning.training_set(dense, "view", t.start, t.n_hours, 4, 24, 12, 12, {"signup": "view"}, static=layers)


_mean = lambda c: F.aggregate(F.flatten(c), F.lit(0.0), lambda a, v: a + v) / F.size(F.flatten(c))


@query("p16_training_inputs", f"+ {_P16} SELECT st.split, xs.channel, CAST(st.i // 12 AS BIGINT) AS sample_id, count(*) AS n, {s6('avg(xs.value)')} AS mean FROM st JOIN xs ON xs.split = st.split AND xs.i BETWEEN st.i + CASE WHEN xs.channel = 'signup' THEN 24 ELSE 0 END AND st.i + CASE WHEN xs.channel = 'signup' THEN 35 ELSE 23 END GROUP BY 1, 2, 3")
def _(t: Tables):
    x = _training(t)[0]
    return x.select("split", "channel", "sample_id", F.size(F.flatten("frames")).alias("n"), r6(_mean("frames"), "mean"))


@query("p16_training_targets", f"+ {_P16} SELECT st.split, CAST(st.i // 12 AS BIGINT) AS sample_id, count(*) AS n, {s6('avg(xs.raw)')} AS mean FROM st JOIN xs ON xs.split = st.split AND xs.channel = 'view' AND xs.i BETWEEN st.i + 24 AND st.i + 35 GROUP BY 1, 2")
def _(t: Tables):
    y = _training(t)[1]
    return y.select("split", "sample_id", F.size(F.flatten("y_frames")).alias("n"), r6(_mean("y_frames"), "mean"))


# One channel ends five days early and cuts all; another ends earlier still, but stands in no row of the table.
_CHANNEL_TABLE = [("view", "Views", True, False), ("climatology", "Views_Climatology", True, False), ("error", "Errors", True, False),
                  ("signup", "Signups", False, False), ("elevation", "Elevation", False, False), ("vegetation", "Vegetation", False, False),
                  ("month_cos", "Month_Cos", False, False), ("hour_sin", "Hour_Sin", False, False), ("absent", "Absent", True, False),
                  ("error", "Errors_Forecast", True, True), ("hour_sin", "Hour_Sin_Forecast", False, True)]
_P16_TABLE = f"""{_DENSE}, dn AS (SELECT channel, ts, CAST((x * 4 + y) // 5 AS INTEGER) AS x, CAST((x * 4 + y) % 5 AS INTEGER) AS y, value, date_diff('hour', lo, ts) AS i FROM dense, axis_span WHERE NOT (channel = 'error' AND ts >= hi - INTERVAL 5 DAY) AND NOT (channel = 'click' AND ts >= hi - INTERVAL 9 DAY)),
mf(position, channel, name, scale, forecast) AS (VALUES {", ".join(f"({i}, '{c}', '{n}', {str(s).lower()}, {str(f).lower()})" for i, (c, n, s, f) in enumerate(_CHANNEL_TABLE))}),
nn AS (SELECT min(m) AS n FROM (SELECT max(i) + 1 AS m FROM dn WHERE channel IN (SELECT channel FROM mf) GROUP BY channel)), al AS (SELECT channel, ts, i, x, y, value FROM dn, nn WHERE i < n),
pl AS (SELECT DISTINCT x, y, x * 5 + y AS value FROM dn), el AS (SELECT x, y, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER () + 1e-8) AS value FROM pl),
v0 AS (SELECT x, y, value FROM dn WHERE channel = 'click' AND i = 0), vb AS (SELECT min(value) AS lo, max(value) AS hi FROM v0), ve AS (SELECT x, y, CASE WHEN lo >= -1 AND hi <= 1 THEN (value + 1) / 2 ELSE (value - lo) / (hi - lo + 1e-8) END AS value FROM v0, vb),
wv AS (SELECT channel, i, x, y, value FROM al UNION ALL SELECT 'climatology', i, x, y, coalesce(avg(value) OVER (PARTITION BY x, y, hour(ts) ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), value) FROM al WHERE channel = 'view'
 UNION ALL SELECT 'elevation', i, el.x, el.y, el.value FROM al JOIN el USING (x, y) WHERE channel = 'view' UNION ALL SELECT 'vegetation', i, ve.x, ve.y, ve.value FROM al JOIN ve USING (x, y) WHERE channel = 'view'
 UNION ALL SELECT 'month_cos', i, x, y, cos(month(ts) * {_PI2} / {C.CYCLE_MAX["month"]}) FROM al WHERE channel = 'view' UNION ALL SELECT 'hour_sin', i, x, y, sin(hour(ts) * {_PI2} / {C.CYCLE_MAX["hour"]}) FROM al WHERE channel = 'view'),
cuts AS (SELECT n, CAST(trunc(n * 0.7e0) AS BIGINT) AS c1, CAST(trunc(n * 0.85e0) AS BIGINT) AS c2 FROM nn),
sp AS (SELECT channel, x, y, value, split, i - base AS i, size FROM (SELECT wv.*, unnest(CASE WHEN i < c1 THEN [{{'split': 'train', 'base': 0, 'size': c1}}] WHEN i < c2 THEN [{{'split': 'valid', 'base': c1, 'size': c2 - c1}}] ELSE [{{'split': 'test', 'base': c2, 'size': n - c2}}] END, recursive := true) FROM wv, cuts)),
sc AS (SELECT channel, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1e0 ELSE stddev_pop(value) END AS s FROM sp WHERE split = 'train' GROUP BY channel),
st AS (SELECT DISTINCT split, i AS i0 FROM sp WHERE i % 24 = 0 AND i <= size - 36)"""


def _by_table(t: Tables):
    dense = _dense(t).withColumn("_c", F.col("x") * 4 + F.col("y"))
    dense = dense.select("channel", "ts", F.expr("CAST(_c div 5 AS INT)").alias("x"), (F.col("_c") % 5).alias("y"), "value")
    early = lambda channel, days: (F.col("channel") == channel) & (F.col("ts") >= C.ntz(t.end) - F.expr(f"INTERVAL {days} DAY"))
    short = dense.where(~early("error", 5) & ~early("click", 9))
    place = dense.select("x", "y").distinct().withColumn("value", (F.col("x") * 5 + F.col("y")).cast("double"))
    layers = {"elevation": S.min_max(place), "vegetation": S.vegetation_layer(short.where("channel = 'click'")).select("x", "y", "value")}
    table = t.spark.createDataFrame([(i, *row) for i, row in enumerate(_CHANNEL_TABLE)], "position int, channel string, name string, scale boolean, forecast boolean")
    return learning.manifest_training_set(short, table, "view", t.start, (2, 5), 24, 12, 24, static=layers)


@query("p16_manifest_inputs", f"+ {_P16_TABLE} SELECT sp.split, mf.name, CAST(i0 // 24 AS BIGINT) AS sample_id, CAST(sp.i - i0 - CASE WHEN mf.forecast THEN 24 ELSE 0 END AS INTEGER) AS frame_idx, CAST(x * 5 + y AS INTEGER) AS cell, {s6('CASE WHEN mf.scale THEN (value - m) / s ELSE value END')} AS value FROM sp JOIN mf ON mf.channel = sp.channel JOIN sc ON sc.channel = sp.channel JOIN st ON st.split = sp.split AND sp.i BETWEEN i0 + CASE WHEN mf.forecast THEN 24 ELSE 0 END AND i0 + CASE WHEN mf.forecast THEN 35 ELSE 23 END")
def _(t: Tables):
    return rounded(S.explode_frames(_by_table(t)[0], "frames", ["split", "name"]), "value").select("split", "name", "sample_id", "frame_idx", "cell", "value")


@query("p16_manifest_targets", f"+ {_P16_TABLE} SELECT sp.split, CAST(i0 // 24 AS BIGINT) AS sample_id, CAST(sp.i - i0 - 24 AS INTEGER) AS frame_idx, CAST(x * 5 + y AS INTEGER) AS cell, {s6('value')} AS value FROM sp JOIN st ON st.split = sp.split AND sp.i BETWEEN i0 + 24 AND i0 + 35 WHERE channel = 'view'")
def _(t: Tables):
    return rounded(S.explode_frames(_by_table(t)[1], "y_frames", ["split"]), "value").select("split", "sample_id", "frame_idx", "cell", "value")


def _event_tile(channel: str, value: str) -> str:
    """Yearly sample tiles whose windows of 20 hours touch the active window of the first day."""
    return f"""act AS (SELECT date_diff('hour', (SELECT lo FROM axis_span), min(ts)) AS a, date_diff('hour', (SELECT lo FROM axis_span), max(ts)) AS b FROM frame WHERE ts < TIMESTAMP '2024-01-02' AND value > 0),
tile AS (SELECT sample_id, channel, x, y, avg(value) AS value FROM (SELECT CAST(year(l_shipdate) - 1995 AS INTEGER) AS sample_id, {channel} AS channel, CAST(l_suppkey % {N} AS INTEGER) AS x, CAST(l_partkey % {N} AS INTEGER) AS y, {value} AS value FROM lineitem), act
 WHERE sample_id >= greatest(0, a - 20) AND sample_id <= least(6, b - 20 + 1) GROUP BY sample_id, channel, x, y)"""


_INPUT_TILE = _event_tile("CASE l_linenumber WHEN 1 THEN 'u' WHEN 2 THEN 'v' ELSE 'pm' END", "l_extendedprice / 1000 - CASE WHEN l_linenumber < 3 THEN 50 ELSE 0 END")
_TARGET_TILE = _event_tile("'target'", "l_quantity")


@query("p17_event_augmentation", _union_sql(_INPUT_TILE))
def _(t: Tables):
    rows = _tile(t).withColumn("sample_id", F.col("sample_id") - 1995)
    return rounded(learning.event_augmentation(rows, t.frame, (t.start, "2024-01-02"), t.start, 20, 7, N, WIND), "value")


@query("p17_event_targets", _union_sql(_TARGET_TILE, ("target",)))
def _(t: Tables):
    rows = t.raw("lineitem").groupBy(
        (F.year("l_shipdate") - 1995).cast("int").alias("sample_id"), F.lit("target").alias("channel"), (F.col("l_suppkey") % N).cast("int").alias("x"),
        (F.col("l_partkey") % N).cast("int").alias("y")).agg(F.avg("l_quantity").alias("value"))
    return rounded(learning.event_augmentation(rows, t.frame, (t.start, "2024-01-02"), t.start, 20, 7, N), "value")


@query("p18_forecast_report", f"""+ {_CELL} SELECT 'by_hour' AS section, NULL AS sensor_id, horizon, {s6(_PARTS['rmse'])} AS rmse FROM {F_TP} GROUP BY horizon UNION ALL SELECT 'stations', CAST(sensor_id AS VARCHAR), NULL, {s6(_PARTS['rmse'])} FROM {F_TP} GROUP BY sensor_id
UNION ALL SELECT 'matrix', CAST(sensor_id AS VARCHAR), NULL, {s6('avg(r)')} FROM c GROUP BY sensor_id UNION ALL SELECT 'matrix', 'all', NULL, {s6('avg(r)')} FROM c UNION ALL SELECT 'table', CAST(sensor_id AS VARCHAR), horizon, {s6('r')} FROM c UNION ALL (SELECT 'worst_pairs', CAST(sensor_id AS VARCHAR), horizon, {s6('r')} FROM c ORDER BY r DESC, sensor_id, horizon LIMIT 5)""")
def _(t: Tables):
    r = learning.forecast_report(t.forecasts, (1, 2, 3, 4))
    none_s, none_h = F.lit(None).cast("string").alias("sensor_id"), F.lit(None).cast("int").alias("horizon")
    sensor = F.col("sensor_id").cast("string").alias("sensor_id")
    parts = [r["by_hour"].select(F.lit("by_hour").alias("section"), none_s, "horizon", "rmse"),
             r["stations"].select(F.lit("stations").alias("section"), sensor, none_h, "rmse"),
             r["matrix"].select(F.lit("matrix").alias("section"), "sensor_id", none_h, F.col("mean_rmse").alias("rmse")),
             r["table"].select(F.lit("table").alias("section"), sensor, "horizon", "rmse"),
             r["worst_pairs"].select(F.lit("worst_pairs").alias("section"), sensor, "horizon", "rmse")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, "rmse")
