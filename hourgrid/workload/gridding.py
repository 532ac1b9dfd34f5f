"""G1-G30, J6."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hourgrid.functions import columns as C
from hourgrid.operators import gridding as G
from hourgrid.operators import interpolate as I
from hourgrid.operators import raster as R
from hourgrid.workload.base import DIM, EXTENT, Tables, locate_sql, query, r6, rounded, s6

SPAN = repr(EXTENT[1] - EXTENT[0]) + "e0"
XY = "k AS (SELECT CAST(g // 8 AS INTEGER) AS x, CAST(g % 8 AS INTEGER) AS y FROM (SELECT unnest(generate_series(0, 63)) AS g))"
LAYER = "layer AS (SELECT CAST(p_partkey % 8 AS INTEGER) AS x, CAST(p_partkey // 8 % 8 AS INTEGER) AS y, avg(p_size) AS value FROM part GROUP BY 1, 2)"
ELEV = LAYER + ", elev AS (SELECT x, y, (value - lo) / nullif(hi - lo, 0e0) * 50 AS value FROM layer, (SELECT min(value) AS lo, max(value) AS hi FROM layer))"


def layer(t: Tables):
    k = F.col("p_partkey")
    return t.raw("part").groupBy((k % 8).cast("int").alias("x"), (F.floor(k / 8) % 8).cast("int").alias("y")).agg(F.avg("p_size").alias("value"))


def elevation(t: Tables):
    return G.scale_elevation(layer(t), 50.0)


@query("g1_cell_of_position", "SELECT sensor_id, x, y FROM stations")
def _(t: Tables):
    return t.stations.select("sensor_id", "x", "y")


@query("g1b_cell_western", f"SELECT sensor_id, CAST(greatest(0, least(trunc((34.5e0 - lat) / 1e0 * 8), 7)) AS INTEGER) AS x, CAST(greatest(0, least(8 - trunc((-117.05e0 + abs(lon)) / {SPAN} * 8), 7)) AS INTEGER) AS y FROM stations")
def _(t: Tables):
    x, y = C.cell_of(EXTENT, DIM, mode="west")
    return t.stations.drop("x", "y").select("sensor_id", x.alias("x"), y.alias("y"))


@query("g1c_cell_of_nodes", f"SELECT sensor_id, CAST(greatest(0, least(trunc((lat - 33.5e0) / 1e0 * 7), 7)) AS INTEGER) AS x, CAST(greatest(0, least(trunc((lon - -118.75e0) / {SPAN} * 7), 7)) AS INTEGER) AS y FROM stations")
def _(t: Tables):
    x, y = C.cell_of(EXTENT, DIM, mode="nodes")
    return t.stations.drop("x", "y").select("sensor_id", x.alias("x"), y.alias("y"))


@query("g2_corner_of_cell", f"SELECT DISTINCT x, y, {s6('34.5e0 - x * (1e0 / 8)')} AS lat, {s6(f'-118.75e0 + y * ({SPAN} / 8)')} AS lon FROM stations")
def _(t: Tables):
    lat, lon = C.corner_of(EXTENT, DIM)
    return t.stations.select("x", "y").distinct().select("x", "y", r6(lat, "lat"), r6(lon, "lon"))


_VALS = "rd AS (SELECT hour AS ts, user_id, event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value - 5 END AS value, " + locate_sql("user_id") + " FROM readings)"


def _vals(t: Tables):
    rows = t.readings.select(F.col("hour").alias("ts"), "user_id", "event_id",
                             F.when(F.col("event_id") % 17 != 0, F.col("value") - 5).alias("value"))
    return t.locate(rows, F.col("user_id"))


@query("g3_plot_last_reading", f"+ {_VALS} SELECT ts, x, y, arg_max(value, event_id) AS value FROM rd WHERE value >= 0 GROUP BY ts, x, y")
def _(t: Tables):
    return G.plot_last(_vals(t), ["event_id"])


@query("g4_same_cell_mean", f"+ {_VALS} SELECT ts, x, y, {s6('avg(value)')} AS value FROM rd GROUP BY ts, x, y")
def _(t: Tables):
    return rounded(G.merge_mean(_vals(t)), "value")


@query("g5_plot_on_zero", f"+ {_VALS}, {XY}, w AS (SELECT ts, x, y, arg_max(greatest(coalesce(value, 0e0), 0e0), event_id) AS v, arg_max(coalesce(value, 0e0), event_id) AS s FROM rd GROUP BY ts, x, y) SELECT f.ts, k.x, k.y, coalesce(v, 0e0) AS value, coalesce(s, 0e0) AS signed FROM (SELECT DISTINCT ts FROM rd) f CROSS JOIN k LEFT JOIN w ON w.ts = f.ts AND w.x = k.x AND w.y = k.y")
def _(t: Tables):
    rows = _vals(t)
    signed = G.plot_on_zero(rows, DIM, ["event_id"], allow_negative=True).withColumnRenamed("value", "signed")
    return G.plot_on_zero(rows, DIM, ["event_id"]).join(signed, ["ts", "x", "y"])


def _idw_sql(elev: bool, k: int = 10) -> str:
    z = "+ pow(ze.value - zp.value, 2)" if elev else ""
    join = "JOIN elev ze ON ze.x = k.x AND ze.y = k.y JOIN elev zp ON zp.x = f.x AND zp.y = f.y" if elev else ""
    return f"""+ {ELEV + ', ' if elev else ''}{XY}, d AS (SELECT f.ts, k.x, k.y, f.value AS v, f.x AS px, f.y AS py, sqrt(pow(k.x - f.x, 2) + pow(k.y - f.y, 2) {z}) AS d FROM frame f CROSS JOIN k {join}),
n AS (SELECT *, row_number() OVER (PARTITION BY ts, x, y ORDER BY d, px, py) AS r FROM d)
SELECT ts, x, y, {s6('coalesce(max(CASE WHEN px = x AND py = y THEN v END), sum(v / pow(nullif(d, 0e0), 2)) / sum(1 / pow(nullif(d, 0e0), 2)))')} AS value FROM n WHERE r <= {k} OR (px = x AND py = y) GROUP BY ts, x, y"""


@query("g6_idw", _idw_sql(False, 5))
def _(t: Tables):
    return rounded(I.idw(t.frame, DIM, neighbours=5), "value")


@query("g6_idw_elevation", _idw_sql(True, 5))
def _(t: Tables):
    return rounded(I.idw(t.frame, DIM, neighbours=5, elevation=elevation(t)), "value")


_J6 = "d AS (SELECT k.x, k.y, s.x AS sx, s.y AS sy, sqrt(pow(k.x - s.x, 2) + pow(k.y - s.y, 2){z}) AS dist FROM (SELECT DISTINCT x, y FROM stations) s CROSS JOIN k {j}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY x, y ORDER BY dist, sx, sy) AS INTEGER) AS rank FROM d)"


@query("j6_nearest_sensors", f"+ {XY}, {_J6.format(z='', j='')} SELECT x, y, rank, sx, sy, {s6('dist')} AS dist FROM r WHERE rank <= 4")
def _(t: Tables):
    return rounded(I.nearest_sensors(t.stations, DIM, 4), "dist")


@query("j6_nearest_sensors_elevation", f"+ {ELEV}, {XY}, " + _J6.format(z=" + pow(ze.value - zs.value, 2)", j="JOIN elev ze ON ze.x = k.x AND ze.y = k.y JOIN elev zs ON zs.x = s.x AND zs.y = s.y") + f" SELECT x, y, rank, sx, sy, {s6('dist')} AS dist FROM r WHERE rank <= 4")
def _(t: Tables):
    return rounded(I.nearest_sensors(t.stations, DIM, 4, elevation(t)), "dist")


@query("g7_elevation_scaling", f"+ {ELEV} SELECT x, y, {s6('value')} AS value FROM elev")
def _(t: Tables):
    return rounded(elevation(t), "value")


@query("g8_idw_fixed_neighbours", f"""+ {ELEV}, {XY}, {_J6.format(z='', j='')}, nb AS (SELECT r.*, ze.value - zs.value AS dz FROM r JOIN elev ze ON ze.x = r.x AND ze.y = r.y JOIN elev zs ON zs.x = r.sx AND zs.y = r.sy WHERE rank <= 6),
u AS (SELECT *, dist / coalesce(nullif(sqrt(sum(dist * dist) OVER (PARTITION BY x, y)), 0e0), 1e0) AS ud, dz / coalesce(nullif(sqrt(sum(dz * dz) OVER (PARTITION BY x, y)), 0e0), 1e0) AS uz FROM nb),
w AS (SELECT x, y, sx, sy, pow(CASE WHEN ud + uz * uz = 0 THEN 2.220446049250313e-16 ELSE ud + uz * uz END, -2) AS w FROM u)
SELECT f.ts, w.x, w.y, {s6('coalesce(max(CASE WHEN f.x = w.x AND f.y = w.y THEN f.value END), sum(w * f.value) / sum(w))')} AS value FROM frame f JOIN w ON w.sx = f.x AND w.sy = f.y GROUP BY f.ts, w.x, w.y""")
def _(t: Tables):
    return rounded(I.idw_fixed_neighbours(t.frame, t.stations, DIM, neighbours=6, elevation=elevation(t)), "value")


_G9IN = "pts AS (SELECT ts, x, y, CASE WHEN value < 20 THEN 0e0 ELSE value END AS value FROM frame)"


@query("g9_idw_all_points", f"""+ {_G9IN}, {XY}, n AS (SELECT ts, count(*) FILTER (WHERE value <> 0) AS n FROM pts GROUP BY ts),
d AS (SELECT n.ts, n.n, k.x, k.y, p.value AS v, sqrt(pow(k.x - p.x, 2) + pow(k.y - p.y, 2)) AS d FROM n CROSS JOIN k LEFT JOIN pts p ON p.ts = n.ts AND p.value <> 0)
SELECT ts, x, y, {s6("CASE WHEN max(n) = 0 THEN 0e0 WHEN max(n) = 1 THEN max(CASE WHEN d < 1.6e0 THEN v * (1 - d / 1.6e0) ELSE 0e0 END) ELSE coalesce(max(CASE WHEN d < 1e-10 THEN v END), sum(CASE WHEN d >= 1e-10 THEN v / (d * d) END) / sum(CASE WHEN d >= 1e-10 THEN 1 / (d * d) END)) END")} AS value FROM d GROUP BY ts, x, y""")
def _(t: Tables):
    pts = t.frame.withColumn("value", F.when(F.col("value") < 20, 0.0).otherwise(F.col("value")))
    return rounded(I.idw_all_points(pts, DIM), "value")


_WIND = "wind AS (SELECT h.ts, h.sensor_id, s.lat, s.lon, -(h.value / 10) * sin(radians(h.value * 7 % 360)) AS u, -(h.value / 10) * cos(radians(h.value * 7 % 360)) AS v FROM hourly h JOIN sensors s ON s.sensor_id = h.sensor_id)"
_NODES = f"nd AS (SELECT x, y, 34.5e0 - x * (1e0 / 7) AS nlat, -118.75e0 + y * ({SPAN} / 7) AS nlon FROM k)"


def _wind(t: Tables):
    u, v = C.wind_components(F.col("value") / 10, F.col("value") * 7 % 360)
    return t.locate(t.hourly.select("ts", "sensor_id", u.alias("u"), v.alias("v")), F.col("sensor_id")).drop("x", "y")


@query("g10_wind_idw", f"""+ {ELEV}, {XY}, {_NODES}, {_WIND}, st AS (SELECT w.*, e.value AS zs FROM wind w JOIN elev e ON e.x = 7 - CAST(greatest(0, least(trunc((lat - 33.5e0) / 1e0 * 7), 7)) AS INTEGER) AND e.y = CAST(greatest(0, least(trunc((lon - -118.75e0) / {SPAN} * 7), 7)) AS INTEGER)),
d AS (SELECT st.ts, nd.x, nd.y, u, v, sqrt(pow(nlon - lon, 2) + pow(nlat - lat, 2)) AS d, abs(e.value - zs) AS dz, max(abs(e.value - zs)) OVER (PARTITION BY st.ts, nd.x, nd.y) AS top FROM st CROSS JOIN nd JOIN elev e ON e.x = nd.x AND e.y = nd.y),
w AS (SELECT *, 1 / (pow(d + 0.1e0 * (dz / CASE WHEN top > 0 THEN top ELSE 1e0 END), 0.2e0) + 1e-6) AS w FROM d)
SELECT ts, x, y, {s6('sum(w * u) / sum(w)')} AS u, {s6('sum(w * v) / sum(w)')} AS v FROM w GROUP BY ts, x, y""")
def _(t: Tables):
    return rounded(I.wind_idw(_wind(t), elevation(t), EXTENT, DIM), "u", "v")


@query("g11_distance_weighted", f"""+ {XY}, {_NODES}, p AS (SELECT h.ts, h.value, s.lat, s.lon FROM hourly h JOIN sensors s ON s.sensor_id = h.sensor_id),
d AS (SELECT ts, x, y, value, pow(nlon - lon, 2) + pow(nlat - lat, 2) AS d2 FROM p CROSS JOIN nd) SELECT ts, x, y, {s6('sum(value / d2) / sum(1 / d2)')} AS value FROM d GROUP BY ts, x, y""")
def _(t: Tables):
    pts = t.locate(t.hourly.select("ts", "sensor_id", "value"), F.col("sensor_id")).drop("x", "y")
    return rounded(I.distance_weighted(pts, EXTENT, DIM), "value")


_NEAR = f"""+ {XY}, d AS (SELECT f.ts, k.x, k.y, f.value, pow(k.x - f.x, 2) + pow(k.y - f.y, 2) AS d, f.x AS px, f.y AS py FROM frame f CROSS JOIN k)
SELECT ts, x, y, {s6('arg_min(value, (d, px, py))')} AS value FROM d GROUP BY ts, x, y"""


@query("g12_nearest_interpolation", _NEAR)
def _(t: Tables):
    return rounded(I.fill_nearest(t.frame, DIM), "value")


_HOLES = "holes AS (SELECT ts, x, y, CASE WHEN (x * 5 + y * 3 + month(ts)) % 4 <> 0 THEN value END AS value FROM raster)"


def _holes(t: Tables):
    return t.raster.withColumn("value", F.when((F.col("x") * 5 + F.col("y") * 3 + F.month("ts")) % 4 != 0, F.col("value")))


@query("g13_fill_missing_from_nearest", f"""+ {_HOLES}, q AS (SELECT CAST(g // 12 AS INTEGER) AS x, CAST(g % 12 AS INTEGER) AS y FROM (SELECT unnest(generate_series(0, 143)) AS g)),
d AS (SELECT f.ts, q.x, q.y, f.value, pow(q.x - f.x, 2) + pow(q.y - f.y, 2) AS d, f.x AS px, f.y AS py FROM holes f CROSS JOIN q WHERE f.value IS NOT NULL)
SELECT ts, x, y, {s6('arg_min(value, (d, px, py))')} AS value FROM d WHERE y < 7 GROUP BY ts, x, y""")
def _(t: Tables):
    return rounded(I.fill_nearest(_holes(t), 12).where(F.col("y") < 7), "value")


_CLOUD = "cloud AS (SELECT date_trunc('day', l_shipdate) AS ts, l_orderkey * 8 + l_linenumber AS pid, 33.3e0 + (l_partkey * 37 % 1009) / 1009e0 * 1.3e0 AS lat, -118.9e0 + (l_suppkey * 53 % 997 + l_orderkey % 89 * 10) / 1887e0 * 2e0 AS lon, l_quantity AS value FROM lineitem WHERE l_shipdate < TIMESTAMP '1992-03-01')"
_CLOUD = _CLOUD.replace(" WHERE l_shipdate < TIMESTAMP '1992-03-01'", "").replace("date_trunc('day', l_shipdate)", "CAST(date_trunc('month', l_shipdate) AS TIMESTAMP)")


def _cloud(t: Tables):
    li = t.raw("lineitem")
    return li.select(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid"),
                     (F.lit(33.3) + (F.col("l_partkey") * 37 % 1009) / F.lit(1009.0) * F.lit(1.3)).alias("lat"),
                     (F.lit(-118.9) + (F.col("l_suppkey") * 53 % 997 + F.col("l_orderkey") % 89 * 10) / F.lit(1887.0) * F.lit(2.0)).alias("lon"),
                     F.col("l_quantity").alias("value"))


@query("g14_point_cloud_to_grid", f"""+ {XY}, {_CLOUD}, c AS (SELECT ts, pid, value, (34.5e0 - lat) / (1e0 / 7) AS fx, (lon - -118.75e0) / ({SPAN} / 7) AS fy FROM cloud),
d AS (SELECT c.ts, k.x, k.y, value, pid, round(pow(fx - k.x, 2) + pow(fy - k.y, 2), 12) AS d FROM c CROSS JOIN k) SELECT ts, x, y, arg_min(value, (d, pid)) AS value FROM d GROUP BY ts, x, y""")
def _(t: Tables):
    return I.nearest_point(_cloud(t), EXTENT, DIM, "pid")


@query("g14_point_cloud_idw", f"""+ {XY}, {_CLOUD}, c AS (SELECT ts, x, y, avg(value) AS value FROM (SELECT ts, value, CAST(least(trunc((34.5e0 - lat) / 1e0 * 8), 7) AS INTEGER) AS x, CAST(least(trunc((lon - -118.75e0) / {SPAN} * 8), 7) AS INTEGER) AS y FROM cloud WHERE lat BETWEEN 33.5e0 AND 34.5e0 AND lon BETWEEN -118.75e0 AND -117.05e0) GROUP BY ts, x, y),
d AS (SELECT c.ts, k.x, k.y, c.value AS v, c.x AS px, c.y AS py, pow(k.x - c.x, 2) + pow(k.y - c.y, 2) AS d FROM c CROSS JOIN k),
n AS (SELECT *, row_number() OVER (PARTITION BY ts, x, y ORDER BY d, px, py) AS r FROM d)
SELECT ts, 7 - x AS x, y, {s6('coalesce(max(CASE WHEN d = 0 THEN v END), sum(v / nullif(d, 0e0)) / sum(1 / nullif(d, 0e0)))')} AS value FROM n WHERE r <= 10 GROUP BY ts, x, y""")
def _(t: Tables):
    x, y = C.cell_of(EXTENT, DIM)
    pts = _cloud(t).where(C.in_extent(EXTENT)).withColumn("x", x).withColumn("y", y)
    out = I.idw(G.merge_mean(pts), DIM)
    return out.select("ts", C.flip_rows(DIM).alias("x"), "y", r6("value"))


# A cloud per day.  Positions are whole numbers of 1e-5 degrees, so the SQL tests circles in exact integers.
_NET = ("net AS (SELECT CAST(l_shipdate AS TIMESTAMP) AS ts, l_orderkey * 8 + l_linenumber AS pid, l_partkey * 7919 % 100003 AS a, (l_orderkey * 15731 + l_linenumber * 12553 + l_suppkey * 789221) % 200003 AS b, "
        "CAST(l_quantity AS DOUBLE) AS v FROM lineitem), "
        "site AS (SELECT ts, a, b, min(pid) AS pid, arg_min(v, pid) AS v FROM net GROUP BY ts, a, b)")


def _net(t: Tables):
    li = t.raw("lineitem")
    a, b = F.col("l_partkey") * 7919 % 100003, (F.col("l_orderkey") * 15731 + F.col("l_linenumber") * 12553 + F.col("l_suppkey") * 789221) % 200003
    return li.select(F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid"),
                     (F.lit(33.4) + a * F.lit(1e-5)).alias("lat"), (F.lit(-118.9) + b * F.lit(1e-5)).alias("lon"), F.col("l_quantity").cast("double").alias("value"))


@query("g14_point_cloud_linear", f"""+ {XY}, {_NET},
pairs AS (SELECT p.ts, p.pid AS p, q.pid AS q, r.pid AS r, p.a AS pa, p.b AS pb, q.a AS qa, q.b AS qb, r.a AS ra, r.b AS rb, p.v AS pv, q.v AS qv, r.v AS rv,
               CAST(q.b - p.b AS HUGEINT) * (r.a - p.a) - CAST(q.a - p.a AS HUGEINT) * (r.b - p.b) AS turn
          FROM site p JOIN site q ON q.ts = p.ts AND q.pid > p.pid JOIN site r ON r.ts = p.ts AND r.pid > q.pid),
tri AS (SELECT * FROM pairs t WHERE turn <> 0 AND NOT EXISTS (SELECT 1 FROM site s WHERE s.ts = t.ts AND s.pid <> p AND s.pid <> q AND s.pid <> r AND sign(turn) * (
    (CAST(pb - s.b AS HUGEINT) * (pb - s.b) + CAST(pa - s.a AS HUGEINT) * (pa - s.a)) * (CAST(qb - s.b AS HUGEINT) * (ra - s.a) - CAST(qa - s.a AS HUGEINT) * (rb - s.b))
  - (CAST(qb - s.b AS HUGEINT) * (qb - s.b) + CAST(qa - s.a AS HUGEINT) * (qa - s.a)) * (CAST(pb - s.b AS HUGEINT) * (ra - s.a) - CAST(pa - s.a AS HUGEINT) * (rb - s.b))
  + (CAST(rb - s.b AS HUGEINT) * (rb - s.b) + CAST(ra - s.a AS HUGEINT) * (ra - s.a)) * (CAST(pb - s.b AS HUGEINT) * (qa - s.a) - CAST(pa - s.a AS HUGEINT) * (qb - s.b))) > 0)),
node AS (SELECT x, y, (34.5e0 - x * (1e0 / 7) - 33.4e0) / 1e-5 AS na, (-118.75e0 + y * ({SPAN} / 7) + 118.9e0) / 1e-5 AS nb FROM k),
w AS (SELECT ts, x, y, pv, qv, rv, ((nb - pb) * (ra - pa) - (na - pa) * (rb - pb)) / CAST(turn AS DOUBLE) AS wq, ((qb - pb) * (na - pa) - (qa - pa) * (nb - pb)) / CAST(turn AS DOUBLE) AS wr FROM tri, node),
inner_ AS (SELECT ts, x, y, min(pv * (1 - wq - wr) + qv * wq + rv * wr) AS value FROM w WHERE wq >= 0 AND wr >= 0 AND wq + wr <= 1 GROUP BY ts, x, y),
outer_ AS (SELECT ts, x, y, arg_min(v, (pow(a - na, 2) + pow(b - nb, 2), pid)) AS value FROM site, node GROUP BY ts, x, y)
SELECT o.ts, o.x, o.y, {s6('coalesce(i.value, o.value)')} AS value FROM outer_ o LEFT JOIN inner_ i USING (ts, x, y)""")
def _(t: Tables):
    return rounded(I.linear_point(_net(t), EXTENT, DIM, "pid"), "value")


_NATIVE = "nat AS (SELECT ts, x AS \"row\", y AS col, 33e0 + x * 0.2e0 + y * 0.01e0 AS lat, -119e0 + y * 0.4e0 - x * 0.01e0 AS lon, value FROM raster)"


def _native(t: Tables):
    x, y = F.col("x"), F.col("y")
    return t.raster.select("ts", x.alias("row"), y.alias("col"), (F.lit(33.0) + x * F.lit(0.2) + y * F.lit(0.01)).alias("lat"),
                           (F.lit(-119.0) + y * F.lit(0.4) - x * F.lit(0.01)).alias("lon"), "value")


@query("g15_bounding_window", f"+ {_NATIVE}, h AS (SELECT min(\"row\") AS r0, max(\"row\") AS r1, min(col) AS c0, max(col) AS c1 FROM nat WHERE lat BETWEEN 33.9e0 AND 34.2e0 AND lon BETWEEN -118.3e0 AND -117.5e0) SELECT ts, \"row\", col, {s6('value')} AS value FROM nat, h WHERE \"row\" BETWEEN r0 - 2 AND r1 + 2 AND col BETWEEN c0 - 2 AND c1 + 2")
def _(t: Tables):
    out = G.bounding_window(_native(t), (-118.3, -117.5, 33.9, 34.2), 2)
    return out.select("ts", "row", "col", r6("value"))


@query("g16_coordinate_window", f"+ {_NATIVE} SELECT ts, \"row\", col, {s6('value')} AS value FROM nat WHERE lat BETWEEN 33.9e0 AND 34.7e0 AND lon BETWEEN -118.7e0 AND -117.5e0")
def _(t: Tables):
    return _native(t).where(C.in_extent((-118.7, -117.5, 33.9, 34.7))).select("ts", "row", "col", r6("value"))


def _line_sql(name: str, n_in: int, n_out: int, rule: str) -> str:
    src = f"(o + 0.5e0) * ({n_in / n_out!r}e0) - 0.5e0" if rule == "half_pixel" else f"o * ({(n_in - 1) / (n_out - 1)!r}e0)"
    return f"""{name}0 AS (SELECT o, least(greatest({src}, 0e0), {n_in - 1}e0) AS s FROM (SELECT CAST(unnest(generate_series(0, {n_out - 1})) AS INTEGER) AS o)),
{name} AS (SELECT o, i, sum(w) AS w FROM (SELECT o, CAST(floor(s) AS INTEGER) AS i, 1 - (s - floor(s)) AS w FROM {name}0 UNION ALL SELECT o, CAST(least(floor(s) + 1, {n_in - 1}) AS INTEGER), s - floor(s) FROM {name}0) WHERE w <> 0 GROUP BY o, i)"""


def _resize_sql(rule: str) -> str:
    return f"""+ {_HOLES}, {_line_sql('lr', 12, 9, rule)}, {_line_sql('lc', 7, 9, rule)}, nr AS (SELECT o, count(*) AS n FROM lr GROUP BY o), nc AS (SELECT o, count(*) AS n FROM lc GROUP BY o),
a AS (SELECT h.ts, lr.o AS x, lc.o AS y, sum(h.value * lr.w * lc.w) AS s, count(h.value) AS c FROM holes h JOIN lr ON lr.i = h.x JOIN lc ON lc.i = h.y GROUP BY h.ts, lr.o, lc.o)
SELECT a.ts, a.x, a.y, CASE WHEN a.c = nr.n * nc.n THEN {s6('a.s')} END AS value FROM a JOIN nr ON nr.o = a.x JOIN nc ON nc.o = a.y"""


@query("g17_resize_half_pixel", _resize_sql("half_pixel"))
def _(t: Tables):
    return rounded(R.resize(_holes(t), (12, 7), 9, "half_pixel"), "value")


@query("g18_resize_corner_aligned", _resize_sql("corner"))
def _(t: Tables):
    return rounded(R.resize(_holes(t), (12, 7), 9, "corner"), "value")


@query("g19_row_flip", f"SELECT ts, 11 - x AS x, y, {s6('value')} AS value FROM raster")
def _(t: Tables):
    return t.raster.select("ts", C.flip_rows(12).alias("x"), "y", r6("value"))


# Dense frames for smoothing: monthly means, absent pixels as zero.
_FULL = "full0 AS (SELECT m.ts, CAST(g // 7 AS INTEGER) AS x, CAST(g % 7 AS INTEGER) AS y FROM (SELECT DISTINCT ts FROM raster) m CROSS JOIN (SELECT unnest(generate_series(0, 83)) AS g)), dense AS (SELECT f.ts, f.x, f.y, CASE WHEN month(f.ts) = 7 THEN 0e0 ELSE coalesce(r.value, 0e0) END AS value FROM full0 f LEFT JOIN raster r ON r.ts = f.ts AND r.x = f.x AND r.y = f.y)"


def _full(t: Tables):
    k = t.raster.select("ts").distinct().withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(83))))
    slots = k.select("ts", F.floor(F.col("_k") / 7).cast("int").alias("x"), (F.col("_k") % 7).cast("int").alias("y"))
    return slots.join(t.raster, ["ts", "x", "y"], "left").select(
        "ts", "x", "y", F.when(F.month("ts") == 7, 0.0).otherwise(F.coalesce("value", F.lit(0.0))).alias("value"))


def _gauss_sql(sigma: float, border: str) -> str:
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    taps = ", ".join(f"({k - r}, CAST('{v / sum(raw)!r}' AS DOUBLE))" for k, v in enumerate(raw))

    def line(name: str, n: int) -> str:
        j = f"((o + d) % {2 * n} + {2 * n}) % {2 * n}"
        i = "o + d" if border == "constant" else f"CASE WHEN {j} < {n} THEN {j} ELSE {2 * n - 1} - {j} END"
        cut = f"WHERE o + d >= 0 AND o + d < {n}" if border == "constant" else ""
        return f"{name} AS (SELECT o, i, sum(w) AS w FROM (SELECT o, {i} AS i, w FROM (SELECT CAST(unnest(generate_series(0, {n - 1})) AS INTEGER) AS o), taps {cut}) GROUP BY o, i)"
    return f"""+ {_FULL}, taps(d, w) AS (VALUES {taps}), {line('lr', 12)}, {line('lc', 7)}
SELECT h.ts, lr.o AS x, lc.o AS y, {s6('sum(h.value * lr.w * lc.w)')} AS value FROM dense h JOIN lr ON lr.i = h.x JOIN lc ON lc.i = h.y GROUP BY h.ts, lr.o, lc.o"""


@query("g20_gaussian_positive_frames", _gauss_sql(1.0, "reflect"))
def _(t: Tables):
    return rounded(R.gaussian(_full(t), (12, 7), 1.0, only_positive=True), "value").select("ts", "x", "y", "value")


@query("g20_gaussian_half", _gauss_sql(0.5, "reflect"))
def _(t: Tables):
    return rounded(R.gaussian(_full(t), (12, 7), 0.5), "value")


@query("g20_gaussian_zero_border", _gauss_sql(2.0, "constant"))
def _(t: Tables):
    return rounded(R.gaussian(_full(t), (12, 7), 2.0, "constant"), "value")


@query("g21_variable_box_blur", f"+ {LAYER}, {XY}, rad AS (SELECT x, y, CAST(trunc(value) % 4 AS INTEGER) AS radius FROM layer) SELECT f.ts, rad.x, rad.y, {s6('avg(f.value)')} AS value FROM rad JOIN frame f ON abs(f.x - rad.x) <= radius AND abs(f.y - rad.y) <= radius GROUP BY f.ts, rad.x, rad.y")
def _(t: Tables):
    radii = layer(t).select("x", "y", (F.col("value").cast("int") % 4).cast("int").alias("radius"))
    return rounded(I.box_blur(t.frame, radii, DIM), "value")


_MODEL = "model AS (SELECT f.ts, k.x, k.y, f.m + k.x * 0.5e0 - k.y * 0.25e0 AS value FROM (SELECT ts, avg(value) AS m FROM frame GROUP BY ts) f CROSS JOIN k), res AS (SELECT f.ts, f.x, f.y, f.value - m.value AS value FROM frame f JOIN model m ON m.ts = f.ts AND m.x = f.x AND m.y = f.y)"


def _model(t: Tables):
    return G.each_cell(t.frame.groupBy("ts").agg(F.avg("value").alias("_m")), DIM).select(
        "ts", "x", "y", (F.col("_m") + F.col("x") * F.lit(0.5) - F.col("y") * F.lit(0.25)).alias("value"))


@query("g22_semivariogram", f"""+ {XY}, {_MODEL}, p AS (SELECT a.ts, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, pow(a.value - b.value, 2) AS g FROM res a JOIN res b ON b.ts = a.ts AND a.x * 8 + a.y < b.x * 8 + b.y),
q AS (SELECT *, max(d) OVER (PARTITION BY ts) AS far FROM p) SELECT ts, CAST(least(floor(d / far * 10), 9) AS INTEGER) AS lag, {s6('max(far) * (least(floor(max(d) / max(far) * 10), 9) + 1) / 10')} AS distance, count(*) AS n_pairs, {s6('sum(g) / (2 * count(*))')} AS semivariance FROM q GROUP BY ts, least(floor(d / far * 10), 9)""")
def _(t: Tables):
    return rounded(I.semivariogram(I.residuals(t.frame, _model(t)), DIM), "distance", "semivariance")


# Clusters: every pair of cuts of the distinct distances is tried, with sums from the start in place of the runs' own.
@query("g22_semivariogram_clusters", f"""+ {XY}, {_MODEL}, p AS (SELECT a.ts, CAST(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS BIGINT) AS d2, pow(a.value - b.value, 2) AS g FROM res a JOIN res b ON b.ts = a.ts AND a.x * 8 + a.y < b.x * 8 + b.y),
u AS (SELECT ts, d2, count(*) AS w, sum(g) AS g FROM p GROUP BY ts, d2),
c AS (SELECT ts, d2, w, g, row_number() OVER o AS j, count(*) OVER (PARTITION BY ts) AS m, sum(w) OVER o AS cw, sum(w * sqrt(d2)) OVER o AS cs, sum(w * d2) OVER o AS cq FROM u WINDOW o AS (PARTITION BY ts ORDER BY d2)),
e AS (SELECT ts, 0 AS j, 0 AS cw, 0 AS cs, 0 AS cq, max(m) AS m FROM c GROUP BY ts UNION ALL SELECT ts, j, cw, cs, cq, m FROM c),
r AS (SELECT a.ts, a.j AS lo, b.j AS hi, b.m, greatest(b.cq - a.cq - pow(b.cs - a.cs, 2) / (b.cw - a.cw), 0) AS cost FROM e a JOIN e b ON b.ts = a.ts AND b.j > a.j),
t AS (SELECT r1.ts, r1.hi AS c1, r2.hi AS c2, r1.cost + r2.cost + r3.cost AS cost FROM r r1 JOIN r r2 ON r2.ts = r1.ts AND r2.lo = r1.hi JOIN r r3 ON r3.ts = r1.ts AND r3.lo = r2.hi AND r3.hi = r3.m WHERE r1.lo = 0),
f AS (SELECT ts, c1, c2, cost, min(cost) OVER (PARTITION BY ts) AS best FROM t), z AS (SELECT ts, c1, c2, row_number() OVER (PARTITION BY ts ORDER BY c2, c1) AS nr FROM f WHERE cost <= best + 1e-9),
v AS (SELECT c.ts, c.d2, c.w, c.g, CAST(CASE WHEN c.m <= 3 THEN c.j - 1 WHEN c.j <= z.c1 THEN 0 WHEN c.j <= z.c2 THEN 1 ELSE 2 END AS INTEGER) AS lag FROM c LEFT JOIN z ON z.ts = c.ts AND z.nr = 1)
SELECT ts, lag, {s6('sqrt(max(d2))')} AS distance, CAST(sum(w) AS BIGINT) AS n_pairs, {s6('sum(g) / (2 * sum(w))')} AS semivariance FROM v GROUP BY ts, lag""")
def _(t: Tables):
    return rounded(I.semivariogram(I.residuals(t.frame, _model(t)), DIM, 3, bins="cluster"), "distance", "semivariance")


@query("g23_residual_kriging")
def _(t: Tables):
    return rounded(I.residual_kriging(t.frame, _model(t), DIM), "value")


# Exactly three neighbours: the 4 x 4 system has a closed form, and a cell with fewer in range gets no residual.
_KRIGING = f"""+ {XY}, {_MODEL}, p AS (SELECT a.ts, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, pow(a.value - b.value, 2) AS g FROM res a JOIN res b ON b.ts = a.ts AND a.x * 8 + a.y < b.x * 8 + b.y),
q AS (SELECT *, max(d) OVER (PARTITION BY ts) AS far FROM p), vg AS (SELECT ts, max(far) * (least(floor(d / far * 10), 9) + 1) / 10 AS h, sum(g) / (2 * count(*)) AS g FROM q GROUP BY ts, least(floor(d / far * 10), 9)),
sc AS (SELECT v.ts, s.i, max(v.h) OVER (PARTITION BY v.ts) * (0.02e0 + s.i * (0.98e0 / 199)) AS rng, v.h, v.g FROM vg v CROSS JOIN (SELECT unnest(generate_series(0, 199)) AS i) s),
b0 AS (SELECT ts, i, rng, g, 1 - exp(-3 * h / rng) AS b FROM sc), fit AS (SELECT ts, i, any_value(rng) AS rng, sum(b * g) / sum(b * b) AS sill, sum(g * g) AS gg FROM b0 GROUP BY ts, i),
er AS (SELECT f.ts, f.i, f.rng, f.sill, f.gg, sum(pow(b0.b * f.sill - b0.g, 2)) AS e FROM fit f JOIN b0 ON b0.ts = f.ts AND b0.i = f.i GROUP BY ALL),
bs AS (SELECT ts, arg_min(rng, i) AS rng, arg_min(sill, i) AS sill FROM (SELECT *, min(e) OVER (PARTITION BY ts) AS least_e FROM er) WHERE e <= least_e + 1e-9 * gg GROUP BY ts),
fr AS (SELECT ts, count(*) AS n, min(value) AS lo, max(value) AS hi FROM res GROUP BY ts),
o AS (SELECT r.ts, k.x, k.y, r.x AS px, r.y AS py, r.value AS v, pow(k.x - r.x, 2) + pow(k.y - r.y, 2) AS d2, row_number() OVER (PARTITION BY r.ts, k.x, k.y ORDER BY pow(k.x - r.x, 2) + pow(k.y - r.y, 2), r.x, r.y) AS nr FROM res r CROSS JOIN k),
t3 AS (SELECT ts, x, y, max(CASE WHEN nr = 1 THEN px END) AS x1, max(CASE WHEN nr = 1 THEN py END) AS y1, max(CASE WHEN nr = 1 THEN v END) AS v1, max(CASE WHEN nr = 1 THEN d2 END) AS d1, max(CASE WHEN nr = 2 THEN px END) AS x2, max(CASE WHEN nr = 2 THEN py END) AS y2, max(CASE WHEN nr = 2 THEN v END) AS v2, max(CASE WHEN nr = 2 THEN d2 END) AS d2,
 max(CASE WHEN nr = 3 THEN px END) AS x3, max(CASE WHEN nr = 3 THEN py END) AS y3, max(CASE WHEN nr = 3 THEN v END) AS v3, max(CASE WHEN nr = 3 THEN d2 END) AS d3 FROM o WHERE nr <= 3 GROUP BY ts, x, y),
gm AS (SELECT t3.*, sill * (1 - exp(-3 * sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)) / rng)) AS g12, sill * (1 - exp(-3 * sqrt(pow(x1 - x3, 2) + pow(y1 - y3, 2)) / rng)) AS g13, sill * (1 - exp(-3 * sqrt(pow(x2 - x3, 2) + pow(y2 - y3, 2)) / rng)) AS g23,
 sill * (1 - exp(-3 * sqrt(d1) / rng)) AS c1, sill * (1 - exp(-3 * sqrt(d2) / rng)) AS c2, sill * (1 - exp(-3 * sqrt(d3) / rng)) AS c3 FROM t3 JOIN bs ON bs.ts = t3.ts WHERE d3 <= rng * rng),
dt AS (SELECT *, 4 * g13 * g23 - (g12 - g23 - g13) * (g12 - g13 - g23) AS det FROM gm),
w AS (SELECT *, ((c1 - c3 - g13) * -2 * g23 - (g12 - g23 - g13) * (c2 - c3 - g23)) / det AS w1, (-2 * g13 * (c2 - c3 - g23) - (c1 - c3 - g13) * (g12 - g13 - g23)) / det AS w2 FROM dt),
kr AS (SELECT ts, x, y, w1 * v1 + w2 * v2 + (1 - w1 - w2) * v3 AS r FROM w)
SELECT m.ts, m.x, m.y, {s6('m.value + CASE WHEN fr.n >= 3 AND fr.lo = fr.hi THEN fr.lo WHEN fr.n >= 3 THEN coalesce(kr.r, 0e0) ELSE 0e0 END')} AS value FROM model m LEFT JOIN fr ON fr.ts = m.ts LEFT JOIN kr ON kr.ts = m.ts AND kr.x = m.x AND kr.y = m.y"""


@query("g23_residual_kriging_three", _KRIGING)
def _(t: Tables):
    return rounded(I.residual_kriging(t.frame, _model(t), DIM, min_points=3, max_points=3), "value")


@query("g24_frame_validity", f"+ {_HOLES} SELECT ts, count(value) AS n_valid, count(value) > 0 AS is_valid FROM holes GROUP BY ts")
def _(t: Tables):
    return G.frame_validity(_holes(t))


@query("g25_wind_to_earth", f"+ {_WIND}, a AS (SELECT *, atan(tan(radians(lon + 97.5e0)) * {math.sin(math.radians(38.5))!r}e0) AS al FROM wind) SELECT ts, sensor_id, {s6('u * cos(al) + v * sin(al)')} AS u, {s6('-u * sin(al) + v * cos(al)')} AS v FROM a")
def _(t: Tables):
    u, v = C.wind_to_earth("u", "v", "lon")
    return _wind(t).select("ts", "sensor_id", r6(u, "u"), r6(v, "v"))


@query("g26_wind_components", f"+ {_WIND} SELECT ts, sensor_id, {s6('u')} AS u, {s6('v')} AS v FROM wind")
def _(t: Tables):
    return rounded(_wind(t).select("ts", "sensor_id", "u", "v"), "u", "v")


_REGIONS = "sc AS (SELECT DISTINCT x, y FROM sensors), nh AS (SELECT DISTINCT k.x, k.y FROM k JOIN sc ON abs(k.x - sc.x) <= {r} AND abs(k.y - sc.y) <= {r})"


def _few(t: Tables):
    return t.sensors


@query("g27_region_masks", f"+ {XY}, {_REGIONS.format(r=2)} SELECT 'sensor' AS region, x, y FROM sc UNION ALL SELECT 'nhood', x, y FROM nh UNION ALL SELECT 'full', x, y FROM k")
def _(t: Tables):
    return G.region_masks(_few(t), DIM, 2)


@query("g28_weight_grid", f"+ {XY}, {_REGIONS.format(r=1)} SELECT k.x, k.y, CASE WHEN sc.x IS NOT NULL THEN 25e0 WHEN nh.x IS NOT NULL THEN 5e0 ELSE 1e0 END AS weight FROM k LEFT JOIN sc ON sc.x = k.x AND sc.y = k.y LEFT JOIN nh ON nh.x = k.x AND nh.y = k.y")
def _(t: Tables):
    return G.weight_grid(_few(t), DIM, 1)


@query("g29_centre_block", f"SELECT ts, x, y, {s6('value')} AS value FROM raster WHERE x >= 4 AND x < 8 AND y >= 1 AND y < 5")
def _(t: Tables):
    return rounded(G.centre_block(t.raster, 4, 12, 7), "value")


@query("g30_mean_spacing", f"+ c AS (SELECT DISTINCT c_acctbal AS v FROM customer), l AS (SELECT v - lag(v) OVER (ORDER BY v) AS d FROM c) SELECT {s6('avg(abs(d))')} AS spacing FROM l")
def _(t: Tables):
    return rounded(G.mean_spacing(t.raw("customer"), "c_acctbal"), "spacing")
