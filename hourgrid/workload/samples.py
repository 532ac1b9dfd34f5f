"""S1-S18 and X1-X12."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hourgrid.functions import columns as C
from hourgrid.operators import augment as X
from hourgrid.operators import samples as S
from hourgrid.operators.fills import fill_series
from hourgrid.workload.base import Tables, query, r6, rounded, s6
from hourgrid.workload.gridding import LAYER, layer

# One complete frame per hour: the ten sensors' filled values in sensor order.
_SER = """ser AS (SELECT sensor_id, date_diff('hour', (SELECT lo FROM axis_span), ts) AS i, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY ts), first_value(value IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM scaffold)"""


def _series(t: Tables):
    return fill_series(t.scaffold, ["value"]).select("sensor_id", C.hour_index("ts", t.start).alias("ts_idx"), "value")


def _frames(t: Tables):
    return S.pack_dense(_series(t).withColumn("channel", F.lit("pm")), ["channel", "ts_idx"], F.col("sensor_id"))


def _long(windows, column: str, part: str, keys=("channel",)):
    return S.explode_frames(windows, column, keys).select(F.lit(part).alias("part"), *keys, "sample_id", "frame_idx", "cell", r6("value"))


def _window_sql(n_in: int, n_out: int, stride: int = 1, drop: int = 0, src: str = "ser", group: str = "'pm'", parts=("x", "y")) -> str:
    x = f"SELECT 'x' AS part, {group} AS channel, CAST(s.i // {stride} AS BIGINT) AS sample_id, CAST(b.i - s.i AS INTEGER) AS frame_idx, CAST(b.sensor_id AS INTEGER) AS cell, {s6('b.value')} AS value FROM st s JOIN {src} b ON b.i BETWEEN s.i AND s.i + {n_in - 1}"
    y = f"SELECT 'y' AS part, {group} AS channel, CAST(s.i // {stride} AS BIGINT) AS sample_id, CAST(b.i - s.i - {n_in} AS INTEGER) AS frame_idx, CAST(b.sensor_id AS INTEGER) AS cell, {s6('b.value')} AS value FROM st s JOIN {src} b ON b.i BETWEEN s.i + {n_in} AND s.i + {n_in + n_out - 1}"
    both = {"x": x, "y": y}
    return f"st AS (SELECT DISTINCT i FROM {src} WHERE i % {stride} = 0 AND i <= (SELECT max(i) + 1 FROM {src}) - {n_in + n_out + drop}) " + " UNION ALL ".join(both[p] for p in parts)


@query("s1_sliding_windows", f"+ {_SER}, " + _window_sql(6, 3, 2))
def _(t: Tables):
    w = S.sliding_windows(_frames(t), 6, 3, 2)
    return _long(w, "x_frames", "x").unionByName(_long(w, "y_frames", "y"))


@query("s2_equal_length_windows", f"+ {_SER}, " + _window_sql(5, 5, 5))
def _(t: Tables):
    w = S.sliding_windows(_frames(t), 5, 5, 5)
    return _long(w, "x_frames", "x").unionByName(_long(w, "y_frames", "y"))


@query("s3_windows_one_less", f"+ {_SER}, " + _window_sql(4, 0, 1, 1, parts=("x",)))
def _(t: Tables):
    return _long(S.sliding_windows(_frames(t), 4, 0, drop_last=True), "x_frames", "x")


@query("s4_forecast_channel_windows", f"+ {_SER}, " + _window_sql(6, 4, 3, parts=("y",)))
def _(t: Tables):
    return _long(S.sliding_windows(_frames(t), 6, 4, 3), "y_frames", "y")


@query("s5_next_frame_labels", f"+ {_SER} SELECT i - 5 AS sample_id, " + ", ".join(f"{s6(f'max(value) FILTER (WHERE sensor_id = {k})')} AS s{k}" for k in range(10)) + " FROM ser WHERE i >= 5 GROUP BY i")
def _(t: Tables):
    return rounded(S.next_frame_labels(_series(t), 5, range(10)), *[f"s{k}" for k in range(10)])


_HOURS = "(SELECT date_diff('hour', lo, hi) FROM axis_span)"


def _split_sql(i: str, n: str, cuts, names) -> str:
    cases = " ".join(f"WHEN {i} < CAST(trunc(({n}) * {c}e0) AS BIGINT) THEN '{m}'" for c, m in zip(cuts, names))
    return f"CASE {cases} ELSE '{names[-1]}' END"


@query("s6_split_before_windowing", f"""+ {_SER}, sp AS (SELECT sensor_id, i AS gi, value, {_split_sql('i', _HOURS, (0.7, 0.85), ('train', 'valid', 'test'))} AS split FROM ser), rb AS (SELECT split, sensor_id, value, gi - min(gi) OVER (PARTITION BY split) AS i FROM sp),
st AS (SELECT DISTINCT split, i FROM rb r WHERE i <= (SELECT max(q.i) + 1 FROM rb q WHERE q.split = r.split) - 36 AND i % 12 = 0)
SELECT s.split, CAST(s.i // 12 AS BIGINT) AS sample_id, count(*) AS n, {s6('avg(b.value) FILTER (WHERE b.i < s.i + 24)')} AS x_mean, {s6('avg(b.value) FILTER (WHERE b.i >= s.i + 24)')} AS y_mean FROM st s JOIN rb b ON b.split = s.split AND b.i BETWEEN s.i AND s.i + 35 GROUP BY s.split, s.i""")
def _(t: Tables):
    frames = S.rebase(S.temporal_split(_frames(t), "ts_idx", t.n_hours))
    w = S.sliding_windows(frames, 24, 12, 12, keys=("split",))
    mean = lambda c: F.aggregate(F.flatten(c), F.lit(0.0), lambda a, v: a + v) / F.size(F.flatten(c))
    return w.select("split", "sample_id", (F.size(F.flatten("x_frames")) + F.size(F.flatten("y_frames"))).alias("n"),
                    r6(mean("x_frames"), "x_mean"), r6(mean("y_frames"), "y_mean"))


def _split_query(name: str, shares):
    cuts, total = [], 0.0
    for _, share in shares[:-1]:
        total = round(total + share, 10)
        cuts.append(total)
    sql = "+ n AS (SELECT max(sample_id) + 1 AS n FROM forecasts) SELECT sample_id, sensor_id, horizon, " + _split_sql("sample_id", "SELECT n FROM n", cuts, [m for m, _ in shares]) + " AS split FROM forecasts"

    @query(name, sql)
    def _(t: Tables):
        rows = t.forecasts.select("sample_id", "sensor_id", "horizon")
        n = rows.agg((F.max("sample_id") + 1).alias("n")).scalar()
        return S.temporal_split(rows, "sample_id", n, shares)


_split_query("s7_split_after_windowing", (("train", 0.7), ("valid", 0.1), ("test", 0.2)))
_split_query("s8_two_way_split", (("train", 0.8), ("test", 0.2)))
_split_query("s9_valid_test_train_order", (("valid", 0.15), ("test", 0.15), ("train", 0.7)))

_CH = "g0 AS (SELECT channel, ts, x, y, value, " + _split_sql("date_diff('hour', (SELECT lo FROM axis_span), ts)", _HOURS, (0.7, 0.85), ("train", "valid", "test")) + " AS split FROM grid), sc AS (SELECT channel, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1e0 ELSE stddev_pop(value) END AS std FROM g0 WHERE split = 'train' GROUP BY channel)"


def _split_grid(t: Tables):
    g = t.grid.withColumn("ts_idx", C.hour_index("ts", t.start))
    return S.temporal_split(g, "ts_idx", t.n_hours).drop("ts_idx")


@query("s10_train_scaler_state", f"+ {_CH} SELECT channel, {s6('mean')} AS mean, {s6('std')} AS std FROM sc")
def _(t: Tables):
    return rounded(S.fit_scalers(_split_grid(t)), "mean", "std")


@query("s10_standard_scaling", f"+ {_CH} SELECT g0.channel, ts, x, y, split, {s6('(value - mean) / std')} AS value FROM g0 JOIN sc ON sc.channel = CASE WHEN g0.channel = 'view' THEN 'click' ELSE g0.channel END")
def _(t: Tables):
    g = _split_grid(t)
    return rounded(S.apply_scalers(g, S.fit_scalers(g), reuse={"view": "click"}), "value").select("channel", "ts", "x", "y", "split", "value")


@query("s11_global_scaling", f"+ s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM frame) SELECT ts, x, y, {s6('(value - m) / sd')} AS value FROM frame, s")
def _(t: Tables):
    return rounded(S.apply_scalers(t.frame, S.fit_scalers(t.frame, (), split=None), ()), "value")


@query("s12_min_max_elevation", f"+ {LAYER} SELECT x, y, {s6('(value - (SELECT min(value) FROM layer)) / ((SELECT max(value) FROM layer) - (SELECT min(value) FROM layer) + 1e-8)')} AS value FROM layer")
def _(t: Tables):
    return rounded(S.min_max(layer(t)), "value")


@query("s12_vegetation_first_frame", f"+ f AS (SELECT * FROM raster WHERE ts = (SELECT min(ts) FROM raster)) SELECT 'raw' AS kind, x, y, {s6('(value - (SELECT min(value) FROM f)) / ((SELECT max(value) FROM f) - (SELECT min(value) FROM f) + 1e-8)')} AS value FROM f UNION ALL SELECT 'unit', x, y, {s6('(value / 200 + 1) / 2')} FROM f")
def _(t: Tables):
    raw = S.vegetation_layer(t.raster).select(F.lit("raw").alias("kind"), "x", "y", r6("value"))
    unit = S.vegetation_layer(t.raster.withColumn("value", F.col("value") / 200)).select(F.lit("unit").alias("kind"), "x", "y", r6("value"))
    return raw.unionByName(unit)


_MANIFEST = [("click", "Clicks", True, False, False), ("error", "Errors", False, False, False), ("view", "Views", True, False, True)]


@query("s13_channel_manifest", f"+ {_CH}, mf(channel, name, scale) AS (VALUES " + ", ".join(f"('{c}', '{n}', {str(s).lower()})" for c, n, s, _, _ in _MANIFEST) + f") SELECT mf.name, g0.ts, g0.x, g0.y, CASE WHEN mf.scale THEN {s6('(value - mean) / std')} ELSE {s6('value')} END AS value FROM g0 JOIN mf ON mf.channel = g0.channel JOIN sc ON sc.channel = g0.channel")
def _(t: Tables):
    g = _split_grid(t)
    manifest = t.spark.createDataFrame(_MANIFEST, "channel string, name string, scale boolean, temporal boolean, forecast boolean")
    return S.apply_manifest(g, manifest, S.fit_scalers(g)).select("name", "ts", "x", "y", r6("value"))


@query("s14_event_samples", """+ w AS (SELECT date_diff('hour', (SELECT lo FROM axis_span), min(ts)) AS a, date_diff('hour', (SELECT lo FROM axis_span), max(ts)) AS b FROM frame WHERE value > 200), n AS (SELECT max(sample_id) + 1 AS n FROM forecasts)
SELECT DISTINCT sample_id FROM forecasts, w, n WHERE sample_id >= greatest(0, a - 24) AND sample_id <= least(n - 1, b - 24 + 1)""")
def _(t: Tables):
    hot = t.frame.where(F.col("value") > 200)
    edge = lambda f: hot.agg(C.hour_index(f("ts"), t.start).alias("h")).scalar()
    ids = t.forecasts.select("sample_id").distinct()
    n = t.forecasts.agg((F.max("sample_id") + 1).alias("n")).scalar()
    return S.event_samples(ids, edge(F.min), edge(F.max), 24, n)


@query("s15_batch_index", "+ s AS (SELECT o_orderkey AS sample_id FROM orders) SELECT sample_id, CAST(sample_id // 32 AS BIGINT) AS batch FROM s WHERE sample_id // 32 < (SELECT count(*) // 32 FROM s)")
def _(t: Tables):
    return S.batch_index(t.raw("orders").select(F.col("o_orderkey").alias("sample_id")), 32, drop_remainder=True)


@query("s16_window_verification", f"+ {_SER}, c AS (SELECT count(DISTINCT i) AS n FROM ser) SELECT n - 10 + 1 - 5 AS n_checked, 0 AS n_mismatch FROM c")
def _(t: Tables):
    w = S.sliding_windows(_frames(t), 5, 5)
    bad = S.window_mismatches(w, 5)
    n = w.agg((F.count(F.lit(1)) - 5).alias("n_checked"))
    return n.select("n_checked", bad.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar().alias("n_mismatch"))


@query("s17_shifted_pairs", f"""+ {_SER}, st AS (SELECT DISTINCT i FROM ser WHERE i % 6 = 0 AND i <= (SELECT date_diff('hour', lo, hi) FROM axis_span) - 6), b AS (SELECT CAST(s.i // 6 AS BIGINT) AS sample_id, CAST(v.i - s.i AS INTEGER) AS f, v.sensor_id, v.value FROM st s JOIN ser v ON v.i BETWEEN s.i AND s.i + 5)
SELECT a.sample_id, a.f AS frame_idx, CAST(a.sensor_id AS INTEGER) AS cell, {s6('a.value')} AS value, {s6('c.value')} AS target FROM b a JOIN b c ON c.sample_id = a.sample_id AND c.sensor_id = a.sensor_id AND c.f = a.f + 1""")
def _(t: Tables):
    w = S.shifted_pairs(S.sliding_windows(_frames(t), 6, 0, 6), 6)
    rows = w.select("sample_id", F.posexplode(F.arrays_zip("x_pair", "y_pair")).alias("frame_idx", "_p"))
    cells = rows.select("sample_id", "frame_idx", F.posexplode(F.arrays_zip(F.col("_p.x_pair").alias("a"), F.col("_p.y_pair").alias("b"))).alias("cell", "_c"))
    return cells.select("sample_id", "frame_idx", "cell", r6(F.col("_c.a"), "value"), r6(F.col("_c.b"), "target"))


@query("s18_shuffled_order", "SELECT sample_id, row_number() OVER (ORDER BY md5('11:' || sample_id), sample_id) - 1 AS position FROM (SELECT DISTINCT sample_id FROM forecasts)")
def _(t: Tables):
    return S.shuffled_order(t.forecasts, 11)


# ------------------------------------------------------------------ augmentation
N = 6
WIND = (("u", "v"),)
_TILE = f"tile AS (SELECT sample_id, channel, x, y, avg(value) AS value FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS sample_id, CASE l_linenumber WHEN 1 THEN 'u' WHEN 2 THEN 'v' ELSE 'pm' END AS channel, CAST(l_suppkey % {N} AS INTEGER) AS x, CAST(l_partkey % {N} AS INTEGER) AS y, l_extendedprice / 1000 - CASE WHEN l_linenumber < 3 THEN 50 ELSE 0 END AS value FROM lineitem) GROUP BY ALL)"


def _tile(t: Tables):
    ln = F.col("l_linenumber")
    rows = t.raw("lineitem").select(
        F.year("l_shipdate").alias("sample_id"), F.when(ln == 1, "u").when(ln == 2, "v").otherwise("pm").alias("channel"),
        (F.col("l_suppkey") % N).cast("int").alias("x"), (F.col("l_partkey") % N).cast("int").alias("y"),
        (F.col("l_extendedprice") / 1000 - F.when(ln < 3, 50).otherwise(0)).alias("value"))
    return rows.groupBy("sample_id", "channel", "x", "y").agg(F.avg("value").alias("value"))


_PLACE = {"h-flip": ("x", "{m} - y"), "v-flip": ("{m} - x", "y"), "hv-flip": ("{m} - x", "{m} - y"), "rot90": ("{m} - y", "x"),
          "rot270": ("y", "{m} - x"), "transpose": ("y", "x"), "anti-transpose": ("{m} - y", "{m} - x")}
# channel -> (new channel, sign) on the north-up grid, and the strict rule
_GO = {"h-flip": (("u", "u", -1), ("v", "v", 1)), "v-flip": (("u", "u", 1), ("v", "v", -1)), "hv-flip": (("u", "u", -1), ("v", "v", -1)),
       "rot90": (("v", "u", -1), ("u", "v", 1)), "rot270": (("v", "u", 1), ("u", "v", -1)),
       "transpose": (("v", "u", -1), ("u", "v", -1)), "anti-transpose": (("v", "u", 1), ("u", "v", 1))}
_GO_STRICT = {**_GO, "rot90": (("v", "u", 1), ("u", "v", -1)), "rot270": (("v", "u", -1), ("u", "v", 1)),
              "transpose": (("v", "u", 1), ("u", "v", 1)), "anti-transpose": (("v", "u", -1), ("u", "v", -1))}


def _remap_sql(variant: str, strict: bool = False, wind: bool = True, channels=("pm", "u", "v")) -> str:
    px, py = (e.format(m=N - 1) for e in _PLACE[variant])
    parts = []
    moved = {a: (b, s) for a, b, s in (_GO_STRICT if strict else _GO)[variant]}
    for ch in channels:
        to, sign = moved.get(ch, (ch, 1)) if wind else (ch, 1)
        frozen = strict and wind and ch != "pm" and variant in ("rot90", "rot270", "transpose", "anti-transpose")
        parts.append(f"SELECT '{variant}' AS variant, sample_id, '{to}' AS channel, CAST({'x' if frozen else px} AS INTEGER) AS x, CAST({'y' if frozen else py} AS INTEGER) AS y, {s6(f'value * {sign}')} AS value FROM tile WHERE channel = '{ch}'")
    return " UNION ALL ".join(parts)


def _exact(name: str, variant: str, strict: bool = False):
    @query(name, f"+ {_TILE} {_remap_sql(variant, strict)}")
    def _(t: Tables):
        return rounded(X.exact_variants(_tile(t), N, WIND, strict, [variant]), "value")


for _name, _variant in (("x1_horizontal_flip", "h-flip"), ("x2_vertical_flip", "v-flip"), ("x3_both_flips", "hv-flip"), ("x4_quarter_turn", "rot90"),
                        ("x5_three_quarter_turn", "rot270"), ("x6_transpose", "transpose"), ("x7_anti_transpose", "anti-transpose")):
    _exact(_name, _variant)
for _name, _variant in (("x4_quarter_turn_strict", "rot90"), ("x5_three_quarter_turn_strict", "rot270"), ("x6_transpose_strict", "transpose"), ("x7_anti_transpose_strict", "anti-transpose")):
    _exact(_name, _variant, strict=True)


@query("x8_target_counterparts", f"+ {_TILE} " + " UNION ALL ".join(_remap_sql(v, wind=False) for v in X.EXACT))
def _(t: Tables):
    return rounded(X.exact_variants(_tile(t), N), "value")


def _num(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def _rot_cte(name: str, deg: float, n: int = N) -> str:
    th = math.radians(deg)
    c, s = math.cos(th), math.sin(th)
    pts = [(c * a + s * b, -s * a + c * b) for a in (0, n) for b in (0, n)]
    size = [int(max(p[k] for p in pts) - min(p[k] for p in pts) + 0.5) for k in (0, 1)]
    mid = [(v - 1) / 2 for v in size]
    off = [(n - 1) / 2 - (c * mid[0] + s * mid[1]), (n - 1) / 2 - (-s * mid[0] + c * mid[1])]
    cut = [(v - n) // 2 for v in size]
    mir = lambda e: f"CASE WHEN (({e}) % {2 * n} + {2 * n}) % {2 * n} < {n} THEN (({e}) % {2 * n} + {2 * n}) % {2 * n} ELSE {2 * n - 1} - (({e}) % {2 * n} + {2 * n}) % {2 * n} END"
    taps = " UNION ALL ".join(
        f"SELECT ox, oy, {mir(f'CAST(floor(sx) AS INTEGER) + {dx}')} AS x, {mir(f'CAST(floor(sy) AS INTEGER) + {dy}')} AS y, "
        f"{'(sx - floor(sx))' if dx else '(1 - (sx - floor(sx)))'} * {'(sy - floor(sy))' if dy else '(1 - (sy - floor(sy)))'} AS w FROM {name}s" for dx in (0, 1) for dy in (0, 1))
    return f"""{name}s AS (SELECT ox, oy, (ox + {cut[0]}) * {_num(c)} + (oy + {cut[1]}) * {_num(s)} + {_num(off[0])} AS sx, (ox + {cut[0]}) * {_num(-s)} + (oy + {cut[1]}) * {_num(c)} + {_num(off[1])} AS sy FROM (SELECT CAST(g // {n} AS INTEGER) AS ox, CAST(g % {n} AS INTEGER) AS oy FROM (SELECT unnest(generate_series(0, {n * n - 1})) AS g))),
{name} AS (SELECT ox, oy, x, y, sum(w) AS w FROM ({taps}) WHERE w <> 0 GROUP BY ox, oy, x, y)"""


def _zoom_cte(name: str, f: float, n: int = N) -> str:
    m = round(n * f)
    if m >= n:
        line = f"o + {(m - n) // 2}"
    else:
        e, p = f"o - {(n - m) // 2}", 2 * m - 2
        line = f"CASE WHEN (({e}) % {p} + {p}) % {p} < {m} THEN (({e}) % {p} + {p}) % {p} ELSE {p} - (({e}) % {p} + {p}) % {p} END"
    return f"""{name}l AS (SELECT o, ({line}) * {_num((n - 1) / (m - 1))} AS s FROM (SELECT CAST(unnest(generate_series(0, {n - 1})) AS INTEGER) AS o)),
{name}w AS (SELECT o, i, sum(w) AS w FROM (SELECT o, CAST(floor(s) AS INTEGER) AS i, 1 - (s - floor(s)) AS w FROM {name}l UNION ALL SELECT o, CAST(least(floor(s) + 1, {n - 1}) AS INTEGER), s - floor(s) FROM {name}l) WHERE w <> 0 GROUP BY o, i),
{name} AS (SELECT a.o AS ox, b.o AS oy, a.i AS x, b.i AS y, a.w * b.w AS w FROM {name}w a CROSS JOIN {name}w b)"""


def _apply_sql(table: str, deg: float = 0.0, wind: bool = True) -> str:
    c, s = math.cos(math.radians(deg)), math.sin(math.radians(deg))
    src = "tile" if not deg or not wind else (f"(SELECT sample_id, channel, x, y, value FROM tile WHERE channel = 'pm' UNION ALL SELECT sample_id, 'u', x, y, value * {_num(c)} FROM tile WHERE channel = 'u' UNION ALL SELECT sample_id, 'u', x, y, value * {_num(-s)} FROM tile WHERE channel = 'v' "
                                  f"UNION ALL SELECT sample_id, 'v', x, y, value * {_num(s)} FROM tile WHERE channel = 'u' UNION ALL SELECT sample_id, 'v', x, y, value * {_num(c)} FROM tile WHERE channel = 'v')")
    twice = "CASE WHEN channel = 'pm' THEN 1 ELSE 2 END" if deg and wind else "1"
    return f"""SELECT sample_id, channel, r.ox AS x, r.oy AS y, CASE WHEN count(t.value) = any_value(r.n) * {twice} THEN {s6('sum(t.value * r.w)')} END AS value FROM {src} t JOIN (SELECT *, count(*) OVER (PARTITION BY ox, oy) AS n FROM {table}) r ON r.x = t.x AND r.y = t.y GROUP BY sample_id, channel, r.ox, r.oy"""


def _labelled(rows):
    return rounded(rows, "value").withColumn("variant", X.variant_label()).drop("degrees", "factor")


@query("x9_rotation", f"+ {_TILE}, " + ", ".join(_rot_cte(f"r{a}", a) for a in X.ANGLES) + " " + " UNION ALL ".join(f"SELECT *, 'rot{a}' AS variant FROM ({_apply_sql(f'r{a}', a)})" for a in X.ANGLES))
def _(t: Tables):
    return _labelled(X.rotated(_tile(t), N, X.ANGLES, WIND))


@query("x10_zoom", f"+ {_TILE}, {_zoom_cte('zi', 1.2)}, {_zoom_cte('zo', 0.8)} SELECT *, 'zoom-in-1.2x' AS variant FROM ({_apply_sql('zi')}) UNION ALL SELECT *, 'zoom-out-0.8x' FROM ({_apply_sql('zo')})")
def _(t: Tables):
    return _labelled(X.zoomed(_tile(t), N, (1.2, 0.8)))


@query("x11_rotation_then_zoom", f"+ {_TILE}, {_rot_cte('r', 135)}, {_zoom_cte('z', 0.8)}, rz AS (SELECT z.ox, z.oy, r.x, r.y, sum(z.w * r.w) AS w FROM z JOIN r ON r.ox = z.x AND r.oy = z.y GROUP BY z.ox, z.oy, r.x, r.y) {_apply_sql('rz', 135)}")
def _(t: Tables):
    return rounded(X.rotated_zoomed(_tile(t), N, (135,), (0.8,), WIND), "value").drop("degrees", "factor")




def _union_sql(tile: str = _TILE, channels=("pm", "u", "v")) -> str:
    wind = "u" in channels
    ctes = [_rot_cte(f"r{a}", a) for a in X.ANGLES] + [_zoom_cte(z.replace(".", ""), f) for z, f in X.ZOOM_SUFFIX]
    parts = [_remap_sql(v, wind=wind, channels=channels) for v in X.EXACT] + [f"SELECT 'rot{a}' AS variant, * FROM ({_apply_sql(f'r{a}', a, wind)})" for a in X.ANGLES]
    for (label, _), (z, _) in zip(X.ZOOMS, X.ZOOM_SUFFIX):
        parts.append(f"SELECT '{label}' AS variant, * FROM ({_apply_sql(z.replace('.', ''))})")
    for a in X.ANGLES:
        for z, _ in X.ZOOM_SUFFIX:
            zt = z.replace(".", "")
            ctes.append(f"c{a}{zt} AS (SELECT z.ox, z.oy, r.x, r.y, sum(z.w * r.w) AS w FROM {zt} z JOIN r{a} r ON r.ox = z.x AND r.oy = z.y GROUP BY z.ox, z.oy, r.x, r.y)")
            parts.append(f"SELECT 'rot{a}_{z}' AS variant, * FROM ({_apply_sql(f'c{a}{zt}', a, wind)})")
    order = ", ".join(f"'{v}'" for v in X.VARIANTS)
    return f"+ {tile}, " + ", ".join(ctes) + f" SELECT *, CAST(list_position([{order}], variant) - 1 AS INTEGER) AS variant_no FROM (" + " UNION ALL ".join(parts) + ")"


@query("x12_variant_union", _union_sql())
def _(t: Tables):
    return rounded(X.all_variants(_tile(t), N, WIND), "value")


_LABELS = ", ".join(f"({i}, '{v}')" for i, v in enumerate(X.VARIANTS))


@query("x12_variant_offsets", f"+ {_TILE}, v(variant_no, variant) AS (VALUES {_LABELS}) SELECT variant_no, variant, variant_no * (SELECT count(DISTINCT sample_id) FROM tile) AS first_row FROM v")
def _(t: Tables):
    return X.variant_offsets(_tile(t))
