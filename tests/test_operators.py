"""Operators against brute force, with hot keys, gaps, ties and boundaries."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hourgrid.functions import columns as C, kernels
from hourgrid.functions.quantiles import exact_quantiles
from hourgrid.functions.series import nowcast_value
from hourgrid.operators import alignment as J, augment as X, cleaning as K, fills as T, gridding as G, interpolate as I, raster as R
from hourgrid.operators import samples as S, scoring as M, stats as A
from hourgrid.workload.base import Tables
from tests.conftest import SMALL

T0 = dt.datetime(2024, 1, 1)
hours = lambda k: T0 + dt.timedelta(hours=k)


def test_quantiles_of_a_hot_key(spark):
    rng = np.random.default_rng(3)
    hot = np.round(rng.lognormal(2, 1, 20000), 2)
    cold = np.array([5.0, 1.0])
    data = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("cold", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    out = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for name, values in (("hot", hot), ("cold", cold)):
        for n, p in probs.items():
            assert out[name][n] == pytest.approx(np.quantile(values, p), abs=1e-9)
    total = exact_quantiles(df, [], "v", probs).first()
    assert total.c == pytest.approx(np.quantile(np.concatenate([hot, cold]), 0.5))


def test_quantiles_rank_only_what_lies_near(spark):
    """A key of many distinct values comes down to a few rows before anything is ordered."""
    df = spark.range(400_000).selectExpr("id % 100 = 0 AS k", "cast(pmod(xxhash64(id), 1000003) as double) + id * 1e-7 AS v")
    out = A.describe(df, ["k"], "v")
    got = {r.k: r for r in out.collect()}
    for k in (True, False):
        values = np.array([r.v for r in df.where(F.col("k") == k).collect()])
        assert [got[k][c] for c in ("p25", "p50", "p75")] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), abs=1e-9)
        assert got[k].n == len(values) and got[k]["std"] == pytest.approx(values.std(ddof=1))
    skewed = spark.createDataFrame([("one", 3.0)] * 1000 + [("one", 4.0)] * 999 + [("two", None)] + [("three", float(i)) for i in range(3)], "k string, v double")
    rows_of = {r.k: r for r in A.describe(skewed, ["k"], "v").collect()}
    assert (rows_of["one"].p50, rows_of["one"].p75, rows_of["two"].p50, rows_of["two"].n, rows_of["three"].p25) == (3.0, 4.0, None, 0, 0.5)
    assert A.describe(skewed, [], "v").first().n == 2002 and A.describe(skewed.limit(0), [], "v").first().p50 is None


def test_rows_of_a_hot_key_are_not_sorted_to_meet_their_quantiles(spark):
    """However large the input looks to the planner, its rows meet a few groups where they are."""
    df = spark.range(3_000_000).selectExpr("if(id < 0, 'two', 'one') AS k", "cast(id % 1001 AS double) AS v")
    for out in (exact_quantiles(df, ["k"], "v", A.QUARTILES), A.box_stats(df, ["k"], "v")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert (out.first().p25, out.first().p50, out.first().p75) == (250.0, 500.0, 750.0)


def test_cap_and_uptime_at_equality(spark, rows):
    df = spark.createDataFrame([(1, 10.0), (2, 10.1), (3, None)], "sensor_id int, value double")
    got = rows(df.select("sensor_id", C.cap_to_null("value", 10.0).alias("a"), C.cap_to_null("value", 10.0, inclusive=True).alias("b")))
    assert got == [(1, 10.0, None), (2, None, None), (3, None, None)]
    obs = spark.createDataFrame([(s, hours(h), 1.0) for s, n in ((1, 4), (2, 1)) for h in range(n)], "sensor_id int, ts timestamp_ntz, value double")
    assert rows(K.min_uptime_rows(obs, 0.25).select("sensor_id").distinct()) == [(1,)]                  # strictly above
    full = T.hour_scaffold(obs, "2024-01-01 00:00:00", "2024-01-01 04:00:00")
    assert rows(K.min_uptime_share(full, 0.25).select("sensor_id").distinct()) == [(1,), (2,)]           # at the bar stays
    assert rows(K.enough_hours(obs, "2024-01-01 00:00:00", "2024-01-01 04:00:00", 0.25)) == [(1,), (2,)]


def test_extent_check():
    for bad in ((1, 0, 0, 1), (0, 1, 1, 0), (-181, 0, 0, 1), (0, 1, 0, 91)):
        with pytest.raises(ValueError):
            C.check_extent(bad)


def test_resolve_columns_needs_a_synonym(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, pblh double")
    assert K.resolve_columns(df, {"height": ["PBLH2", "pblh"]}).columns == ["id", "height"]
    with pytest.raises(ValueError):
        K.resolve_columns(df, {"height": ["zi"]})


def test_round_and_ceil_hours(spark, rows):
    times = [(1, dt.datetime(2024, 1, 1, 0, 30)), (2, dt.datetime(2024, 1, 1, 1, 30)), (3, dt.datetime(2024, 1, 1, 0, 30, 0, 1)),
             (4, dt.datetime(2024, 1, 1, 2, 0)), (5, dt.datetime(2024, 1, 1, 23, 59, 59))]
    df = spark.createDataFrame(times, "i int, ts timestamp_ntz")
    got = rows(df.select("i", C.hour_round("ts"), C.hour_ceil("ts")))
    assert [r[1] for r in got] == [pd.Timestamp(t).round("h").to_pydatetime() for _, t in times]
    assert [r[2] for r in got] == [pd.Timestamp(t).ceil("h").to_pydatetime() for _, t in times]


def test_scaffold_has_every_hour_once(spark):
    obs = spark.createDataFrame([(1, hours(3), 1.0, "a"), (1, hours(7), 2.0, "b"), (2, hours(0), 3.0, "c"), (3, hours(99), 4.0, "d")],
                                "sensor_id int, ts timestamp_ntz, value double, site string")
    out = T.hour_scaffold(obs, "2024-01-01", "2024-01-02").toPandas()
    assert out.groupby("sensor_id").ts.nunique().to_dict() == {1: 24, 2: 24} and len(out) == 48
    assert sorted(out.dropna().site) == ["a", "b", "c"]
    filled = T.fill_series(T.hour_scaffold(obs, "2024-01-01", "2024-01-02"), ["value"]).where("sensor_id = 1").orderBy("ts").toPandas()
    assert filled.value.tolist() == [1.0] * 7 + [2.0] * 17


def test_leading_frames(spark, rows):
    grid = spark.createDataFrame([(hours(2), 0, 0, 5.0), (hours(4), 0, 0, None)], "ts timestamp_ntz, x int, y int, value double")
    axis = T.hours_axis(spark, "2024-01-01 00:00:00", "2024-01-01 06:00:00")
    full = rows(T.carry_frames(grid, axis), "ts", "value")
    assert full == [(hours(k), 5.0) for k in range(6)]
    strict = rows(T.carry_frames(grid, axis, "first"), "ts")
    assert strict == [(hours(k),) for k in (0, 2, 3, 4, 5)]


def test_status_of_every_hour(spark, rows):
    axis = T.hours_axis(spark, "2024-01-01 00:00:00", "2024-01-01 06:00:00")
    granules = spark.createDataFrame([(hours(1), False), (hours(2), True), (hours(3), False), (hours(5), True)], "ts timestamp_ntz, ok boolean")
    got = [s for _, s in rows(T.fill_status(axis, granules), "ts", "status")]
    assert got == ["zero_no_prior", "zero_no_prior", "valid", "forward_fill_bad_qa", "forward_fill_missing", "valid"]


@pytest.mark.parametrize("have", [[0, 4, 9], [2, 3, 7], [5], [1, 2, 4, 8]])
def test_day_gaps_equal_the_in_place_rule(spark, rows, have):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(10)]
    values = {k: float(3 * k * k + 1) for k in have}
    grid = spark.createDataFrame([(days[k], 0, 0, v) for k, v in values.items()], "day date, x int, y int, value double")
    axis = spark.createDataFrame([(d,) for d in days], "day date")
    got = [v for _, v in rows(T.fill_day_gaps(grid, axis), "day", "value")]
    for k in range(10):                                               # earlier fills count as neighbours
        if k not in values:
            before = next((values[j] for j in range(k - 1, -1, -1) if j in values), None)
            after = next((values[j] for j in range(k + 1, 10) if j in have), None)
            values[k] = (before + after) / 2 if before is not None and after is not None else (before if after is None else after)
    assert got == pytest.approx([values[k] for k in range(10)])


def test_nearest_report_against_pandas(spark):
    rng = np.random.default_rng(5)
    reports = []
    for s in range(3):
        minutes = sorted(set(int(m) for m in rng.integers(0, 48 * 60, 40)) | {30, 90, 150})
        reports += [(s, T0 + dt.timedelta(minutes=m), float(m)) for m in minutes]
    df = spark.createDataFrame(reports, "station int, valid timestamp_ntz, value double")
    slots = df.select("station").distinct().withColumn("ts", T.each_hour("2024-01-01", "2024-01-03"))
    got = J.nearest_report(slots, df, ["station"], ["value"]).toPandas().set_index(["station", "ts"]).value
    for s, part in pd.DataFrame(reports, columns=["station", "valid", "value"]).groupby("station"):
        want = part.set_index("valid").value.reindex(pd.date_range(T0, periods=48, freq="h"), method="nearest")
        assert got.loc[s].sort_index().tolist() == want.tolist()


def test_step_function_clamps_and_steps(spark, rows):
    axis = T.hours_axis(spark, "2024-01-01 00:00:00", "2024-01-01 05:00:00")
    acq = spark.createDataFrame([(hours(1),), (hours(3),)], "acq_ts timestamp_ntz")
    assert [a for _, a in rows(J.step_function(axis, acq))] == [hours(1), hours(1), hours(1), hours(3), hours(3)]


@pytest.mark.parametrize("k, use_z", [(1, False), (4, False), (50, False), (4, True)])
def test_idw_against_brute_force(spark, k, use_z):
    rng, dim = np.random.default_rng(9), 7
    data, frames = [], {}
    for f in range(3):
        cells = rng.choice(dim * dim, 9, replace=False)
        frames[f] = {int(c): float(v) for c, v in zip(cells, rng.uniform(1, 99, 9))}
        data += [(f, c // dim, c % dim, v) for c, v in frames[f].items()]
    z = rng.uniform(0, 5, dim * dim) if use_z else np.zeros(dim * dim)
    layer = spark.createDataFrame([(c // dim, c % dim, float(z[c])) for c in range(dim * dim)], "x int, y int, value double") if use_z else None
    out = I.idw(spark.createDataFrame(data, "ts int, x int, y int, value double"), dim, 2.0, k, layer).collect()
    assert len(out) == 3 * dim * dim
    for r in out:
        pts = frames[r.ts]
        c = r.x * dim + r.y
        if c in pts:
            assert r.value == pts[c]
            continue
        near = sorted(((math.sqrt((r.x - p // dim) ** 2 + (r.y - p % dim) ** 2 + (z[c] - z[p]) ** 2), p) for p in pts))[:k]
        assert r.value == pytest.approx(sum(pts[p] / d ** 2 for d, p in near) / sum(1 / d ** 2 for d, p in near))


def test_nearest_point_with_empty_regions_and_outside_points(spark):
    rng, dim, extent = np.random.default_rng(2), 9, (0.0, 8.0, 0.0, 8.0)
    clouds = {0: rng.uniform(0, 2, (30, 2)), 1: np.array([[-3.0, 11.0]]), 2: rng.uniform(-2, 10, (200, 2)), 3: np.array([[7.9, 7.9], [-1.0, -1.0]])}
    data = [(f, i, float(lat), float(lon), float(i)) for f, pts in clouds.items() for i, (lat, lon) in enumerate(pts)]
    out = I.nearest_point(spark.createDataFrame(data, "ts int, pid int, lat double, lon double, value double"), extent, dim, "pid").collect()
    assert len(out) == 4 * dim * dim
    for r in out:
        pts = clouds[r.ts]
        d = (pts[:, 0] - (8 - r.x)) ** 2 + (pts[:, 1] - r.y) ** 2
        assert d[int(r.value)] == pytest.approx(d.min(), abs=1e-9)


def test_fill_nearest_against_brute_force():
    rng, dim = np.random.default_rng(1), 11
    points = np.sort(rng.choice(dim * dim, 13, replace=False))
    values = rng.uniform(0, 1, 13)
    out = kernels.nearest_frame(points, values, dim)
    for c in range(dim * dim):
        key = [((c // dim - p // dim) ** 2 + (c % dim - p % dim) ** 2, p) for p in points]
        assert out[c] == values[key.index(min(key))]


def test_kriging_passes_through_sensors_and_solves_the_system(spark):
    rng, dim = np.random.default_rng(4), 8
    points = np.sort(rng.choice(dim * dim, 12, replace=False))
    res = np.sin(points / 9.0) * 5 + rng.normal(0, 0.1, 12)
    field = kernels.kriging_frame(points, res, dim, 10, 3, 25)
    assert field[points] == pytest.approx(res, abs=1e-6)                      # no nugget: exact at the sensors
    sill, reach = kernels.fit_exponential(*kernels.variogram(points, res, dim, 10))
    gamma = lambda h: sill * (1 - np.exp(-3 * h / reach))
    xy = np.column_stack([points // dim, points % dim]).astype(float)
    cell = next(c for c in range(dim * dim) if c not in points)
    d = np.linalg.norm(xy - [cell // dim, cell % dim], axis=1)
    near = d <= reach
    if near.sum() >= 3:
        m = near.sum()
        a = np.block([[gamma(np.linalg.norm(xy[near][:, None] - xy[near][None], axis=2)), np.ones((m, 1))], [np.ones((1, m)), np.zeros((1, 1))]])
        w = np.linalg.lstsq(a, np.append(gamma(d[near]), 1), rcond=None)[0][:m]
        assert field[cell] == pytest.approx(w @ res[near], abs=1e-6)
    model = spark.createDataFrame([(0, c // dim, c % dim, 10.0) for c in range(dim * dim)], "ts int, x int, y int, value double")
    sensors = spark.createDataFrame([(0, int(p // dim), int(p % dim), float(10 + v)) for p, v in zip(points, res)], "ts int, x int, y int, value double")
    out = np.zeros(dim * dim)
    for r in I.residual_kriging(sensors, model, dim).collect():
        out[r.x * dim + r.y] = r.value
    assert out == pytest.approx(field + 10)
    assert kernels.kriging_frame(points[:2], res[:2], dim, 10, 3, 25).tolist() == [0.0] * (dim * dim)   # too few points


def test_variogram_against_all_pairs():
    rng, dim = np.random.default_rng(8), 6
    points, values = np.sort(rng.choice(36, 10, replace=False)), rng.uniform(0, 9, 10)
    h, n, g = kernels.variogram(points, values, dim, 5)
    pairs = [(math.hypot(a // dim - b // dim, a % dim - b % dim), (u - v) ** 2) for i, (a, u) in enumerate(zip(points, values)) for b, v in list(zip(points, values))[i + 1:]]
    far = max(d for d, _ in pairs)
    assert n.sum() == 45
    for k in range(5):
        part = [s for d, s in pairs if min(int(d / far * 5), 4) == k]
        assert n[k] == len(part) and g[k] == pytest.approx(sum(part) / (2 * len(part)) if part else 0.0)


def test_full_frame_variogram():
    rng, dim = np.random.default_rng(3), 84
    points, values = np.arange(dim * dim), 1e4 + rng.normal(0, 2, dim * dim)
    began = time.process_time()
    h, n, g = kernels.variogram(points, values, dim, 10)
    assert time.process_time() - began < 1
    assert n.sum() == dim ** 2 * (dim ** 2 - 1) // 2
    d2, pairs, sums = kernels.pair_sums(points, values, dim)
    field = values.reshape(dim, dim)
    right = ((field[:, 1:] - field[:, :-1]) ** 2).sum() + ((field[1:] - field[:-1]) ** 2).sum()
    assert pairs[d2 == 1].sum() == 2 * dim * (dim - 1) and sums[d2 == 1].sum() == pytest.approx(right, rel=1e-9)


def test_clusters_of_distance_against_all_cuts():
    rng = np.random.default_rng(9)
    for m, k in [(1, 1), (3, 5), (7, 3), (9, 4), (6, 6)]:
        x, w = np.sort(rng.choice(40, m, replace=False)).astype(float), rng.integers(1, 9, m).astype(float)
        error = lambda a, b: (w[a:b] * (x[a:b] - np.average(x[a:b], weights=w[a:b])) ** 2).sum()
        every = [(0, *c) for c in itertools.combinations(range(1, m), min(k, m) - 1)]
        cost = lambda c: sum(error(a, b) for a, b in zip(c, (*c[1:], m)))
        found = tuple(kernels.best_cuts(x, w, k))
        assert found in every and cost(found) == pytest.approx(min(map(cost, every)))
    assert kernels.best_cuts(np.array([1.0, 2, 3, 4]), np.ones(4), 3).tolist() == [0, 1, 2]        # equally good: the earliest last run
    points = np.array([0, 1, 3, 12, 31])
    h, n, g = kernels.variogram(points, points * 1.0, 6, 3, "cluster")
    assert len(h) == 3 and n.sum() == 10 and (np.diff(h) > 0).all()
    with pytest.raises(ValueError):
        kernels.variogram(points, points * 1.0, 6, 3, "other")


def test_kriging_of_the_given_readings_by_an_independent_solve(spark):
    t = Tables(spark, SMALL)
    model = G.each_cell(t.frame.groupBy("ts").agg(F.avg("value").alias("_m")), 8).selectExpr("ts", "x", "y", "_m + x * 0.5D AS value").persist()
    frame = t.frame.persist()
    out = {(r.ts, r.x, r.y): r.value for r in I.residual_kriging(frame, model, 8).collect()}
    base = {(r.ts, r.x, r.y): r.value for r in model.collect()}
    sensors = {}
    for r in frame.collect():
        sensors.setdefault(r.ts, {})[(r.x, r.y)] = r.value - base[(r.ts, r.x, r.y)]
    tried = 0
    for ts, res in sorted(sensors.items()):
        cells = sorted(res)
        if len(cells) < 3 or len(set(res.values())) == 1:
            continue
        d = {(a, b): math.dist(a, b) for a in cells for b in cells}
        pairs = [(d[a, b], (res[a] - res[b]) ** 2) for i, a in enumerate(cells) for b in cells[i + 1:]]
        far = max(p[0] for p in pairs)
        lag = lambda x: min(int(x / far * 10), 9)
        bins = {k: [s for x, s in pairs if lag(x) == k] for k in range(10)}
        h, g = zip(*[(far * (k + 1) / 10, sum(v) / (2 * len(v))) for k, v in bins.items() if v])
        fits = []
        for reach in max(h) * np.linspace(0.02, 1.0, 200):
            b = [1 - math.exp(-3 * x / reach) for x in h]
            sill = sum(p * q for p, q in zip(b, g)) / sum(p * p for p in b)
            fits.append((sum((sill * p - q) ** 2 for p, q in zip(b, g)), sill, reach))
        least = min(f[0] for f in fits)
        _, sill, reach = next(f for f in fits if f[0] <= least + 1e-9 * sum(q * q for q in g))
        gamma = lambda x: sill * (1 - math.exp(-3 * x / reach))
        for cell in itertools.product(range(8), repeat=2):
            near = [c for c in cells if sum((p - q) ** 2 for p, q in zip(c, cell)) <= reach ** 2]
            want = 0.0
            if len(near) >= 3:
                a = np.array([[gamma(d[p, q]) for q in near] + [1.0] for p in near] + [[1.0] * len(near) + [0.0]])
                if np.linalg.cond(a) > 1e8:
                    continue
                w = np.linalg.lstsq(a, np.array([gamma(math.dist(p, cell)) for p in near] + [1.0]), rcond=None)[0]
                want, tried = sum(u * res[p] for u, p in zip(w, near)), tried + 1
            assert out[(ts, *cell)] - base[(ts, *cell)] == pytest.approx(want, abs=1e-5)
    assert tried > 100


def test_resize_rules(spark):
    frame = np.arange(12.0).reshape(3, 4) ** 1.5
    df = spark.createDataFrame([(0, int(i), int(j), float(frame[i, j])) for i in range(3) for j in range(4)], "ts int, x int, y int, value double")
    for rule in ("half_pixel", "corner"):
        out = {(r.x, r.y): r.value for r in R.resize(df, (3, 4), 5, rule).collect()}
        for a in range(5):
            for b in range(5):
                src = [(o + 0.5) * n / 5 - 0.5 if rule == "half_pixel" else o * (n - 1) / 4 for o, n in ((a, 3), (b, 4))]
                src = [min(max(s, 0), n - 1) for s, n in zip(src, (3, 4))]
                i, j = int(src[0]), int(src[1])
                u, v = src[0] - i, src[1] - j
                i2, j2 = min(i + 1, 2), min(j + 1, 3)
                want = (1 - u) * ((1 - v) * frame[i, j] + v * frame[i, j2]) + u * ((1 - v) * frame[i2, j] + v * frame[i2, j2])
                assert out[a, b] == pytest.approx(want)
    holed = df.withColumn("value", F.when(~((F.col("x") == 0) & (F.col("y") == 0)), F.col("value")))
    missing = {(r.x, r.y) for r in R.resize(holed, (3, 4), 5).collect() if r.value is None}
    assert (0, 0) in missing and (4, 4) not in missing


@pytest.mark.parametrize("n, n_in, n_out, stride, chunk", [(100, 5, 5, 1, 7), (100, 5, 5, 5, 16), (40, 24, 12, 1, 8), (30, 1, 1, 3, 4)])
def test_windows_across_chunk_borders(spark, n, n_in, n_out, stride, chunk):
    frames = spark.createDataFrame([("a", i, [float(i), float(-i)]) for i in range(n)], "channel string, ts_idx bigint, frame array<double>")
    out = {r.sample_id: r for r in S.sliding_windows(frames, n_in, n_out, stride, chunk=chunk).collect()}
    assert sorted(out) == list(range((n - n_in - n_out) // stride + 1))
    for k, r in out.items():
        assert [f[0] for f in r.x_frames] == [float(k * stride + j) for j in range(n_in)]
        assert [f[0] for f in r.y_frames] == [float(k * stride + n_in + j) for j in range(n_out)]


def test_series_too_short_for_a_window(spark):
    frames = spark.createDataFrame([("a", i, [1.0]) for i in range(5)], "channel string, ts_idx bigint, frame array<double>")
    with pytest.raises(Exception, match="shorter than one window"):
        S.sliding_windows(frames, 4, 2).collect()


def test_split_cuts_truncate(spark):
    df = spark.range(720).withColumnRenamed("id", "i")
    got = {r.split: r["count"] for r in S.temporal_split(df, "i", 720).groupBy("split").count().collect()}
    assert got == {"train": int(720 * 0.7), "valid": int(720 * 0.85) - int(720 * 0.7), "test": 720 - int(720 * 0.85)}
    with pytest.raises(ValueError):
        S.temporal_split(df, "i", 720, (("a", 0.5), ("b", 0.4)))


def test_constant_channel_scales_by_one(spark):
    df = spark.createDataFrame([("c", "train", 4.0), ("c", "test", 6.0)], "channel string, split string, value double")
    got = {r.split: r.value for r in S.apply_scalers(df, S.fit_scalers(df)).collect()}
    assert got == {"train": 0.0, "test": 2.0}


def test_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "sample_id")
    assert S.batch_index(df, 4).select("batch").distinct().count() == 3
    assert S.batch_index(df, 4, drop_remainder=True).count() == 8


@pytest.mark.parametrize("name, turn", [
    ("h-flip", lambda f: f[:, ::-1]), ("v-flip", lambda f: f[::-1]), ("hv-flip", lambda f: f[::-1, ::-1]), ("rot90", lambda f: np.rot90(f, 1)),
    ("rot270", lambda f: np.rot90(f, 3)), ("transpose", lambda f: f.T), ("anti-transpose", lambda f: f.T[::-1, ::-1])])
def test_exact_remaps_equal_numpy(spark, name, turn):
    n = 5
    f = {c: np.arange(25.0).reshape(n, n) * s + 1 for c, s in (("pm", 1), ("u", 3), ("v", -2))}
    data = [(0, c, i, j, float(a[i, j])) for c, a in f.items() for i in range(n) for j in range(n)]
    df = spark.createDataFrame(data, "sample_id int, channel string, x int, y int, value double")
    out = {c: np.zeros((n, n)) for c in f}
    for r in X.exact_variants(df, n, (("u", "v"),), variants=[name]).collect():
        out[r.channel][r.x, r.y] = r.value
    assert (out["pm"] == turn(f["pm"])).all()
    # The vector turns with the field: a unit step east must land on the image of "one column to the right".
    probe = np.zeros((3, 3)); probe[1, 2] = 1
    (px,), (py,) = np.where(turn(probe) == 1)
    east = (int(py) - 1, 1 - int(px))                                # (u, v) image of the unit eastward vector
    probe = np.zeros((3, 3)); probe[0, 1] = 1
    (px,), (py,) = np.where(turn(probe) == 1)
    north = (int(py) - 1, 1 - int(px))
    assert (out["u"] == turn(f["u"]) * east[0] + turn(f["v"]) * north[0]).all()
    assert (out["v"] == turn(f["u"]) * east[1] + turn(f["v"]) * north[1]).all()


def test_rotation_of_a_constant_field_is_constant(spark):
    n = 6
    df = spark.createDataFrame([(0, c, i, j, v) for c, v in (("pm", 7.0), ("u", 1.0), ("v", 0.0)) for i in range(n) for j in range(n)],
                               "sample_id int, channel string, x int, y int, value double")
    out = X.all_variants(df, n, (("u", "v"),))
    assert out.select("variant").distinct().count() == 21 == len(X.VARIANTS)
    assert out.count() == 21 * 3 * n * n
    assert out.where("channel = 'pm' and abs(value - 7) > 1e-9").count() == 0
    r = out.where("variant = 'rot45' and channel = 'v' and x = 2 and y = 2").first()
    assert r.value == pytest.approx(math.sqrt(0.5))


def test_smoothing_holds_and_fades(spark):
    values = [0.0, 4.0, 0.0, 2.0]
    df = spark.createDataFrame([("c", hours(k), 0, 0, v) for k, v in enumerate(values)], "channel string, ts timestamp_ntz, x int, y int, value double")
    hold = [r.value for r in T.recursive_smooth(df, 0.2).orderBy("ts").collect()]
    fade = [r.value for r in T.recursive_smooth(df, 0.3, 0.9, "max").orderBy("ts").collect()]
    assert hold == pytest.approx([0, 4, 4, 4 * 0.2 + 2 * 0.8]) and fade == pytest.approx([0, 4, 3.6, 3.6 * 0.3 + 2 * 0.7])


def test_matrix_margins_are_means_of_cells(spark):
    data = [("a", 1, 0.0, 1.0), ("a", 2, 0.0, 3.0), ("b", 1, 0.0, 2.0), ("b", 2, 0.0, 0.0)]
    df = spark.createDataFrame(data, "sensor_id string, horizon int, y_true double, y_pred double")
    out = {r.sensor_id: r for r in M.rmse_matrix(df, (1, 2)).collect()}
    assert (out["a"].mean_rmse, out["all"].h1, out["all"].mean_rmse) == (2.0, 1.5, 1.5)


def test_metrics_of_constant_truth(spark):
    df = spark.createDataFrame([(2.0, 3.0), (2.0, 1.0)], "y_true double, y_pred double")
    r = M.score(df).first()
    assert (r.rmse, r.mae, r.r2, r.nrmse) == (1.0, 1.0, None, 50.0)


def test_active_window_needs_activity(spark):
    grid = spark.createDataFrame([(hours(1), 0, 0, 0.0)], "ts timestamp_ntz, x int, y int, value double")
    with pytest.raises(Exception, match="no activity"):
        A.active_window(grid, F.lit(True)).collect()
    assert [tuple(r) for r in A.active_window(grid, F.lit(True), required=False).collect()] == [(None, None)]


def test_active_window_query_without_activity(spark, tmp_path):
    """Means that never pass the threshold are the query's usual case on large tables: its SQL gives a row of NULLs."""
    rows = spark.createDataFrame([(k, k, hours(24 * 8 + k), "view", 100.0 + k) for k in range(5)], "event_id long, user_id long, ts timestamp_ntz, event_type string, value double")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in entry.queries()["a15_active_window"](spark, str(tmp_path)).collect()] == [(None, None)]


def test_scalar_nowcast_equals_the_column_rule(spark):
    rng = np.random.default_rng(6)
    values = [None if rng.random() < 0.3 else round(float(rng.uniform(0, 40)), 1) for _ in range(200)]
    df = spark.createDataFrame([(1, hours(k), v) for k, v in enumerate(values)], "sensor_id int, ts timestamp_ntz, value double")
    got = [r.nowcast for r in T.nowcast(df).orderBy("ts").collect()]
    assert got == [nowcast_value(values[max(0, k - 11):k + 1]) for k in range(200)]


def test_collisions_keep_the_reference(spark, rows):
    df = spark.createDataFrame([(1, "ref", 0, 0), (2, "low", 0, 0), (3, "low", 1, 1), (4, None, 2, 2)], "sensor_id int, provider string, x int, y int")
    assert rows(J.drop_colliding(df, F.col("provider") == "ref"), "sensor_id") == [(1,), (3,), (4,)]


def test_mean_spacing_telescopes(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (2.5,), (4.0,)], "c double")
    assert G.mean_spacing(df, "c").first().spacing == pytest.approx(1.5)
