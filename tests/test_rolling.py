"""Sums over moving frames against sums taken row by row."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from hourgrid.functions import rolling
from hourgrid.operators import fills as T, scoring as M


def _table(spark, seed):
    rnd = random.Random(seed)
    out = []
    for k in ("a", "b", None):
        for p in range(-40, 420):
            if rnd.random() < 0.2 or 100 < p < 260 and k == "b":
                continue                                                # gaps, one longer than a frame
            for _ in range(2 if rnd.random() < 0.1 else 1):             # repeated positions
                v = None if rnd.random() < 0.15 else rnd.choice([1e12, -1e12, 0.1, 3.0]) if rnd.random() < 0.1 else rnd.uniform(-5, 5)
                out.append((len(out), k, p, v))
    out += [(len(out), "a", None, 2.0), (len(out) + 1, "c", 7, None)]
    return out, spark.createDataFrame(out, "id long, k string, p long, v double")


@pytest.mark.parametrize("first,last", [(-167, 0), (0, 129), (-120, -1), (3, 110), (-60, 60), (-6, 0), (-5, -1), (2, 2)])
def test_frame_sums_equal_brute_force(spark, first, last):
    rows, df = _table(spark, 5)
    got = {r.id: r.s for r in rolling.frame_sums(df, ["k"], "p", first, last, {"s": F.col("v")}).collect()}
    assert len(got) == len(rows)
    for i, k, p, _ in rows:
        inside = [v for _, k2, q, v in rows if k2 == k and p is not None and q is not None and p + first <= q <= p + last and v is not None]
        assert got[i].n == len(inside)
        if inside:
            assert got[i].total == pytest.approx(math.fsum(inside), rel=1e-12, abs=1e-2 if any(abs(v) > 1e9 for v in inside) else 1e-9)
        else:
            assert got[i].total is None


def test_values_outside_a_frame_leave_no_trace(spark):
    """A running sum less an earlier one would lose the small values, and keep the NaN for good."""
    rows = [(p, 1e17 if p == 10 else math.nan if p == 300 else 0.25) for p in range(600)]
    df = spark.createDataFrame(rows, "p long, v double").withColumn("k", F.lit(1))
    got = {r.p: r.s for r in rolling.frame_sums(df, ["k"], "p", -99, 0, {"s": F.col("v")}).collect()}
    for p in range(600):
        inside = [v for q, v in rows if p - 99 <= q <= p]
        if any(math.isnan(v) for v in inside):
            assert math.isnan(got[p].total)
        elif 1e17 not in inside:
            assert got[p].total == 0.25 * len(inside)
    with pytest.raises(ValueError):
        rolling.frame_sums(df, ["k"], "p", 1, 0, {"s": F.col("v")})


def test_no_frame_of_the_plan_grows_with_the_width(spark):
    df = spark.range(10).select(F.lit(1).alias("sensor_id"), F.col("id").alias("ts"), F.rand().alias("value"))
    plan = T.rolling_mean(df, 720)._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, -719" not in plan and "RangeFrame, -719" not in plan


def test_long_frames_of_the_operators(spark):
    rnd = random.Random(3)
    obs = [(s, h, None if rnd.random() < 0.01 else rnd.uniform(0, 9)) for s in (1, 2) for h in range(500)]
    df = spark.createDataFrame(obs, "sensor_id long, ts long, value double")
    by = {(s, h): v for s, h, v in obs}
    for n in (7, 168):
        for r in T.rolling_mean(df, n, out="m").collect():
            inside = [by.get((r.sensor_id, h)) for h in range(r.ts - n + 1, r.ts + 1)]
            want = None if None in inside else math.fsum(inside) / n
            assert (r.m is None) == (want is None) and (want is None or r.m == pytest.approx(want, rel=1e-12))
    pairs = [(1, i, rnd.uniform(1, 9), rnd.uniform(1, 9)) for i in range(400)]
    weeks = M.extreme_weeks(spark.createDataFrame(pairs, "sensor_id long, sample_id long, y_true double, y_pred double"), 168).first()
    score = lambda i: math.sqrt(sum((p - t) ** 2 for _, _, t, p in pairs[i:i + 168]) / 168) / (sum(t for _, _, t, _ in pairs[i:i + 168]) / 168) * 100
    starts = sorted(range(400 - 168), key=score)
    assert (weeks.best_start, weeks.worst_start) == (starts[0], starts[-1])
    assert (weeks.best_nrmse, weeks.worst_nrmse) == pytest.approx((score(starts[0]), score(starts[-1])))


def test_climatology_over_many_days_and_gaps(spark):
    rnd = random.Random(8)
    hours = [h for h in range(24 * 260) if rnd.random() < 0.5 and not 24 * 40 < h < 24 * 150]
    value = {h: rnd.uniform(0, 9) for h in hours}
    grid = spark.createDataFrame([(h, 0, 0, value[h]) for h in hours], "h long, x int, y int, value double").withColumn(
        "ts", F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, cast(h as int), 0, 0)"))
    for days in (30, 100):
        for r in T.climatology(grid, "2024-01-01", days).collect():
            inside = [value[h] for h in range(r.h - 24 * days, r.h, 24) if h in value]
            assert r.climatology == pytest.approx(sum(inside) / len(inside) if inside else value[r.h], rel=1e-12)
