"""Gaps, off-hour readings and extents, on inputs small enough to work out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourgrid.functions import columns as C
from hourgrid.operators import alignment as J, fills as T, samples as S
from hourgrid.plans import gridded, learning

T0 = dt.datetime(2024, 1, 1)
at = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)


def test_off_hour_readings_have_no_slot(spark, rows):
    obs = spark.createDataFrame([(1, at(2, 15), 5.0), (1, at(3, 15), 6.0), (1, at(4), 7.0)], "sensor_id int, ts timestamp_ntz, value double")
    got = rows(T.hour_scaffold(obs, "2024-01-01 00:00:00", "2024-01-01 06:00:00"), "ts", "value")
    assert got == [(at(h), 7.0 if h == 4 else None) for h in range(6)]


def test_reading_exactly_on_the_hour(spark, rows):
    px = spark.createDataFrame([(1, at(10), 3.0), (1, at(10, 45), 4.0)], "row int, granule_ts timestamp_ntz, value double")
    assert rows(J.closest_before_hour(px, ["row"]), "ts", "value") == [(at(10), 3.0), (at(11), 4.0)]


def test_climatology_counts_days(spark, rows):
    grid = spark.createDataFrame([(0, 0, at(24 * (d - 1)), float(d)) for d in (1, 2, 3, 6)], "x int, y int, ts timestamp_ntz, value double")
    assert rows(T.climatology(grid, "2024-01-01", 2), "ts", "climatology") == [(at(0), 1.0), (at(24), 1.0), (at(48), 1.5), (at(120), 6.0)]


def test_windows_do_not_cross_gaps(spark):
    frames = spark.createDataFrame([("a", h, [float(h)]) for h in range(24) if h not in (10, 11, 12)], "channel string, ts_idx long, frame array<double>")
    for chunk in (256, 5):
        got = S.sliding_windows(frames, 2, 2, chunk=chunk, check=False).collect()
        assert sorted(r["sample_id"] for r in got) == [*range(7), *range(13, 21)]
        assert all(r["y_frames"] == [[r["sample_id"] + 2.0], [r["sample_id"] + 3.0]] for r in got)


def test_training_set_has_no_pair_across_a_gap(spark):
    grid = spark.createDataFrame([("a", at(h), 0, 0, float(h)) for h in range(40) if h not in (10, 11, 12)], "channel string, ts timestamp_ntz, x int, y int, value double")
    _, targets, _ = learning.training_set(grid, "a", "2024-01-01", 40, 1, 2, 2)
    pairs = [[f[0] for f in r["y_frames"]] for r in targets.collect()]
    assert pairs and all(b - a == 1 for a, b in pairs)


def test_missing_pixel_in_the_first_full_frame(spark, rows):
    data = [("c", at(h), 0, y, v) for h, vs in enumerate([(0.0, 0.0), (None, 4.0), (2.0, 8.0), (6.0, None), (0.0, 0.0)]) for y, v in enumerate(vs)]
    grid = spark.createDataFrame(data, "channel string, ts timestamp_ntz, x int, y int, value double")
    got = {(h, y): v for h, y, v in rows(T.recursive_smooth(grid, 0.5, 0.5), "ts", "y", "value")}
    # the state begins with the zeros before the first full frame; a missing pixel shows half of it
    assert [got[at(h), 0] for h in range(5)] == [0.0, None, 1.0, 3.5, 1.75]
    assert [got[at(h), 1] for h in range(5)] == [0.0, 4.0, 6.0, 3.0, 1.5]
    lone = grid.where("NOT (ts = '2024-01-01 00:00:00')")
    got = {(h, y): v for h, y, v in rows(T.recursive_smooth(lone, 0.5, 0.5), "ts", "y", "value")}
    assert [got[at(h), 0] for h in range(1, 5)] == [None, 2.0, 4.0, 2.0]


def test_zero_day_is_missing(spark, rows):
    day = lambda d: dt.date(2024, 1, d)
    grid = spark.createDataFrame([(day(1), 0, 0, 8.0), (day(2), 0, 0, 0.0), (day(3), 0, 0, 4.0)], "day date, x int, y int, value double")
    days = spark.createDataFrame([(day(d),) for d in (1, 2, 3)], "day date")
    assert rows(T.fill_day_gaps(grid, days), "day", "value") == [(day(1), 8.0), (day(2), 6.0), (day(3), 4.0)]


def test_polar_days_need_points(spark):
    one = dt.date(2024, 1, 1)
    px = spark.createDataFrame([(one, k, 0.5, 0.5, 9.0, 1.0) for k in range(3)], "day date, pixel int, lat double, lon double, value double, qa double")
    hours = T.hours_axis(spark, "2024-01-01", "2024-01-02")
    values = {r["value"] for r in gridded.polar_series(px, hours, (0, 1, 0, 1), 2).collect()}
    assert values == {0.0}
    more = px.unionByName(px.limit(1).withColumn("pixel", F.lit(9)))
    assert {r["value"] for r in gridded.polar_series(more, hours, (0, 1, 0, 1), 2).collect()} == {9.0}


def test_station_shows_no_report_from_the_future(spark, rows):
    rep = spark.createDataFrame([(1, at(9, 5), 0.5, 0.5, 1.0, 0.0, 10.0), (1, at(10, 20), 0.5, 0.5, 1.0, 0.0, 20.0)],
                                "station int, valid timestamp_ntz, lat double, lon double, sped double, drct double, t double")
    slots = spark.createDataFrame([(1, at(10))], "station int, ts timestamp_ntz")
    flat = spark.createDataFrame([(x, y, 0.0) for x in range(2) for y in range(2)], "x int, y int, value double")
    out = gridded.weather_series(rep, slots, flat, (0, 1, 0, 1), 2, {"t": True}).where("channel = 't'")
    assert {r["value"] for r in out.collect()} == {10.0}


@pytest.fixture
def lattice(spark):
    """8 x 8 pixels of value 8 * row + col, half a degree inside their cells; the inner 4 x 4 block is the extent."""
    df = spark.range(64).select((F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    return df.withColumn("lat", 7.5 - F.col("row")).withColumn("lon", F.col("col") + 0.5)


INNER = (2.0, 6.0, 2.0, 6.0)
BLOCK = [float(8 * r + c) for r in range(2, 6) for c in range(2, 6)]


def test_crop_before_resize(spark, lattice):
    hours = T.hours_axis(spark, "2024-01-01 01:00:00", "2024-01-01 02:00:00")
    field = lambda df: [r["value"] for r in df.orderBy("x", "y").collect()]
    px = lattice.withColumn("granule_ts", C.ntz("2024-01-01 00:30:00"))
    assert field(gridded.geostationary_series(px, F.lit(True), hours, (8, 8), 4, extent=INNER)) == BLOCK
    fc = lattice.select(C.ntz("2024-01-01 00:00:00").alias("init_ts"), C.ntz("2024-01-01 01:00:00").alias("valid_ts"), F.col("row").alias("x"), F.col("col").alias("y"), "lat", "lon", "value")
    fc = fc.withColumn("init_ts", C.ntz("2023-12-31 12:00:00"))
    assert field(gridded.forecast_series(fc, hours, (8, 8), 4, INNER)) == BLOCK
    re = lattice.select(F.lit("h").alias("channel"), C.ntz("2024-01-01 01:00:00").alias("src_ts"), F.col("row").alias("x"), F.col("col").alias("y"), "lat", "lon", "value")
    out = gridded.reanalysis_series(re, hours, (8, 8), 4, INNER)
    assert field(out["resized"]) == BLOCK and field(out["native"]) == BLOCK


def test_shuffled_order_equals_one_sort(spark, rows):
    ids = spark.createDataFrame([(i * 3,) for i in range(500)], "sample_id long")
    import hashlib
    want = sorted(range(0, 1500, 3), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    for digits in (1, 3):
        got = {i: p for i, p in rows(S.shuffled_order(ids, 7, digits=digits), "sample_id", "position")}
        assert [got[i] for i in want] == list(range(500))
