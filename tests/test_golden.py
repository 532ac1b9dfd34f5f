"""Published values the operators must reproduce."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourgrid.functions import columns as C
from hourgrid.operators import alignment as J, fills as T, gridding as G, interpolate as I
from hourgrid.sources import tables as TB

# Ten sensors (lat, lon) and their cells on a 40 x 40 grid.
CELL_EXTENT = (-118.2, -118.0, 34.0, 34.15)
CELLS = [
    (34.02861, -118.18682, 32, 2), (34.02844, -118.15864, 32, 8), (34.05422, -118.18892, 25, 2), (34.08208, -118.16891, 18, 6),
    (34.12878, -118.18647, 5, 2), (34.06808, -118.1936, 21, 1), (34.09587, -118.15902, 14, 8), (34.09009, -118.17705, 15, 4),
    (34.11921, -118.1725, 8, 5), (34.135396, -118.1013964, 3, 19),
]


def test_cells_of_positions(spark, rows):
    x, y = C.cell_of(CELL_EXTENT, 40)
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(CELLS)], "i int, lat double, lon double")
    assert rows(df.select("i", x, y)) == [(i, cx, cy) for i, (_, _, cx, cy) in enumerate(CELLS)]


# Three days of hourly official NowCast / raw concentration of one station.
STATION_HOURS = [
    (17.8, 16.4), (18.3, 18.8), (15.8, 13.4), (16.4, 16.6), (15.8, 14.9), (15.8, 15.9), (15.2, 14.4), (16.5, 18.3), (16.1, 15.6), (15.8, 15.4),
    (15.7, 15.4), (14.4, 12.2), (14.2, 13.9), (14.6, 15.4), (15.0, 15.6), (17.5, 21.0), (20.7, 23.7), (21.7, 22.7), (21.2, 20.7), (20.8, 20.3),
    (18.4, 15.9), (18.1, 17.8), (15.2, 12.2), (12.8, 10.5), (12.3, 11.7), (12.2, 12.2), (10.4, 8.6), (10.5, 10.5), (12.1, 13.7), (12.9, 13.7),
    (11.8, 10.7), (10.6, 9.3), (10.2, 9.8), (10.8, 11.2), (10.4, 9.8), (9.7, 8.6), (9.6, 9.3), (11.0, 13.4), (13.0, 15.4), (14.9, 16.6), (17.5, 20.0),
    (17.7, 17.8), (17.1, 16.6), (17.2, 17.4), (18.0, 18.8), (16.8, 15.6), (13.8, 10.7), (14.0, 14.1), (11.7, 9.5), (10.3, 8.8), (9.2, 8.1), (8.6, 7.9),
    (11.1, 13.7), (11.6, 12.2), (11.1, 10.5), (10.9, 10.7), (9.2, 7.4), (9.8, 10.5), (9.2, 8.6), (11.0, 13.1), (12.1, 13.4), (11.9, 11.7), (12.2, 12.4),
    (14.7, 17.1), (14.9, 15.1), (15.5, 16.1), (18.2, 21.0), (17.5, 16.8), (18.1, 18.6), (18.3, 18.6), (17.3, 16.1), (16.7, 15.9),
]


def test_nowcast_matches_official_values(spark):
    start = dt.datetime(2023, 8, 2)
    data = [(1, start + dt.timedelta(hours=i), raw, official) for i, (official, raw) in enumerate(STATION_HOURS)]
    out = T.nowcast(spark.createDataFrame(data, "sensor_id int, ts timestamp_ntz, value double, official double")).orderBy("ts").collect()
    assert all(r.nowcast is None for r in out[:11])
    assert len(out) == 72 and all(abs(r.nowcast - r.official) <= 0.1 + 1e-9 for r in out[12:])


def test_nowcast_rules_in_order(spark):
    def last(values):
        data = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
        return T.nowcast(spark.createDataFrame(data, "sensor_id int, ts timestamp_ntz, value double")).orderBy(F.desc("ts")).first().nowcast
    assert last([5.0] * 11) is None                                   # short
    assert last([5.0] * 9 + [None, 5.0, None]) is None                # two of the last three missing
    assert last([0.0] * 12) == 0.0
    assert last([None] * 9 + [4.0, 4.0, None]) == 4.0
    assert last([10.0] * 11 + [0.0]) == 4.9                            # 10*(1/2+...+1/2^11)/(1+...+1/2^11), truncated


# Fifteen station cells on a flat 40 x 40 grid.
STATIONS = {
    "Simi Valley": (8, 1), "Reseda": (12, 4), "Santa Clarita": (4, 5), "North Hollywood": (12, 8), "Los Angeles": (17, 11),
    "Compton": (23, 12), "Long Beach": (28, 13), "Anaheim": (26, 18), "Glendora": (14, 20), "Mira Loma": (20, 28),
    "Fontana": (15, 28), "Riverside": (20, 30), "Lake Elsinore": (32, 32), "Crestline": (10, 33), "Temecula": (36, 38),
}


@pytest.mark.parametrize("site, nearest", [
    ("Los Angeles", ["Los Angeles", "North Hollywood", "Compton", "Reseda"]),
    ("Glendora", ["Glendora", "Fontana", "Los Angeles", "Mira Loma"]),
    ("Simi Valley", ["Simi Valley", "Reseda", "Santa Clarita", "North Hollywood"]),
])
def test_nearest_sensors_of_a_cell(spark, site, nearest):
    sensors = spark.createDataFrame(list(STATIONS.values()), "x int, y int")
    x, y = STATIONS[site]
    out = I.nearest_sensors(sensors, 40, 4).where((F.col("x") == x) & (F.col("y") == y)).orderBy("rank").collect()
    assert [(r.sx, r.sy) for r in out] == [STATIONS[n] for n in nearest]


def test_same_cell_mean_ignores_missing(spark, rows):
    cells = [(0, 0), (1, 0), (3, 5), (4, 5), (0, 8), (0, 1), (0, 0)]
    for values, expected in (([1, 3, 4, 5, 6, 7, 8], 4.5), ([1, 3, 4, 5, 6, 7, None], 1.0)):
        df = spark.createDataFrame([(0, x, y, None if v is None else float(v)) for (x, y), v in zip(cells, values)], "ts int, x int, y int, value double")
        out = {(x, y): v for x, y, v in rows(G.merge_mean(df), "x", "y", "value")}
        assert out == {(0, 0): expected, (1, 0): 3.0, (3, 5): 4.0, (4, 5): 5.0, (0, 8): 6.0, (0, 1): 7.0}


def test_frame_without_reading_stays_missing(spark):
    df = spark.createDataFrame([(0, 1, 1, None), (1, 0, 0, 2.0)], "ts int, x int, y int, value double")
    out = I.idw(df, 3)
    assert out.where("ts = 0").count() == 9 and out.where("ts = 0 and value is not null").count() == 0
    assert out.where("ts = 1 and value = 2").count() == 9


def test_run_back_off(spark):
    df = spark.sql("select timestamp_ntz'2025-01-10 00:00:00' start_ts, timestamp_ntz'2025-01-17 00:59:00' end_ts")
    r = J.run_back_off(df).first()
    assert (r.model_start, r.start_steps) == (dt.datetime(2025, 1, 9), 1)
    assert (r.model_end, r.end_steps) == (dt.datetime(2025, 1, 16, 0, 59), 0)


def test_valid_hours_of_a_noon_file(spark, rows):
    init = dt.datetime(2025, 1, 9, 12)
    fc = spark.createDataFrame([(init, init + dt.timedelta(hours=k), 1.0) for k in range(1, 40)], "init_ts timestamp_ntz, valid_ts timestamp_ntz, value double")
    wanted = T.hours_axis(spark, "2025-01-10", "2025-01-12")
    got = [v for (v,) in rows(J.select_valid_hours(fc, wanted), "valid_ts")]
    assert got == [dt.datetime(2025, 1, 10) + dt.timedelta(hours=k) for k in range(7)]


def test_yearly_chunks(spark, rows):
    df = spark.sql("select timestamp_ntz'2023-08-02' start_ts, timestamp_ntz'2025-08-02' end_ts")
    assert len(rows(TB.chunk_ranges(df, "1 YEAR"))) == 2
    clipped = rows(TB.chunk_ranges(spark.sql("select timestamp_ntz'2024-01-01' start_ts, timestamp_ntz'2024-02-10' end_ts"), "1 MONTH"), "chunk_start", "chunk_end")
    assert clipped[-1] == (dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 10))
