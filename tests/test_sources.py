"""Landed files in their original layout, tables, and streams that restart."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from hourgrid.functions.series import nowcast_value
from hourgrid.sources import catalog, documents as D, tables as TB
from hourgrid.streaming import live


def test_station_files(spark, tmp_path, rows):
    ok = {"Latitude": 34.0, "Longitude": -118.0, "UTC": "2023-08-02T05:00", "Value": 17.8, "RawConcentration": 16.4, "SiteName": "A", "AgencyName": "x", "FullAQSCode": "060371103"}
    rebuilt = {**ok, "UTC": None, "DateObserved": "2023-08-02 ", "HourObserved": "7.0", "Value": None}
    rebuilt["DateObserved"] = "2023-08-02"
    lost = {**ok, "UTC": None}
    (tmp_path / "a.json").write_text(json.dumps([ok, rebuilt, lost]))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text(json.dumps([{"WebServiceError": [{"Message": "over limit"}]}]))
    (tmp_path / "d.json").write_text('[{"Latitude": 3')
    flags = rows(D.read_station_records(spark, str(tmp_path), flag_rebuilt=True), "ts", "rebuilt")
    assert flags == [(dt.datetime(2023, 8, 2, 5), False), (dt.datetime(2023, 8, 2, 7), True)]
    got = rows(D.read_station_records(spark, str(tmp_path)), "sensor_id", "ts", "value", "raw_value")
    assert got == [("060371103", dt.datetime(2023, 8, 2, 5), 17.8, 16.4), ("060371103", dt.datetime(2023, 8, 2, 7), 16.4, 16.4)]


def test_location_files(spark, tmp_path, rows):
    loc = lambda i, subs: {"id": i, "name": f"n{i}", "provider": {"name": "p"}, "coordinates": {"latitude": 1.0, "longitude": 2.0},
                           "datetimeFirst": None, "datetimeLast": {"utc": "2024-01-01T00:00:00Z"}, "sensors": subs}
    doc = {"results": [loc(1, [{"id": 10, "parameter": {"id": 1}}, {"id": 11, "parameter": {"id": 2}}]), loc(2, [{"id": 20, "parameter": {"id": 1}}])]}
    (tmp_path / "l.json").write_text(json.dumps(doc, indent=1))
    assert rows(D.read_locations(spark, str(tmp_path)), "location_id", "sensor_id", "first_ts", "last_ts") == [(1, 11, None, dt.datetime(2024, 1, 1))]


def test_measurement_files_by_name(spark, tmp_path, rows):
    def put(sensor, first, last, value):
        folder = tmp_path / "measurements" / str(sensor)
        folder.mkdir(parents=True, exist_ok=True)
        doc = {"meta": {"found": ">1000"}, "results": [{"value": value, "period": {"datetimeFrom": {"utc": f"{first}T01:00:00Z"}}}]}
        (folder / f"{first}_{last}.json").write_text(json.dumps(doc, indent=1))
    put(5, "2023-01-01", "2023-02-01", 1.0)
    put(5, "2023-02-01", "2023-03-01", 2.0)
    put(7, "2024-01-01", "2024-02-01", 3.0)
    path = str(tmp_path / "measurements")
    assert len(rows(D.read_measurements(spark, path))) == 3
    assert rows(D.read_measurements(spark, path, "2023-02-10", "2023-02-20"), "sensor_id", "value") == [(5, 2.0)]


def test_csv_with_dotted_names(spark, tmp_path, rows):
    (tmp_path / "m.csv").write_text("_c0,Garfield HS/Monterey CHS (8677),a.b\n0,1.5,\n1,,2.5\n")
    got = rows(D.read_wide_csv(spark, str(tmp_path / "m.csv"), "_c0"))
    assert got == [("0", "Garfield HS/Monterey CHS (8677)", 1.5), ("0", "a.b", None), ("1", "Garfield HS/Monterey CHS (8677)", None), ("1", "a.b", 2.5)]
    (tmp_path / "l.csv").write_text(",sensor id,pm2.5 sensor id,provider,locations,latitude,longitude\n0,9,8,P,Rowan ES (6425),34.0,-118.1\n")
    assert rows(D.read_locations_csv(spark, str(tmp_path / "l.csv")), "row_no", "sensor_id", "name") == [(0, 8, "Rowan ES (6425)")]


def test_station_weather_file(spark, tmp_path, rows):
    head = "station,valid,lon,lat,tmpf,dwpf,relh,drct,sped,p01i,mslp,feel"
    (tmp_path / "w.csv").write_text(f"#DEBUG: x\n{head}\nKLAX,2024-01-01 00:53,-118.4,33.9,55.0,M,,NA,calm,0.0,M,M\n")
    r = D.read_station_weather(spark, str(tmp_path)).first()
    assert (r.station, r.valid, r.tmpf, r.dwpf, r.relh, r.drct, r.sped, r.p01i) == ("KLAX", dt.datetime(2024, 1, 1, 0, 53), 55.0, None, None, None, None, 0.0)


def test_short_files_are_corrupt(spark, tmp_path, rows):
    (tmp_path / "a.bin").write_bytes(b"x" * 10)
    (tmp_path / "b.bin").write_bytes(b"x" * 2000)
    files = catalog.list_files(spark, str(tmp_path))
    kept = catalog.intact_files(files.select("path"), files, 1000)
    assert [p.endswith("b.bin") for (p,) in rows(kept)] == [True]


def test_rerun_replaces_only_its_months(spark, tmp_path, rows):
    grid = lambda day, v: spark.createDataFrame([("c", dt.datetime(2024, m, day), 0, 0, v) for m in (1, 2)], "channel string, ts timestamp_ntz, x int, y int, value double")
    path = str(tmp_path / "s")
    TB.save_series(grid(3, 1.0), path, {"dim": 4})
    TB.save_series(grid(3, 2.0).where("month(ts) = 2"), path)
    assert rows(TB.load_series(spark, path), "ts", "value") == [(dt.datetime(2024, 1, 3), 1.0), (dt.datetime(2024, 2, 3), 2.0)]
    assert rows(TB.load_params(spark, path)) == [("dim", "4")]
    assert TB.load_series(spark, path, ["c"], "2024-02-01", "2024-03-01").count() == 1


SERIES = "channel string, ts timestamp_ntz, x int, y int, value double"


def test_state_answers_without_reading_the_series(spark, tmp_path, rows):
    hour = lambda m, h: dt.datetime(2024, m, 1, h)
    some = lambda channel, m, hours: spark.createDataFrame([(channel, hour(m, h), x, 0, 1.0) for h in hours for x in range(3)], SERIES)
    path = str(tmp_path / "s")
    TB.save_series(some("7", 1, range(4)).unionByName(some("8", 1, range(2, 6))), path)
    TB.save_series(some("7", 2, [0, 1]), path)
    accepted = TB.series_accepted(spark, path, 8, 2)
    assert rows(accepted) == [(8, 2, True)]
    assert rows(TB.series_accepted(spark, path, 7, 2)) == [(8, 2, False)]
    assert all("/series_state/" in f for f in accepted.inputFiles())
    TB.save_series(some("8", 1, [3]), path)                             # an overwrite leaves the hours of "7" alone
    assert rows(TB.series_state(spark, path), "channel", "month", "n_rows", "last_ts") == [
        ("7", "2024-01", 12, hour(1, 3)), ("7", "2024-02", 6, hour(2, 1)), ("8", "2024-01", 3, hour(1, 3))]
    assert rows(TB.series_accepted(spark, path, 6, 2)) == [(6, 2, True)]
    assert [r[1:] for r in rows(TB.replaced_runs(spark, path))] == [("8", "2024-01")]
    assert TB.load_series(spark, path).where("channel = '8'").count() == 3
    assert TB.load_series(spark, path).schema["channel"].dataType.simpleString() == "string"
    incoming = spark.createDataFrame([(hour(2, h),) for h in range(5)], "ts timestamp_ntz")
    resumed = TB.resume_rows(spark, path, incoming, "2024-02-01 04:00:00")
    assert rows(resumed) == [(hour(2, 2),), (hour(2, 3),)]
    assert not any("/series/" in f for f in resumed.inputFiles())


def test_run_that_died_changes_nothing(spark, tmp_path, rows):
    grid = lambda v: spark.createDataFrame([("c", dt.datetime(2024, 1, 3), 0, 0, v)], SERIES)
    path = str(tmp_path / "s")
    TB.save_series(grid(1.0), path)
    grid(2.0).selectExpr("*", "'2024-01' AS month").write.partitionBy("channel", "month").parquet(f"{path}/series/run=rdead")     # no state row
    assert rows(TB.load_series(spark, path), "value") == [(1.0,)]
    TB.save_series(grid(3.0), path)
    assert rows(TB.load_series(spark, path), "value") == [(3.0,)]


def test_chunks_and_what_is_missing(spark, tmp_path, rows):
    day = lambda d, h=0: dt.datetime(2024, 3, d, h)
    some = lambda days, v: spark.createDataFrame([("c", day(d, h), 0, 0, v) for d in days for h in (0, 23)], SERIES)
    path = str(tmp_path / "c")
    for days in ([1, 2], [6], [1, 2]):
        TB.append_chunks(some(days, 1.0), path)
    TB.append_chunks(some([6], 2.0), path)
    assert rows(TB.load_chunks(spark, path, "2024-03-02", "2024-03-07"), "ts", "value") == [
        (day(2), 1.0), (day(2, 23), 1.0), (day(6), 2.0), (day(6, 23), 2.0)]
    assert rows(TB.missing_ranges(spark, path, "2024-03-01 12:00:00", "2024-03-09 06:00:00")) == [(day(3), day(6)), (day(7), day(9, 6))]
    assert rows(TB.missing_ranges(spark, path, "2024-03-01", "2024-03-03")) == []
    assert rows(TB.missing_ranges(spark, path, "2024-03-03 06:00:00", "2024-03-04")) == [(day(3, 6), day(4))]
    TB.append_chunks(some([], 0.0), path)
    assert TB.load_chunks(spark, path, "2024-01-01", "2025-01-01").count() == 6


def test_resume_after_the_mark(spark, rows):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    incoming = spark.createDataFrame([(t(h),) for h in range(6)], "ts timestamp_ntz")
    stored = incoming.where(F.col("ts") <= t(2))
    assert rows(TB.new_rows(stored, incoming, "2024-01-01 05:00:00")) == [(t(3),), (t(4),)]
    assert rows(TB.new_rows(incoming.where(F.col("ts") <= t(4)), incoming, "2024-01-01 05:00:00")) == []
    assert len(rows(TB.new_rows(stored.limit(0), incoming, "2024-01-01 05:00:00"))) == 5


SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _land(spark, folder, first, hours, sensor=1):
    data = [(first + k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=5), sensor, "view", float(h % 7 + 1), "{}") for k, h in enumerate(hours)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_append_survives_a_restart(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    _land(spark, src, 0, range(5))
    live.append_once(live.read_stream(spark, str(src)), out, cp)
    _land(spark, src, 5, range(5, 9))
    _land(spark, src, 5, range(5, 9))                                  # the same readings land twice
    result = live.append_once(live.read_stream(spark, str(src)), out, cp)
    assert sorted(r.event_id for r in result.collect()) == list(range(9))


def test_stateful_nowcast_over_several_batches(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    hours = [*range(0, 20), *range(40, 60)]                            # silent for 20 hours in between
    for part in (hours[:7], hours[7:25], hours[25:]):
        _land(spark, src, part[0], part)
        with live.use_rocksdb(spark):
            rows = live.read_stream(spark, str(src)).select("ts", F.col("user_id").alias("sensor_id"), "value")
            table = live.run_to_table(live.carry_and_nowcast(rows), out, cp)
    got = {int((r.ts - dt.datetime(2024, 1, 1)).total_seconds() // 3600): (r.carried, r.nowcast) for r in table.collect()}
    value = lambda h: float(h % 7 + 1) if h in hours else None
    for start, stop in ((0, 31), (40, 57)):
        last = None
        for h in range(start, stop):
            last = value(h) if value(h) is not None else last
            want = nowcast_value([value(k) for k in range(max(start, h - 11), h + 1)])
            assert got[h][0] == last and (got[h][1] == want or (want is None and got[h][1] is None))
    assert not any(31 <= h < 40 for h in got)
