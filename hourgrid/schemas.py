"""Declared schemas of landed documents and canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


S, D, L, I, N = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()

# Flat regulatory-network record (an array of these per landed file).
STATION_RECORD = _struct(
    ("Latitude", D), ("Longitude", D), ("UTC", S), ("DateObserved", S), ("HourObserved", S),
    ("Parameter", S), ("Unit", S), ("Value", D), ("RawConcentration", D), ("AQI", I),
    ("Category", I), ("SiteName", S), ("AgencyName", S), ("FullAQSCode", S), ("IntlAQSCode", S),
    ("WebServiceError", T.ArrayType(_struct(("Message", S)))), ("_corrupt_record", S),
)

# Low-cost-network location document.
LOCATIONS_DOCUMENT = _struct(("results", T.ArrayType(_struct(
    ("id", L), ("name", S), ("provider", _struct(("name", S))),
    ("coordinates", _struct(("latitude", D), ("longitude", D))),
    ("datetimeFirst", _struct(("utc", S))), ("datetimeLast", _struct(("utc", S))),
    ("sensors", T.ArrayType(_struct(("id", L), ("parameter", _struct(("id", I)))))),
))))

# Low-cost-network measurement document.
MEASUREMENTS_DOCUMENT = _struct(
    ("meta", _struct(("found", S))),
    ("results", T.ArrayType(_struct(
        ("value", D), ("period", _struct(("datetimeFrom", _struct(("utc", S))))),
    ))),
)

# Landed readings and station weather reports.
EVENTS = _struct(("event_id", L), ("ts", N), ("user_id", L), ("event_type", S), ("value", D), ("props", S))
STATION_WEATHER = _struct(*[(c, S) for c in (
    "station", "valid", "lon", "lat", "tmpf", "dwpf", "relh", "drct", "sped", "p01i", "mslp", "feel")])
