"""Canonical tables derived from the driver tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourgrid.functions.columns import cell_of, hour_floor, plus_hours
from hourgrid.operators.fills import hour_scaffold, hours_axis
from hourgrid.session import pin_session

DIM = 8
EXTENT = (-118.75, -117.05, 33.5, 34.5)
CHANNELS = ("click", "error", "purchase", "signup", "view")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
_SPANS: dict[tuple[str, str], tuple[str, str]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the tables of ``CTES`` by name."""
    def add(fn: Callable[["Tables"], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(lambda spark, sf_dir: fn(Tables(spark, sf_dir)), with_ctes(sql) if sql else None)
        return fn
    return add


# Averages of two-decimal inputs often end exactly on a decimal half at some digit, where the last
# bit of a float sum decides the rounding.  Both engines shift by this before rounding.
OFF_TIE = 3.14159265e-7


def r6(c: str | Column, alias: str | None = None) -> Column:
    """Round for comparison of float results between engines."""
    column = F.col(c) if isinstance(c, str) else c
    name = alias or (c if isinstance(c, str) else None)
    out = F.round(column + F.lit(OFF_TIE), 6) + F.lit(0.0)
    return out.alias(name) if name else out


def s6(expr: str) -> str:
    return f"(round({expr} + {OFF_TIE!r}, 6) + 0e0)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[r6(c) if c in columns else F.col(c) for c in df.columns])


class Tables:
    """The canonical tables; every one scans the driver files lazily and prunes its columns."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = pin_session(spark), sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def span(self) -> tuple[str, str]:
        """First day of the events and the day after the last: the half-open hourly axis.  Read once per session and folder."""
        key = self.spark.sparkContext.applicationId, self.sf_dir
        if key not in _SPANS:
            low, high = self.raw("events").agg(F.min("ts"), F.max("ts")).first()
            _SPANS[key] = str(low.date()), str(high.date() + timedelta(days=1))
        return _SPANS[key]

    @property
    def start(self) -> str:
        return self.span[0]

    @property
    def end(self) -> str:
        return self.span[1]

    @property
    def n_hours(self) -> int:
        return 24 * (date.fromisoformat(self.end) - date.fromisoformat(self.start)).days

    @property
    def axis(self) -> DataFrame:
        return hours_axis(self.spark, self.start, self.end)

    @property
    def readings(self) -> DataFrame:
        """One row per raw reading; ten sensors so that the hourly axis is densely filled."""
        return self.raw("events").select(
            "event_id", (F.col("user_id") % 10).alias("sensor_id"), "user_id", "ts",
            hour_floor("ts").alias("hour"), F.col("event_type").alias("channel"), "value")

    @property
    def hourly(self) -> DataFrame:
        return (self.readings.groupBy("sensor_id", F.col("hour").alias("ts"))
                    .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")))

    @property
    def scaffold(self) -> DataFrame:
        return hour_scaffold(self.hourly.select("sensor_id", "ts", "value"), self.start, self.end)

    def locate(self, df: DataFrame, by: Column) -> DataFrame:
        """Closed-form positions, so that SQL can repeat them."""
        df = df.withColumn("lat", F.lit(33.53) + ((by * 7) % 10) * F.lit(0.1))
        df = df.withColumn("lon", F.lit(-118.7) + ((by * 3) % 10) * F.lit(0.17))
        x, y = cell_of(EXTENT, DIM)
        return df.withColumn("x", x).withColumn("y", y)

    @property
    def sensors(self) -> DataFrame:
        ids = self.raw("events").select((F.col("user_id") % 10).alias("sensor_id")).distinct()
        return self.locate(ids, F.col("sensor_id"))

    @property
    def stations(self) -> DataFrame:
        """One per user: many share a cell; life span is the span of the user's events."""
        seen = self.raw("events").groupBy(F.col("user_id").alias("sensor_id")).agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        seen = seen.withColumn("provider", F.when(F.col("sensor_id") % 13 == 0, "reference")
                                            .when(F.col("sensor_id") % 2 == 0, "low_cost").otherwise("community"))
        return self.locate(seen, F.col("sensor_id"))

    @property
    def grid(self) -> DataFrame:
        """Hourly cell means per channel; cells without a reading are absent."""
        rows = self.locate(self.readings.select("channel", "hour", "value", "user_id"), F.col("user_id"))
        return (rows.groupBy("channel", F.col("hour").alias("ts"), "x", "y").agg(F.avg("value").alias("value")))

    @property
    def frame(self) -> DataFrame:
        """One channel: hourly cell means over all events."""
        rows = self.locate(self.readings.select("hour", "value", "user_id"), F.col("user_id"))
        return rows.groupBy(F.col("hour").alias("ts"), "x", "y").agg(F.avg("value").alias("value"))

    @property
    def pixels(self) -> DataFrame:
        """Quality-flagged pixels on a 12 x 7 native grid."""
        return self.raw("lineitem").select(
            F.col("l_shipdate").alias("granule_ts"), (F.col("l_suppkey") % 12).cast("int").alias("row"),
            (F.col("l_linenumber") - 1).cast("int").alias("col"), (F.col("l_extendedprice") / 1000).alias("value"),
            F.ascii("l_returnflag").alias("flag"), F.col("l_tax").alias("cloud"), F.col("l_discount").alias("qa"),
            F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("order_key"), "l_linestatus")

    @property
    def raster(self) -> DataFrame:
        """Monthly means of the pixels: frames of a native 12 x 7 grid."""
        return (self.pixels.groupBy(F.date_trunc("month", "granule_ts").cast("timestamp_ntz").alias("ts"),
                                    F.col("row").alias("x"), F.col("col").alias("y"))
                           .agg(F.avg("value").alias("value")))

    @property
    def forecasts(self) -> DataFrame:
        """Persistence forecasts 1..4 h ahead: predicted is the value at the base hour."""
        base = self.hourly.select("sensor_id", "ts", F.col("value").alias("y_pred"))
        ahead = base.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (1, 2, 3, 4)])))
        ahead = ahead.withColumn("valid_ts", plus_hours("ts", F.col("horizon")))
        truth = self.hourly.select("sensor_id", F.col("ts").alias("valid_ts"), F.col("value").alias("y_true"))
        rows = ahead.join(truth, ["sensor_id", "valid_ts"])
        sample = F.timestamp_diff("HOUR", F.lit(self.start).cast("timestamp_ntz"), F.col("ts")).alias("sample_id")
        return self.locate(rows.select("sensor_id", sample, "ts", "horizon", "valid_ts", "y_true", "y_pred"), F.col("sensor_id"))


_LOCATE = ("33.53e0 + (({k} * 7) % 10) * 0.1e0 AS lat, -118.7e0 + (({k} * 3) % 10) * 0.17e0 AS lon, "
           "CAST(greatest(0, least(trunc((34.5e0 - (33.53e0 + (({k} * 7) % 10) * 0.1e0)) / 1e0 * 8), 7)) AS INTEGER) AS x, "
           "CAST(greatest(0, least(trunc(((-118.7e0 + (({k} * 3) % 10) * 0.17e0) + 118.75e0) / {span} * 8), 7)) AS INTEGER) AS y")


def locate_sql(key: str) -> str:
    return _LOCATE.format(k=key, span=repr(EXTENT[1] - EXTENT[0]) + "e0")


# Ordered: a table may use those before it.
CTES: dict[str, str] = {
    "axis_span": "SELECT CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS lo, CAST(date_trunc('day', max(ts)) AS TIMESTAMP) + INTERVAL 1 DAY AS hi FROM events",
    "axis": f"SELECT CAST(g AS TIMESTAMP) AS ts FROM (SELECT unnest(generate_series((SELECT lo FROM axis_span), (SELECT hi FROM axis_span) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS g)",
    "readings": "SELECT event_id, user_id % 10 AS sensor_id, user_id, ts, date_trunc('hour', ts) AS hour, event_type AS channel, value FROM events",
    "hourly": "SELECT sensor_id, hour AS ts, avg(value) AS value, count(*) AS n FROM readings GROUP BY sensor_id, hour",
    "scaffold": "SELECT s.sensor_id, a.ts, h.value FROM (SELECT DISTINCT sensor_id FROM hourly) s CROSS JOIN axis a LEFT JOIN hourly h ON h.sensor_id = s.sensor_id AND h.ts = a.ts",
    "sensors": f"SELECT sensor_id, {locate_sql('sensor_id')} FROM (SELECT DISTINCT user_id % 10 AS sensor_id FROM events)",
    "stations": f"SELECT sensor_id, first_ts, last_ts, CASE WHEN sensor_id % 13 = 0 THEN 'reference' WHEN sensor_id % 2 = 0 THEN 'low_cost' ELSE 'community' END AS provider, {locate_sql('sensor_id')} FROM (SELECT user_id AS sensor_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id)",
    "located": f"SELECT channel, hour, value, {locate_sql('user_id')} FROM readings",
    "grid": "SELECT channel, hour AS ts, x, y, avg(value) AS value FROM located GROUP BY channel, hour, x, y",
    "frame": "SELECT hour AS ts, x, y, avg(value) AS value FROM located GROUP BY hour, x, y",
    "pixels": "SELECT l_shipdate AS granule_ts, CAST(l_suppkey % 12 AS INTEGER) AS \"row\", CAST(l_linenumber - 1 AS INTEGER) AS col, l_extendedprice / 1000 AS value, ascii(l_returnflag) AS flag, l_tax AS cloud, l_discount AS qa, l_quantity AS quantity, l_orderkey AS order_key, l_linestatus FROM lineitem",
    "raster": "SELECT CAST(date_trunc('month', granule_ts) AS TIMESTAMP) AS ts, \"row\" AS x, col AS y, avg(value) AS value FROM pixels GROUP BY ALL",
    "forecasts": f"SELECT a.sensor_id, date_diff('hour', (SELECT lo FROM axis_span), a.ts) AS sample_id, a.ts, k.horizon, a.ts + k.horizon * INTERVAL 1 HOUR AS valid_ts, t.value AS y_true, a.value AS y_pred, {locate_sql('a.sensor_id')} FROM hourly a CROSS JOIN (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS horizon) k JOIN hourly t ON t.sensor_id = a.sensor_id AND t.ts = a.ts + k.horizon * INTERVAL 1 HOUR",
}


def with_ctes(body: str) -> str:
    """Prefix the tables a statement needs, transitively.  A body may open with its own tables
    (``name AS (...), ... SELECT``) marked by a leading ``+``."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    own = body.lstrip()
    recursive = own.startswith("+rec")
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    if own.startswith("+"):
        own = own[4:] if recursive else own[1:]
        head = "WITH RECURSIVE " if recursive else "WITH "
        return head + ", ".join(parts) + (", " if parts else "") + own.strip()
    return ("WITH " + ", ".join(parts) + " " if parts else "") + own
