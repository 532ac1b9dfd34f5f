"""Readers of landed documents (IO1-IO9) and record exports (IO10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourgrid import schemas
from hourgrid.functions.columns import nan_to_null, ntz, plus_hours

# Pollutant code of fine particles in the location documents, and the file-name
# patterns of measurement documents (landed form, and the form of a partitioned table).
PM25_PARAMETER = 2
SENSOR_IN_PATH = r"measurements/(?:sensor_id=)?(\d+)/"
STAMP = r"(\d{4}-?\d{2}-?\d{2}(?:T\d{2}(?:(?:%3A|:|-)?\d{2})*)?)"
RANGE_IN_PATH = rf"/(?:span=)?{STAMP}_{STAMP}"


def read_station_records(spark: SparkSession, path: str, multi_line: bool = True, flag_rebuilt: bool = False) -> DataFrame:
    """IO1-IO3: files of flat station records to (site facts, ts, value, raw_value).

    A document that carries a service error, or none that parses, contributes no rows.  A missing
    UTC is rebuilt from the observed date and hour (``flag_rebuilt`` adds the column ``rebuilt`` for these); records
    whose time cannot be told are dropped.
    """
    raw = (spark.read.schema(schemas.STATION_RECORD).option("multiLine", multi_line)
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    good = raw.where(F.col("WebServiceError").isNull() & F.col("_corrupt_record").isNull())
    day = F.try_to_timestamp("DateObserved", F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    hour = F.expr("CAST(try_cast(HourObserved AS DOUBLE) AS INT)")
    utc = F.coalesce(F.try_to_timestamp("UTC", F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp("UTC")).cast("timestamp_ntz")
    rows = good.withColumn("ts", F.coalesce(utc, plus_hours(day, hour))).withColumn("rebuilt", utc.isNull())
    return rows.where(F.col("ts").isNotNull()).select(
        F.col("FullAQSCode").alias("sensor_id"), F.col("SiteName").alias("site_name"), F.col("AgencyName").alias("agency"),
        F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"), "ts",
        F.coalesce(nan_to_null("Value"), nan_to_null("RawConcentration")).alias("value"), nan_to_null("RawConcentration").alias("raw_value"),
        *(["rebuilt"] if flag_rebuilt else []))


def utc_text(c: str) -> Column:
    return F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")


def read_locations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """IO4, IO5: location documents to sensors with their fine-particle sub-sensor."""
    docs = spark.read.schema(schemas.LOCATIONS_DOCUMENT).option("multiLine", multi_line).json(path)
    loc = docs.select(F.explode("results").alias("r"))
    pm = F.filter("r.sensors", lambda s: s["parameter"]["id"] == PM25_PARAMETER)
    return loc.select(
        F.col("r.id").alias("location_id"), F.try_element_at(pm, F.lit(1))["id"].alias("sensor_id"), F.col("r.name").alias("name"),
        F.col("r.provider.name").alias("provider"), F.col("r.coordinates.latitude").alias("lat"), F.col("r.coordinates.longitude").alias("lon"),
        utc_text("r.datetimeFirst.utc").alias("first_ts"), utc_text("r.datetimeLast.utc").alias("last_ts")).where(F.col("sensor_id").isNotNull())


def path_stamp(c: Column) -> Column:
    """Time written in a file name, with or without separators."""
    plain = F.rpad(F.regexp_replace(F.regexp_replace(c, "%3A", ""), r"[^0-9]", ""), 14, "0")
    return F.try_to_timestamp(plain, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def with_path_range(files: DataFrame, path: str = "path") -> DataFrame:
    """IO7: start and end written in the file name."""
    return (files.withColumn("file_start", path_stamp(F.regexp_extract(path, RANGE_IN_PATH, 1)))
                 .withColumn("file_end", path_stamp(F.regexp_extract(path, RANGE_IN_PATH, 2))))


def read_measurements(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                      multi_line: bool = True) -> DataFrame:
    """IO6, IO7: all measurement files of all sensors; the sensor and date range come from the path.

    Files outside [start, end) are rejected by name before their records are unrolled.
    """
    docs = (spark.read.schema(schemas.MEASUREMENTS_DOCUMENT).option("multiLine", multi_line).option("recursiveFileLookup", True)
                 .json(path).withColumn("path", F.col("_metadata.file_path")))
    docs = with_path_range(docs)
    if start and end:
        docs = docs.where((F.col("file_start") <= ntz(end)) & (F.col("file_end") >= ntz(start)))
    rows = docs.select(F.regexp_extract("path", SENSOR_IN_PATH, 1).cast("bigint").alias("sensor_id"), "path", F.explode("results").alias("r"))
    return rows.select("sensor_id", utc_text("r.period.datetimeFrom.utc").alias("ts"), nan_to_null("r.value").alias("value"), "path")


def write_wide_csv(obs: DataFrame, path: str, names: Sequence[str], key: str = "sensor_id") -> None:
    """IO8: one row per hour, one column per sensor."""
    wide = obs.groupBy("ts").agg(*[F.max(F.when(F.col(key).cast("string") == n, F.col("value"))).alias(n) for n in names])
    wide.write.mode("overwrite").option("header", True).csv(path)


def read_wide_csv(spark: SparkSession, path: str, index: str = "ts") -> DataFrame:
    """IO8: a wide summary back to (index, name, value) rows.  Column names may hold dots and spaces.

    Every column is declared a number from the header alone, so the files are not scanned twice.
    """
    header = spark.read.option("header", True).csv(path).columns
    names = [c for c in header if c != index]
    schema = ", ".join(f"`{c}` {'string' if c == index else 'double'}" for c in header)
    wide = spark.read.option("header", True).schema(schema).csv(path)
    safe = wide.select(F.col(f"`{index}`").alias("_i"), *[F.col(f"`{c}`").alias(f"v{k}") for k, c in enumerate(names)])
    labels = F.create_map(*[F.lit(x) for k, c in enumerate(names) for x in (f"v{k}", c)])
    long = safe.unpivot(["_i"], [f"v{k}" for k in range(len(names))], "_k", "value")
    return long.select(F.col("_i").alias(index), F.element_at(labels, F.col("_k")).alias("name"), nan_to_null("value").alias("value"))


def read_locations_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO8: the locations summary."""
    schema = ("`_c0` int, `sensor id` bigint, `pm2.5 sensor id` bigint, provider string, locations string, latitude double, longitude double")
    return spark.read.option("header", True).schema(schema).csv(path).select(
        F.col("_c0").alias("row_no"), F.col("`sensor id`").alias("location_id"), F.col("`pm2.5 sensor id`").alias("sensor_id"), "provider",
        F.col("locations").alias("name"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


# Marks of a missing report in station weather files.
MISSING_MARKS = ("M", "NA", "")


def coerce_station_weather(raw: DataFrame) -> DataFrame:
    """IO9: missing marks to NULL, text that is no number to NULL."""
    marks = ", ".join(f"'{m}'" for m in MISSING_MARKS)
    number = lambda c: F.expr(f"try_cast(CASE WHEN trim(`{c}`) NOT IN ({marks}) THEN trim(`{c}`) END AS DOUBLE)").alias(c)
    return raw.select("station", F.try_to_timestamp("valid").cast("timestamp_ntz").alias("valid"),
                      *[number(c) for c in raw.columns if c not in ("station", "valid")])


def read_station_weather(spark: SparkSession, path: str) -> DataFrame:
    """IO9: station reports as text columns; ``#`` lines are comments."""
    return coerce_station_weather(spark.read.option("comment", "#").option("header", True).schema(schemas.STATION_WEATHER).csv(path))


def write_records(df: DataFrame, path: str) -> None:
    """IO10: cleaned table to JSON records."""
    df.write.mode("overwrite").json(path)
