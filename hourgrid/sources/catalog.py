"""File catalogues: names to metadata, inventory filters, routing, integrity (IO16-IO18, IO20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hourgrid.functions.columns import ntz

# Name layouts.  Composite tile: PRODUCT.AyyyyDDD.hHHvVV.version.yyyyDDDHHMMSS.
# Granule: ..._yyyyMMddTHHmmssZ_...
TILE_NAME = r"([A-Z0-9]+)\.A(\d{7})\.(h\d{2}v\d{2})\.(\d{3})\.(\d{13})"
GRANULE_STAMP = r"_(\d{8}T\d{6})Z"
# Satellite changeover, first day with data, and the product allow-list.
FIRST_DAY, CHANGEOVER = "2018-09-01", "2022-05-01"
SATELLITES = (17, 18)
PRODUCTS = {
    "ABI-L2-AODC": ("AOD",),
    "ABI-L2-ADPC": ("Smoke", "Dust"),
    "ABI-L2-FDCC": ("Mask", "Temp", "Area", "Power"),
}
# File code per forecast product, and init hours per model.
FORECAST_CODES = {"pm25": "ave_1hr_pm25_bc", "o3": "ave_1hr_o3_bc"}
MIN_BYTES = 10_000_000


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the landed files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def tile_metadata(files: DataFrame, name: str = "name") -> DataFrame:
    """IO16: acquisition day, tile, version and production day of composite tiles."""
    part = lambda k: F.regexp_extract(name, TILE_NAME, k)
    day = lambda c: F.expr(f"to_date(nullif({c}, ''), 'yyyyDDD')")
    rows = files.select("*", part(1).alias("product"), part(2).alias("_a"), part(3).alias("tile"), part(4).alias("version"), part(5).alias("_p"))
    return rows.withColumn("acq_date", day("_a")).withColumn("production_date", day("substring(_p, 1, 7)")).drop("_a", "_p")


def granule_time(files: DataFrame, name: str = "name") -> DataFrame:
    """IO16: timestamp of a granule."""
    stamp = F.regexp_extract(name, GRANULE_STAMP, 1)
    return files.withColumn("granule_ts", F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz"))


def forecast_inventory(files: DataFrame, product: str, start_day: str, end_day: str, start_steps: int = 0, end_steps: int = 0,
                       init_hours: tuple[int, ...] = (6, 12), name: str = "name") -> DataFrame:
    """IO17: files of the product whose model day lies in [start_day, end_day], the model's init
    hours only, without the first ``start_steps`` and the last ``-end_steps`` files.

    ``files``: (name, model_day DATE, init_hour INT), one row per file.  The position is taken over
    the selected inventory (two rows a day), not over data.
    """
    picked = files.where(F.col(name).contains(FORECAST_CODES[product]) & F.col("init_hour").isin(*init_hours)
                         & F.col("model_day").between(start_day, end_day))
    order = Window.orderBy("model_day", "init_hour", name)
    n = picked.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = picked.withColumn("position", F.row_number().over(order) - 1)
    return rows.where((F.col("position") >= start_steps) & (F.col("position") < n + end_steps))


def route_satellite(granules: DataFrame, ts: str = "granule_ts") -> DataFrame:
    """IO18: satellite by date; days before the first one and unknown products are rejected."""
    allowed = [F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p, subs in PRODUCTS.items() for s in subs]
    known = F.array_contains(F.array(*allowed), F.struct(F.col("product").alias("p"), F.col("subproduct").alias("s")))
    early, late = SATELLITES
    return (granules.where((F.col(ts) >= ntz(FIRST_DAY)) & known)
                    .withColumn("satellite", F.when(F.col(ts) < ntz(CHANGEOVER), early).otherwise(late)))


def corrupt_files(files: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """IO20: files that are too short to be whole."""
    return files.where(F.col("length") < min_bytes)


def intact_files(catalogue: DataFrame, files: DataFrame, min_bytes: int = MIN_BYTES, key: str = "path") -> DataFrame:
    return catalogue.join(corrupt_files(files, min_bytes).select(key), key, "left_anti")
