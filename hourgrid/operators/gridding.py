"""Readings onto cells, cell sets and static layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourgrid.functions.columns import Extent, in_extent, one_row

def cell_columns(k: Column, dim: int) -> list[Column]:
    return [F.floor(k / dim).cast("int").alias("x"), (k % dim).cast("int").alias("y")]


def all_cells(spark: SparkSession, dim: int) -> DataFrame:
    return spark.range(dim * dim).select(*cell_columns(F.col("id"), dim))


def each_cell(df: DataFrame, dim: int, x: str = "x", y: str = "y") -> DataFrame:
    """Unroll every row over the fixed dim*dim cells."""
    k = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(dim * dim - 1))))
    cx, cy = cell_columns(F.col("_k"), dim)
    return k.withColumn(x, cx).withColumn(y, cy).drop("_k")


def plot_last(readings: DataFrame, order: Sequence[str] | Column, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """One value per cell, the last reading in ``order`` wins; missing and negative are not written."""
    key = order if isinstance(order, Column) else F.struct(*order)
    return (readings.where(F.col(value) >= 0)
                    .groupBy(*frame, "x", "y").agg(F.max_by(value, key).alias(value)))


def merge_mean(readings: DataFrame, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """Readings that share a cell are averaged, missing ones ignored."""
    return readings.groupBy(*frame, "x", "y").agg(F.avg(value).alias(value))


def plot_on_zero(readings: DataFrame, dim: int, order: Sequence[str], frame: Sequence[str] = ("ts",),
                 allow_negative: bool = False, value: str = "value") -> DataFrame:
    """Dense frames over a zero background; missing (and, unless allowed, negative) writes 0."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    if not allow_negative:
        v = F.greatest(v, F.lit(0.0))
    written = readings.groupBy(*frame, "x", "y").agg(F.max_by(v, F.struct(*order)).alias(value))
    slots = each_cell(readings.select(*frame).distinct(), dim)
    return slots.join(written, [*frame, "x", "y"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def scale_elevation(layer: DataFrame, scale: float = 100.0, value: str = "value") -> DataFrame:
    """Min-max to [0, scale]; a constant layer becomes 0."""
    b = one_row(layer.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    span = F.col("_p.hi") - F.col("_p.lo")
    scaled = (F.col(value) - F.col("_p.lo")) / F.nullif(span, F.lit(0.0)) * scale
    return layer.withColumn("_p", b).withColumn(value, F.coalesce(scaled, F.lit(0.0))).drop("_p")


def bounding_window(pixels: DataFrame, extent: Extent, pad: int = 2, row: str = "row", col: str = "col") -> DataFrame:
    """Rows and columns that hold a pixel inside the extent, padded on every side."""
    hit = pixels.where(in_extent(extent)).agg(
        F.min(row).alias("r0"), F.max(row).alias("r1"), F.min(col).alias("c0"), F.max(col).alias("c1"))
    inside = (F.col(row).between(F.col("_p.r0") - pad, F.col("_p.r1") + pad)
              & F.col(col).between(F.col("_p.c0") - pad, F.col("_p.c1") + pad))
    return pixels.withColumn("_p", one_row(hit)).where(inside).drop("_p")


def cropped(pixels: DataFrame, extent: Extent, row: str = "row", col: str = "col") -> tuple[DataFrame, tuple[int, int]]:
    """G15/G16 before a resize: the smallest block of rows and columns that holds all pixels inside the
    extent, numbered from 0, and its shape.  The shape sizes the resampling matrices, so its four
    numbers are fetched; an extent without pixels gives an empty block."""
    hit = pixels.where(in_extent(extent)).agg(F.min(row), F.max(row), F.min(col), F.max(col)).first()
    if hit[0] is None:
        return pixels.limit(0), (1, 1)
    r0, r1, c0, c1 = hit
    block = pixels.where(F.col(row).between(r0, r1) & F.col(col).between(c0, c1))
    block = block.withColumn(row, (F.col(row) - r0).cast("int")).withColumn(col, (F.col(col) - c0).cast("int"))
    return block, (int(r1 - r0) + 1, int(c1 - c0) + 1)


def frame_validity(grid: DataFrame, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """G24"""
    return grid.groupBy(*frame).agg(F.count(value).alias("n_valid"), (F.count(value) > 0).alias("is_valid"))


def neighbourhood(sensors: DataFrame, dim: int, radius: int) -> DataFrame:
    """Cells within a square radius of any sensor cell, the sensor cells included."""
    around = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - radius, F.lit(0)), F.least(F.col(c) + radius, F.lit(dim - 1))))
    return (sensors.select("x", "y").distinct().withColumn("_x", around("x")).withColumn("_y", around("y"))
                   .select(F.col("_x").alias("x"), F.col("_y").alias("y")).distinct())


def region_masks(sensors: DataFrame, dim: int, radius: int = 2) -> DataFrame:
    """Labelled cells: ``sensor``, ``nhood`` (sensor cells and surroundings), ``full``."""
    parts = [("sensor", sensors.select("x", "y").distinct()), ("nhood", neighbourhood(sensors, dim, radius)),
             ("full", all_cells(sensors.sparkSession, dim))]
    labelled = [p.select(F.lit(n).alias("region"), "x", "y") for n, p in parts]
    return labelled[0].unionByName(labelled[1]).unionByName(labelled[2])


# Loss weights of sensor cells, their surroundings and the background.
CELL_WEIGHTS = (25.0, 5.0, 1.0)


def weight_grid(sensors: DataFrame, dim: int, radius: int = 1, weights: tuple[float, float, float] = CELL_WEIGHTS) -> DataFrame:
    """A sensor cell keeps the sensor weight even inside another sensor's surroundings."""
    rank = F.when(F.col("region") == "sensor", 0).when(F.col("region") == "nhood", 1).otherwise(2)
    best = region_masks(sensors, dim, radius).groupBy("x", "y").agg(F.min(rank).alias("_r"))
    w = F.element_at(F.array(*[F.lit(float(v)) for v in weights]), F.col("_r") + 1)
    return best.select("x", "y", w.alias("weight"))


def centre_block(grid: DataFrame, size: int, rows: int, cols: int) -> DataFrame:
    """Half a ``size`` to each side of the middle, clamped to the grid."""
    half = size // 2
    x0, y0 = max(0, rows // 2 - half), max(0, cols // 2 - half)
    x1, y1 = min(rows, rows // 2 + half), min(cols, cols // 2 + half)
    return grid.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def mean_spacing(points: DataFrame, column: str) -> DataFrame:
    """Mean absolute difference of successive distinct coordinates.

    Sorted coordinates telescope: the mean step is (max - min) / (n - 1), no ordering needed.
    """
    d = points.select(column).distinct()
    return d.agg(((F.max(column) - F.min(column)) / F.nullif(F.count(column) - 1, F.lit(0))).alias("spacing"))
