"""Filling the grid between sensors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from hourgrid.functions import kernels, triangulation
from hourgrid.functions.columns import Extent, cell_of
from hourgrid.operators.gridding import all_cells


def pack_frames(grid: DataFrame, dim: int, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """One row per frame: sorted cell numbers and their values, at most dim*dim of them.

    ``grid`` is unique per (frame, cell); merge readings first (G3, G4), which combines before
    the shuffle.  Packed frames are small in bytes and heavy in arithmetic, so they are spread by
    an explicit count: adaptive coalescing, which goes by bytes, would leave too few tasks.
    """
    tasks = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = (F.col("x") * dim + F.col("y")).cast("int")
    point = F.when(F.col(value).isNotNull(), F.struct(cell.alias("c"), F.col(value).alias("v")))
    packed = grid.repartition(tasks, *frame).groupBy(*frame).agg(F.sort_array(F.collect_list(point)).alias("_p"))
    return packed.select(*frame, F.col("_p.c").alias("cells"), F.col("_p.v").alias("values"))


def packed_layer(layer: DataFrame, dim: int, value: str = "value") -> Column:
    """A complete static layer as one array of dim*dim values."""
    rows = layer.select((F.col("x") * dim + F.col("y")).alias("c"), F.col(value).alias("v"))
    return rows.agg(F.expr("transform(array_sort(collect_list(struct(c, v))), p -> p.v)").alias("z")).scalar()


def _with_layer(packed: DataFrame, layer: Column) -> DataFrame:
    """Packed frames with a static array as ``_z``, on the first row of each partition only."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return packed.withColumn("_z", F.when(first, layer))


def idw(grid: DataFrame, dim: int, power: float = 2.0, neighbours: int = 10, elevation: DataFrame | None = None,
        frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """Observed cells pass through; others are the inverse-distance mean of the nearest
    ``neighbours`` cells reporting in that frame; a frame without readings stays missing.

    ``elevation`` (complete layer, already scaled) adds a third axis to the distance.
    """
    packed = pack_frames(grid, dim, frame, value)
    if elevation is not None:
        packed = _with_layer(packed, packed_layer(elevation, dim))
    kernel = lambda frames, z: kernels.idw_batch(frames, z, dim, power, neighbours)
    return kernels.fields(packed, dim, frame, kernel, value, None if elevation is None else "_z")


def nearest_sensors(sensors: DataFrame, dim: int, k: int, elevation: DataFrame | None = None) -> DataFrame:
    """J6 as a table: the k nearest sensor cells of every cell, ranked, ties by (x, y).

    The sensor cells are one array of at most dim*dim points, attached to each of the dim*dim
    cells; sorting stays inside the row.
    """
    points = sensors.select(F.col("x").cast("int").alias("sx"), F.col("y").cast("int").alias("sy")).distinct()
    here = all_cells(sensors.sparkSession, dim)
    if elevation is not None:
        points = points.join(elevation.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("value").alias("sz")), ["sx", "sy"])
        here = here.join(elevation.select("x", "y", F.col("value").alias("z")), ["x", "y"])
    else:
        points, here = points.withColumn("sz", F.lit(0.0)), here.withColumn("z", F.lit(0.0))
    every = points.agg(F.collect_list(F.struct("sx", "sy", "sz")).alias("a")).scalar()
    sq = lambda c: c * c
    dist = lambda p: F.sqrt(sq(p["sx"] - F.col("x")) + sq(p["sy"] - F.col("y")) + sq(p["sz"] - F.col("z")))
    near = F.slice(F.sort_array(F.transform("_a", lambda p: F.struct(dist(p).alias("dist"), p["sx"].alias("sx"), p["sy"].alias("sy")))), 1, k)
    return (here.withColumn("_a", every).select("x", "y", F.posexplode(near).alias("_r", "_p"))
                .select("x", "y", (F.col("_r") + 1).alias("rank"), F.col("_p.sx").alias("sx"), F.col("_p.sy").alias("sy"), F.col("_p.dist").alias("dist")))


def idw_fixed_neighbours(grid: DataFrame, sensors: DataFrame, dim: int, power: float = 2.0, neighbours: int = 10,
                         elevation: DataFrame | None = None, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """Neighbours fixed in advance (the sensors of the first frame); distances and elevation
    differences are divided by their norm over the neighbours; weight 1/(d + z^2)^p.

    The neighbour table has dim*dim*k entries and rides on the first row of each partition of packed frames.
    """
    near = nearest_sensors(sensors, dim, neighbours)
    dz = F.lit(0.0)
    if elevation is not None:
        e = lambda a, b, n: elevation.select(F.col("x").alias(a), F.col("y").alias(b), F.col("value").alias(n))
        near = near.join(e("x", "y", "_z0"), ["x", "y"]).join(e("sx", "sy", "_z1"), ["sx", "sy"])
        dz = F.col("_z0") - F.col("_z1")
    own = Window.partitionBy("x", "y")
    unit = lambda c: c / F.coalesce(F.nullif(F.sqrt(F.sum(c * c).over(own)), F.lit(0.0)), F.lit(1.0))
    spread = unit(F.col("dist")) + unit(dz) * unit(dz)
    eps = 2.220446049250313e-16
    near = near.select("x", "y", "sx", "sy", F.pow(F.when(spread == 0, F.lit(eps)).otherwise(spread), F.lit(-power)).alias("_w"))
    triple = F.struct((F.col("x") * dim + F.col("y")).alias("c"), (F.col("sx") * dim + F.col("sy")).alias("n"), "_w")
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(triple)), lambda t: F.array(t["c"].cast("double"), t["n"].cast("double"), t["_w"])))
    packed = _with_layer(pack_frames(grid.where(F.col(value).isNotNull()), dim, frame, value), near.agg(flat.alias("a")).scalar())
    return kernels.fields(packed, dim, frame, lambda frames, table: kernels.fixed_neighbours(frames, table, dim), value, "_z").where(F.col(value).isNotNull())


def idw_all_points(grid: DataFrame, dim: int, power: float = 2.0, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """Every non-zero cell counts; exact hits pass; a lone point fades linearly within
    0.2*dim; no point gives a zero frame.

    Runs on packed frames; frames that report at the same cells share one weight matrix.
    """
    kernel = lambda frames, _: kernels.idw_all(frames, dim, power)
    return kernels.fields(pack_frames(grid, dim, frame, value), dim, frame, kernel, value)


def _nodes(extent: Extent, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude of every node, x = 0 in the north."""
    lon_min, lon_max, lat_min, lat_max = extent
    x, y = np.divmod(np.arange(dim * dim), dim)
    return lat_max - x * ((lat_max - lat_min) / (dim - 1)), lon_min + y * ((lon_max - lon_min) / (dim - 1))


def _station_fields(points: DataFrame, names: Sequence[str], extras: Sequence[str], extent: Extent, dim: int, frame: Sequence[str], order: str, weigh) -> DataFrame:
    """Fields of the columns ``names`` from the points of each frame, in order of ``order``.

    ``weigh`` makes the weights of a frame from its ``extras`` (arrays by point); see kernels.idw_nodes.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    item = F.struct(F.col(order).alias("o"), *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", *names, *extras)])
    packed = points.repartition(tasks, *frame).groupBy(*frame).agg(F.sort_array(F.collect_list(item)).alias("p"))
    packed = packed.select(*frame, *[F.col(f"p.{c}").alias(f"_{c}") for c in ("lat", "lon", *names, *extras)])
    schema = T.StructType([packed.schema[c] for c in frame] + [T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in names])
    nodes, size = _nodes(extent, dim), dim * dim
    x, y = (v.astype(np.int32) for v in np.divmod(np.arange(size), dim))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                own = pdf.iloc[[i]]
                column = lambda c: np.asarray(own[f"_{c}"].iloc[0], dtype=float)
                field = kernels.idw_nodes(column("lat"), column("lon"), np.stack([column(c) for c in names]), nodes, weigh(*[column(c) for c in extras]))
                keys = own[list(frame)].iloc[np.zeros(size, int)].reset_index(drop=True)
                yield pd.DataFrame({**{c: keys[c] for c in frame}, "x": x, "y": y, **dict(zip(names, field))})

    return packed.mapInPandas(run, schema)


def distance_weighted(points: DataFrame, extent: Extent, dim: int, power: float = 2.0, frame: Sequence[str] = ("ts",),
                      order: str = "sensor_id", value: str = "value") -> DataFrame:
    """All points weighted by lat/lon distance onto the grid nodes; an exact hit gives that
    node the point's value."""
    weigh = lambda: lambda d, _: np.where(d < 1e-10, 0.0, d ** -power)
    return _station_fields(points.where(F.col(value).isNotNull()), [value], [], extent, dim, frame, order, weigh)


def wind_idw(stations: DataFrame, elevation: DataFrame, extent: Extent, dim: int, power: float = 0.2,
             elevation_weight: float = 0.10, frame: Sequence[str] = ("ts",), order: str = "sensor_id") -> DataFrame:
    """U and V share their weights; the distance mixes horizontal distance with the elevation
    difference relative to the largest one of the node.

    Runs on packed frames; the elevation layer, dim*dim values of a static grid, goes with the kernel.
    """
    sx, sy = cell_of(extent, dim, mode="nodes")
    layer = elevation.select("x", "y", F.col("value").alias("_z"))
    at = (stations.where(F.col("u").isNotNull() & F.col("v").isNotNull())
                  .withColumn("x", F.lit(dim - 1) - sx).withColumn("y", sy).join(layer, ["x", "y"]).drop("x", "y"))
    z = np.asarray(elevation.select(packed_layer(elevation, dim)).first()[0], dtype=float)

    def weigh(zs):
        def weights(d, some):
            dz = np.abs(z[some][:, None] - zs)
            top = dz.max(1, keepdims=True)
            return 1 / ((d + elevation_weight * dz / np.where(top > 0, top, 1.0)) ** power + 1e-6)
        return weights

    return _station_fields(at, ["u", "v"], ["_z"], extent, dim, frame, order, weigh)


def fill_nearest(grid: DataFrame, dim: int, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """Every missing cell takes its frame's nearest value, ties by (x, y)."""
    kernel = lambda frames, _: [kernels.nearest_frame(c, v, dim) for c, v in frames]
    return kernels.fields(pack_frames(grid, dim, frame, value), dim, frame, kernel, value)


def nearest_point(cloud: DataFrame, extent: Extent, dim: int, order: str, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """Point cloud to a regular lat/lon grid, nearest point per node, x = 0 in the north.

    Distances count in node spacings.  Points fall into buckets one spacing wide, which go on beyond the grid, and every
    bucket is reduced to its best point, a combinable aggregate that a crowded bucket cannot overload.  A bucket
    further from the grid than some point is from all of it is left out.  The packed buckets of a frame bound every node's
    distance, by its own bucket's best point or else by the way to a bucket and from there to its best point, and name
    the buckets that reach into the ring inside this bound.  Nodes join the points of these buckets; nothing nearer
    can lie elsewhere.
    """
    lon_min, lon_max, lat_min, lat_max = extent
    fx = (F.lit(lat_max) - F.col("lat")) / ((lat_max - lat_min) / (dim - 1))
    fy = (F.col("lon") - F.lit(lon_min)) / ((lon_max - lon_min) / (dim - 1))
    frame, keys = list(frame), [*frame, "bx", "by"]
    away = lambda x, y: F.round(F.pow(F.col("_fx") - F.col(x), 2) + F.pow(F.col("_fy") - F.col(y), 2), 12)
    points = cloud.where(F.col(value).isNotNull()).select(
        *frame, fx.alias("_fx"), fy.alias("_fy"), F.rint(fx).cast("long").alias("bx"), F.rint(fy).cast("long").alias("by"), F.col(order).alias("_o"), value)
    own = points.groupBy(*keys).agg(F.sqrt(F.min(away("bx", "by"))).alias("_own"))
    gap = lambda c: F.greatest(F.abs(F.col(c) - (dim - 1) / 2) - dim / 2, F.lit(0.0))
    span = lambda c: F.abs(F.col(c) - (dim - 1) / 2) + (dim - 1) / 2
    low, high = F.hypot(gap("bx"), gap("by")), F.hypot(span("bx"), span("by")) + F.col("_own")
    reach = own.groupBy(*frame).agg(F.min(high).alias("_reach"))
    near = own.join(reach, frame).where(low <= F.col("_reach") + 1e-6)
    packed = near.groupBy(*frame).agg(F.collect_list(F.struct("bx", "by", F.col("_own").alias("d"))).alias("_b"))
    wanted = kernels.ring_pairs(packed, dim, frame)
    return wanted.join(points, keys).groupBy(*frame, "x", "y").agg(F.min_by(value, F.struct(away("x", "y"), F.col("_o"))).alias(value))


def linear_point(cloud: DataFrame, extent: Extent, dim: int, order: str, frame: Sequence[str] = ("ts",), value: str = "value", outside: float | None = None) -> DataFrame:
    """G14, linear: the plane through the corners of the Delaunay triangle that holds a node, x = 0 in the north.

    Positions count in degrees.  Outside the hull of a frame's points, and in a frame whose points lie on one line,
    nodes take the nearest point, ties by ``order``, or the constant ``outside``.  Points without value do not
    count; of several in one place the first by ``order`` does.  A frame goes to one task as a whole, so cut the cloud
    to the window around the extent first (G15).  Frames of the same points share triangles and weights in a task.
    """
    tasks = int(cloud.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frame = list(frame)
    places = cloud.where(F.col(value).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    first = places.groupBy(*frame, "lat", "lon").agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))).alias("_p"))
    item = F.struct(F.col("_p.o").alias("o"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("_p.v").alias("v"))
    packed = first.repartition(tasks, *frame).groupBy(*frame).agg(F.sort_array(F.collect_list(item)).alias("p"))
    packed = packed.select(*frame, *[F.col(f"p.{c}").alias(f"_{c}") for c in ("lat", "lon", "v")])
    schema = T.StructType([packed.schema[c] for c in frame] + [T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField(value, T.DoubleType())])
    nodes, size = _nodes(extent, dim), dim * dim
    x, y = (v.astype(np.int32) for v in np.divmod(np.arange(size), dim))
    step = kernels.frames_at_once(size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i:i + step]
                frames = [tuple(np.asarray(v, dtype=float) for v in r) for r in zip(part["_lat"], part["_lon"], part["_v"])]
                out = triangulation.linear_fields(frames, nodes, outside)
                yield pd.DataFrame({**{c: part[c].repeat(size).reset_index(drop=True) for c in frame},
                                    "x": np.tile(x, len(part)), "y": np.tile(y, len(part)), value: np.concatenate(out)})

    return packed.mapInPandas(run, schema)


def box_blur(grid: DataFrame, radii: DataFrame, dim: int, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """Mean over the in-bounds square of each cell's own radius.

    Sums over rectangles of packed frames; the radii ride on the first row of each partition.
    """
    packed = _with_layer(pack_frames(grid, dim, frame, value), packed_layer(radii, dim, "radius"))
    return kernels.fields(packed, dim, frame, lambda frames, r: kernels.box_means(frames, r, dim), value, "_z").where(F.col(value).isNotNull())


def residuals(sensor_grid: DataFrame, model_grid: DataFrame, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    model = model_grid.select(*frame, "x", "y", F.col(value).alias("_m"))
    return sensor_grid.join(model, [*frame, "x", "y"]).select(*frame, "x", "y", (F.col(value) - F.col("_m")).alias(value))


def semivariogram(grid: DataFrame, dim: int, lags: int = 10, frame: Sequence[str] = ("ts",), value: str = "value", bins: str = "equal") -> DataFrame:
    """Half the mean squared difference per distance bin, of equal width or by clusters of distance
    (``bins="cluster"``); pairs are summed per offset inside the task and never leave it."""
    packed = pack_frames(grid, dim, frame, value)
    bins = packed.select(*frame, F.explode(kernels.variogram_udf(dim, lags, bins)("cells", "values")).alias("b"))
    return bins.select(*frame, "b.*")


def residual_kriging(sensor_grid: DataFrame, model_grid: DataFrame, dim: int, lags: int = 10, min_points: int = 3,
                     max_points: int = 25, frame: Sequence[str] = ("ts",), value: str = "value", bins: str = "equal") -> DataFrame:
    """Kriged (sensor - model) residuals added to the model field, one variogram per frame."""
    packed = pack_frames(residuals(sensor_grid, model_grid, frame, value), dim, frame, value)
    kernel = lambda frames, _: [kernels.kriging_frame(c, v, dim, lags, min_points, max_points, bins) for c, v in frames]
    field = kernels.fields(packed, dim, frame, kernel, "_res")
    return (model_grid.join(field, [*frame, "x", "y"], "left")
                      .select(*frame, "x", "y", (F.col(value) + F.coalesce("_res", F.lit(0.0))).alias(value)))
