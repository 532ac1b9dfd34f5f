"""Augmentation of gridded samples by cell remaps.

Rows are (sample keys..., channel, x, y, value) on an n x n north-up grid.  Wind channels come in
(U, V) pairs whose vector turns with the field.  The exact remaps are column expressions and
shuffle nothing; a component that becomes the other one only changes its channel label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hourgrid.operators import raster as R

#: Output rows that a task holds before it passes them on.
OUT_ROWS = 200_000

# Names, angles and factors of the variant set, in output order.
EXACT = ("h-flip", "v-flip", "hv-flip", "rot90", "rot270", "transpose", "anti-transpose")
ANGLES = (45, 135, 225, 315)
ZOOMS = (("zoom-in-1.2x", 1.2), ("zoom-out-0.8x", 0.8))
ZOOM_SUFFIX = (("zin1.2", 1.2), ("zout0.8", 0.8))
VARIANTS = (EXACT + tuple(f"rot{a}" for a in ANGLES) + tuple(z for z, _ in ZOOMS)
            + tuple(f"rot{a}_{z}" for a in ANGLES for z, _ in ZOOM_SUFFIX))


def _place(variant: str, n: int) -> tuple[Column, Column]:
    """Where the pixel at (x, y) goes."""
    x, y, far = F.col("x"), F.col("y"), F.lit(n - 1)
    return {
        "h-flip": (x, far - y), "v-flip": (far - x, y), "hv-flip": (far - x, far - y),
        "rot90": (far - y, x), "rot270": (y, far - x),
        "transpose": (y, x), "anti-transpose": (far - y, far - x),
    }[variant]


# Sign of U and V after the remap, and whether they trade places, on a north-up grid: (U from, V from).
_WIND = {
    "h-flip": (("u", -1), ("v", 1)), "v-flip": (("u", 1), ("v", -1)), "hv-flip": (("u", -1), ("v", -1)),
    "rot90": (("v", -1), ("u", 1)), "rot270": (("v", 1), ("u", -1)),
    "transpose": (("v", -1), ("u", -1)), "anti-transpose": (("v", 1), ("u", 1)),
}
# The strict rule keeps the field of wind components unturned and these signs (south-up convention).
_WIND_STRICT = {
    "rot90": (("v", 1), ("u", -1)), "rot270": (("v", -1), ("u", 1)),
    "transpose": (("v", 1), ("u", 1)), "anti-transpose": (("v", -1), ("u", -1)),
}


def _image(variant: str, n: int, wind: Sequence[tuple[str, str]], strict: bool) -> Column:
    frozen = strict and variant in _WIND_STRICT
    (u_from, u_sign), (v_from, v_sign) = (_WIND_STRICT if frozen else _WIND)[variant]
    px, py = _place(variant, n)
    channel, sign, is_wind = F.col("channel"), F.lit(1.0), F.lit(False)
    for u, v in wind:
        source = {"u": u, "v": v}
        for target, origin, s in ((u, source[u_from], u_sign), (v, source[v_from], v_sign)):
            hit = F.col("channel") == origin
            channel = F.when(hit, F.lit(target)).otherwise(channel)
            sign = F.when(hit, F.lit(float(s))).otherwise(sign)
        is_wind = is_wind | F.col("channel").isin(u, v)
    stay = is_wind & F.lit(frozen)
    return F.struct(F.lit(variant).alias("variant"), channel.alias("channel"),
                    F.when(stay, F.col("x")).otherwise(px).cast("int").alias("x"),
                    F.when(stay, F.col("y")).otherwise(py).cast("int").alias("y"), (F.col("value") * sign).alias("value"))


def exact_variants(samples: DataFrame, n: int, wind: Sequence[tuple[str, str]] = (), strict: bool = False,
                   variants: Sequence[str] = EXACT) -> DataFrame:
    """X1-X7 in one pass: each row is unrolled into its images.  Without ``wind`` these are the
    target counterparts (X8).

    ``strict`` repeats the published rule of the quarter turns and transposes, which turns scalar
    channels but leaves the wind field in place.
    """
    rest = [c for c in samples.columns if c not in ("channel", "x", "y", "value")]
    images = F.explode(F.array(*[_image(v, n, wind, strict) for v in variants]))
    return samples.select(*rest, images.alias("_m")).select(*rest, "_m.*")


def resampled(samples: DataFrame, maps: Sequence[tuple[float, float, R.Taps]], n: int, wind: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Every (degrees, factor, map) applied to every sample, a packed sample at a time.

    Both wind components are resampled and then turned together.  A missing input pixel makes the
    output missing; outputs that use no pixel of the sample have no row.
    """
    rest = [c for c in samples.columns if c not in ("channel", "x", "y", "value")]
    point = F.struct("channel", (F.col("x") * n + F.col("y")).cast("int").alias("cell"), F.col("value").cast("double").alias("v"))
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = samples.repartition(tasks, *rest).groupBy(*rest).agg(F.collect_list(point).alias("p")).select(*rest, "p.channel", "p.cell", F.col("p.v").alias("_v"))
    fields = [packed.schema[c] for c in rest] + [T.StructField("channel", T.StringType()), T.StructField("degrees", T.DoubleType()), T.StructField("factor", T.DoubleType()),
                                                 T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("value", T.DoubleType())]
    plans = [(d, f, m, np.unique(m.out, return_index=True)) for d, f, m in maps]

    def images(channel, cell, v):
        """(channel, degrees, factor, cells, values) of one sample."""
        names = list(dict.fromkeys([*channel, *(c for pair in wind if set(pair) & set(channel) for c in pair)]))
        row = np.array([names.index(c) for c in channel])
        field, seen = np.full((len(names), n * n), np.nan), np.zeros((len(names), n * n), bool)
        field[row, cell], seen[row, cell] = v, True
        for degrees, factor, m, (out, start) in plans:
            value = np.add.reduceat(field[:, m.source] * m.weight, start, axis=1)
            used = np.add.reduceat(seen[:, m.source], start, axis=1, dtype=int) > 0
            if degrees:
                c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
                for a, b in ((names.index(a), names.index(b)) for a, b in wind if a in names):
                    value[a], value[b] = c * value[a] - s * value[b], s * value[a] + c * value[b]
                    used[a] = used[b] = used[a] | used[b]
            for k, name in enumerate(names):
                yield name, degrees, factor, out[used[k]], value[k, used[k]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size = [], 0
            for i in range(len(pdf)):
                own = pdf.iloc[i]
                for name, degrees, factor, cells, value in images(list(own["channel"]), np.asarray(own["cell"], int), np.asarray(own["_v"], float)):
                    held.append((i, name, degrees, factor, cells, value))
                    size += len(cells)
                if size > OUT_ROWS or i == len(pdf) - 1:
                    count = [len(h[4]) for h in held]
                    x, y = np.divmod(np.concatenate([h[4] for h in held]), n)
                    keys = pdf.iloc[np.repeat([h[0] for h in held], count)].reset_index(drop=True)
                    yield pd.DataFrame({**{c: keys[c] for c in rest}, "channel": np.repeat([h[1] for h in held], count), "degrees": np.repeat([float(h[2]) for h in held], count),
                                        "factor": np.repeat([float(h[3]) for h in held], count), "x": x.astype(np.int32), "y": y.astype(np.int32), "value": np.concatenate([h[5] for h in held])})
                    held, size = [], 0

    return packed.mapInPandas(run, T.StructType(fields))


def rotated(samples: DataFrame, n: int, degrees: Sequence[float] = ANGLES, wind: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """X9"""
    return resampled(samples, [(d, 1.0, R.rotation_taps(n, d)) for d in degrees], n, wind)


def zoomed(samples: DataFrame, n: int, factors: Sequence[float]) -> DataFrame:
    """X10"""
    return resampled(samples, [(0.0, f, R.zoom_taps(n, f)) for f in factors], n)


def _both(n: int, degrees: Sequence[float], factors: Sequence[float]) -> list[tuple[float, float, R.Taps]]:
    return [(d, f, R.compose(R.rotation_taps(n, d), R.zoom_taps(n, f), n)) for d in degrees for f in factors]


def rotated_zoomed(samples: DataFrame, n: int, degrees: Sequence[float], factors: Sequence[float], wind: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """X11: rotation, then zoom."""
    return resampled(samples, _both(n, degrees, factors), n, wind)


def variant_label() -> Column:
    """Name of a resampled variant from its angle and factor."""
    turn = F.concat(F.lit("rot"), F.col("degrees").cast("int").cast("string"))
    plain, suffix = F.lit(None).cast("string"), F.lit("")
    for name, f in ZOOMS:
        plain = F.when(F.col("factor") == f, name).otherwise(plain)
    for name, f in ZOOM_SUFFIX:
        suffix = F.when(F.col("factor") == f, "_" + name).otherwise(suffix)
    return F.when(F.col("degrees") == 0, plain).otherwise(F.concat(turn, suffix))


def all_variants(samples: DataFrame, n: int, wind: Sequence[tuple[str, str]] = (), strict: bool = False) -> DataFrame:
    """The 21 variants with their label and position in the published order.

    Two passes over the samples: one unrolls the exact variants, one applies all resampling maps.
    """
    factors = [f for _, f in ZOOMS]
    maps = [(d, 1.0, R.rotation_taps(n, d)) for d in ANGLES] + [(0.0, f, R.zoom_taps(n, f)) for f in factors] + _both(n, ANGLES, factors)
    soft = resampled(samples, maps, n, wind).withColumn("variant", variant_label()).drop("degrees", "factor")
    out = exact_variants(samples, n, wind, strict).unionByName(soft)
    position = F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), F.col("variant")) - 1
    return out.withColumn("variant_no", position.cast("int"))


def variant_offsets(samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """First row of each variant in the stacked output."""
    labels = F.explode(F.array(*[F.struct(F.lit(i).alias("variant_no"), F.lit(v).alias("variant")) for i, v in enumerate(VARIANTS)]))
    n = samples.select(sample).distinct().agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", labels.alias("l")).select("l.variant_no", "l.variant", (F.col("l.variant_no") * F.col("n")).alias("first_row"))
