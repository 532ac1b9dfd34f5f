"""Built-in column expressions shared by the operators.  Everything here stays in codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

Extent = tuple[float, float, float, float]  # lon_min, lon_max, lat_min, lat_max


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(text: str | Column) -> Column:
    return (F.lit(text) if isinstance(text, str) else text).cast("timestamp_ntz")


def nan_to_null(c: str | Column) -> Column:
    """Missing is NULL inside the library: Spark averages skip NULL but propagate NaN."""
    return F.when(~F.isnan(col(c)), col(c))


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct-valued scalar subquery (computed once, never joined)."""
    return df.select(F.struct(*df.columns).alias("s")).scalar()


# ---------------------------------------------------------------- time
def hour_floor(ts: str | Column) -> Column:
    return F.date_trunc("hour", col(ts)).cast("timestamp_ntz")


def plus_hours(ts: str | Column, n) -> Column:
    return F.timestamp_add("HOUR", n if isinstance(n, Column) else F.lit(n), col(ts))


def hour_ceil(ts: str | Column) -> Column:
    """A report exactly on the hour keeps it, any later one moves to the next."""
    low = hour_floor(ts)
    return F.when(low == col(ts), low).otherwise(plus_hours(low, 1))


def hour_index(ts: str | Column, start: str | Column = "1970-01-01") -> Column:
    """Whole hours since ``start``: the position on an hourly axis without any window."""
    return F.timestamp_diff("HOUR", ntz(start), col(ts))


def hour_round(ts: str | Column) -> Column:
    """Nearest hour, exact halves to the even hour since the epoch."""
    low = hour_floor(ts)
    micros = F.timestamp_diff("MICROSECOND", low, col(ts))
    half = F.lit(1_800_000_000)
    up = (micros > half) | ((micros == half) & (hour_index(low) % 2 == 1))
    return F.when(up, plus_hours(low, 1)).otherwise(low)


def local_time(ts: str | Column, zone: str) -> Column:
    """UTC wall clock to local wall clock."""
    return F.from_utc_timestamp(col(ts).cast("timestamp"), zone).cast("timestamp_ntz")


def model_run(ts: str | Column) -> tuple[Column, Column]:
    """Newest six-hourly run at least 24 h before ``ts``, and the lead in hours."""
    back = plus_hours(ts, -24)
    day = F.date_trunc("day", back).cast("timestamp_ntz")
    run = plus_hours(day, (F.floor(F.hour(back) / 6) * 6).cast("int"))
    return run, F.timestamp_diff("HOUR", run, col(ts))


# Largest value of each calendar field, the divisor of the cyclical encoding.
CYCLE_MAX = {"month": 12, "day": 31, "weekday": 6, "hour": 23}


def calendar_field(ts: str | Column, field: str) -> Column:
    c = col(ts)
    return {"month": F.month(c), "day": F.dayofmonth(c), "weekday": F.dayofweek(c) - 1, "hour": F.hour(c)}[field]


def cyclical(ts: str | Column, field: str) -> tuple[Column, Column]:
    """Sine and cosine of 2*pi*value/max (hour 0 and hour 23 coincide by contract)."""
    angle = calendar_field(ts, field) * (2 * math.pi) / CYCLE_MAX[field]
    return F.sin(angle), F.cos(angle)


def linear_time(ts: str | Column, field: str) -> Column:
    return calendar_field(ts, field) / F.lit(float(CYCLE_MAX[field]))


def one_hot(value: Column, categories: Sequence[int], prefix: str) -> list[Column]:
    """One 0/1 flag per category."""
    return [(value == k).cast("int").alias(f"{prefix}_{k}") for k in categories]


# ---------------------------------------------------------------- value rules
def negative_to_null(v: str | Column) -> Column:
    """F8"""
    return F.when(col(v) >= 0, col(v))


def floor_low(v: str | Column, floor: float = 1.0) -> Column:
    """values strictly between 0 and ``floor`` become ``floor``; zeros stay."""
    return F.when((col(v) > 0) & (col(v) < floor), F.lit(floor)).otherwise(col(v))


def negative_to_zero(v: str | Column) -> Column:
    """F10"""
    return F.when(col(v) < 0, F.lit(0.0)).otherwise(col(v))


def cap_to_null(v: str | Column, cap: float, inclusive: bool = False) -> Column:
    """null above the cap; ``inclusive`` nulls the cap itself as well."""
    return F.when(~(col(v) >= cap if inclusive else col(v) > cap), col(v))


def kelvin_floor(v: str | Column, limit: float = 100.0) -> Column:
    """surface temperatures at or below ``limit`` K are no observation."""
    return F.when(col(v) > limit, col(v))


def optical_depth_range(v: str | Column) -> Column:
    """[-0.1, 0) -> 0; below -0.1 or above 5 -> missing."""
    c = col(v)
    return F.when((c < -0.1) | (c > 5), None).when(c < 0, F.lit(0.0)).otherwise(c)


def nodata_to_zero(v: str | Column, nodata: float, below: float = -100.0) -> Column:
    """F20"""
    return F.when((col(v) == nodata) | (col(v) < below), F.lit(0.0)).otherwise(col(v))


def clip_normalise(v: str | Column, low: float = 270.0, span: float = 60.0) -> Column:
    """clip((v - low) / span, 0, 1); missing -> 0."""
    return F.coalesce(F.least(F.greatest((col(v) - low) / span, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


# Unit factors per quantity.
UNIT_FACTORS = {
    "smoke_mass": 1e9,
    "no2_column": 1e-16,
    "vegetation_index": 0.0001,
    "knots_to_mph": 1.15078,
}


def scale_unit(v: str | Column, quantity: str) -> Column:
    """T26 with a named factor; the column density divides, so as not to lose digits."""
    if quantity == "no2_column":
        return col(v) / 1e16
    return col(v) * UNIT_FACTORS[quantity]


def scale_offset(v: str | Column, scale: str | Column, offset: str | Column, fill: str | Column | None = None) -> Column:
    """Packed integer to physical value; the fill code becomes NULL."""
    out = col(v) * col(scale) + col(offset)
    return out if fill is None else F.when(col(v) != col(fill), out)


# Flag codes of the two accepted quality levels per product.
QUALITY_CODES = {"aerosol_depth": (0, 1), "fire": (0, 1)}
SMOKE_BITS = 0b1100
SMOKE_CODES = {"with_index": (0, 4), "without_index": (12, 4)}


def quality_categorical(flag: str | Column, product: str) -> Column:
    """F13"""
    return col(flag).isin(*QUALITY_CODES[product])


def quality_bits(flag: str | Column, has_index: str | Column) -> Column:
    """bits 2-3 of the flag; accepted codes depend on whether the index layer exists."""
    bits = col(flag).cast("int").bitwiseAND(SMOKE_BITS)
    return F.when(col(has_index), bits.isin(*SMOKE_CODES["with_index"])).otherwise(
        bits.isin(*SMOKE_CODES["without_index"]))


def quality_cloud(value: str | Column, qa: str | Column, cloud: str | Column, cloud_below: float = 0.5) -> Column:
    """F15"""
    return F.when((col(qa) <= 0) & (col(cloud) < cloud_below), col(value))


def quality_score(value: str | Column, qa: str | Column, above: float = 0.75) -> Column:
    """F16"""
    return F.when(col(qa) > above, col(value))


# ---------------------------------------------------------------- wind
def wind_components(speed: str | Column, direction: str | Column) -> tuple[Column, Column]:
    """Meteorological direction (degrees from) to eastward and northward parts."""
    angle = F.radians(col(direction))
    return -col(speed) * F.sin(angle), -col(speed) * F.cos(angle)


def wind_to_earth(u: str | Column, v: str | Column, lon: str | Column,
                  lon_ref: float = -97.5, lat_ref: float = 38.5) -> tuple[Column, Column]:
    """Rotate model-grid wind to earth-relative wind."""
    alpha = F.atan(F.tan(F.radians(col(lon) - lon_ref)) * math.sin(math.radians(lat_ref)))
    return (col(u) * F.cos(alpha) + col(v) * F.sin(alpha), -col(u) * F.sin(alpha) + col(v) * F.cos(alpha))


# ---------------------------------------------------------------- position
def in_extent(extent: Extent, lat: str | Column = "lat", lon: str | Column = "lon", inclusive: bool = True) -> Column:
    """inclusive bounds; ``inclusive=False`` is the strict variant."""
    lon_min, lon_max, lat_min, lat_max = extent
    if inclusive:
        return col(lat).between(lat_min, lat_max) & col(lon).between(lon_min, lon_max)
    return (col(lat) > lat_min) & (col(lat) < lat_max) & (col(lon) > lon_min) & (col(lon) < lon_max)


def check_extent(extent: Extent) -> Extent:
    """F2 for a parameter."""
    lon_min, lon_max, lat_min, lat_max = extent
    if not (lon_min < lon_max and lat_min < lat_max):
        raise ValueError("extent minimum must be below its maximum")
    if not (-180 <= lon_min and lon_max <= 180 and -90 <= lat_min and lat_max <= 90):
        raise ValueError("extent is off the globe")
    return extent


def extent_ok(lon_min: str, lon_max: str, lat_min: str, lat_max: str) -> Column:
    """F2 for a table of extents."""
    return ((col(lon_min) < col(lon_max)) & (col(lat_min) < col(lat_max))
            & (col(lon_min) >= -180) & (col(lon_max) <= 180) & (col(lat_min) >= -90) & (col(lat_max) <= 90))


def clamp(c: Column, dim: int) -> Column:
    return F.greatest(F.lit(0), F.least(c, F.lit(dim - 1)))


def cell_of(extent: Extent, dim: int, lat: str | Column = "lat", lon: str | Column = "lon",
            mode: str = "standard") -> tuple[Column, Column]:
    """G1: cell of a position, x = 0 in the north.

    ``west`` (G1b) measures y from the eastern edge with |lon|; ``nodes`` (G1c) scales by dim - 1
    and puts x = 0 in the south, as the elevation lookup does.
    """
    lon_min, lon_max, lat_min, lat_max = extent
    lat_span, lon_span = lat_max - lat_min, lon_max - lon_min
    x = ((F.lit(lat_max) - col(lat)) / lat_span * dim).cast("int")
    y = ((col(lon) - F.lit(lon_min)) / lon_span * dim).cast("int")
    if mode == "west":
        y = F.lit(dim) - ((F.lit(lon_max) + F.abs(col(lon))) / lon_span * dim).cast("int")
    elif mode == "nodes":
        x = ((col(lat) - F.lit(lat_min)) / lat_span * (dim - 1)).cast("int")
        y = ((col(lon) - F.lit(lon_min)) / lon_span * (dim - 1)).cast("int")
    return clamp(x, dim), clamp(y, dim)


def corner_of(extent: Extent, dim: int, x: str | Column = "x", y: str | Column = "y") -> tuple[Column, Column]:
    """Latitude and longitude of a cell's upper-left corner."""
    lon_min, lon_max, lat_min, lat_max = extent
    return (F.lit(lat_max) - col(x) * ((lat_max - lat_min) / dim),
            F.lit(lon_min) + col(y) * ((lon_max - lon_min) / dim))


def flip_rows(dim: int, x: str | Column = "x") -> Column:
    """G19"""
    return F.lit(dim - 1) - col(x)


