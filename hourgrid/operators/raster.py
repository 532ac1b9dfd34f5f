"""Resampling of frames.

A linear resample is a sparse matrix that depends on the grid alone.  Frames are packed once, one row
each, and multiplied by it inside the task: one shuffle, and as many rows out as there are outputs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from hourgrid.functions import kernels


def _mirror(i: np.ndarray, n: int) -> np.ndarray:
    """Index into a line extended by mirroring at its outer edges (edge pixel repeated)."""
    m = np.mod(i, 2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def _mirror_inner(i: np.ndarray, n: int) -> np.ndarray:
    """Index into a line extended by mirroring at its edge pixels (edge pixel not repeated)."""
    if n == 1:
        return np.zeros_like(i)
    m = np.mod(i, 2 * n - 2)
    return np.where(m < n, m, 2 * n - 2 - m)


def _linear(source: np.ndarray, n_in: int) -> np.ndarray:
    """Matrix of linear interpolation at the given positions of a line."""
    low = np.floor(source).astype(int)
    out = np.zeros((len(source), n_in))
    at = np.arange(len(source))
    np.add.at(out, (at, low), 1 - (source - low))
    np.add.at(out, (at, np.minimum(low + 1, n_in - 1)), source - low)
    return out


def resize_line(n_in: int, n_out: int, rule: str) -> np.ndarray:
    """Matrix of one axis: ``half_pixel`` (G17) or ``corner`` (G18) linear resize."""
    o = np.arange(n_out, dtype=float)
    if rule == "half_pixel":
        source = (o + 0.5) * (n_in / n_out) - 0.5
    elif rule == "corner":
        source = o * ((n_in - 1) / (n_out - 1)) if n_out > 1 else np.zeros(1)
    else:
        raise ValueError(rule)
    return _linear(np.clip(source, 0.0, n_in - 1.0), n_in)


def gaussian_line(n: int, sigma: float, border: str = "reflect") -> np.ndarray:
    """Matrix of one axis of a Gaussian kernel cut at int(4*sigma + 0.5)."""
    r = int(4 * sigma + 0.5)
    step = np.arange(-r, r + 1)
    weight = np.exp(-0.5 * (step / sigma) ** 2)
    o = np.repeat(np.arange(n), len(step))
    i, w = o + np.tile(step, n), np.tile(weight / weight.sum(), n)
    if border == "constant":
        o, i, w = (v[(i >= 0) & (i < n)] for v in (o, i, w))
    else:
        i = _mirror(i, n)
    out = np.zeros((n, n))
    np.add.at(out, (o, i), w)
    return out


def zoom_line(n: int, factor: float) -> np.ndarray:
    """X10, one axis: corner-aligned zoom, then centre crop (> 1) or mirrored padding (< 1)."""
    m = round(n * factor)
    o = np.arange(n)
    line = o + (m - n) // 2 if m >= n else _mirror_inner(o - (n - m) // 2, m)
    return _linear(line * ((n - 1) / (m - 1)), n)


def pack_points(grid: DataFrame, frame: Sequence[str], value: str = "value") -> DataFrame:
    """One row per frame with its pixels, missing ones included.  A frame has at most as many as its lattice."""
    tasks = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    point = F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("double").alias("v"))
    return grid.repartition(tasks, *frame).groupBy(*frame).agg(F.collect_list(point).alias("points"))


def resize(grid: DataFrame, shape_in: tuple[int, int], dim: int, rule: str = "half_pixel",
           frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """G17 (``half_pixel``) and G18 (``corner``); a missing input pixel makes the output pixel missing."""
    rows, cols = (resize_line(n, dim, rule) for n in shape_in)
    return kernels.separable(pack_points(grid, frame, value), rows, cols, frame, value)


def gaussian(grid: DataFrame, shape: tuple[int, int], sigma: float, border: str = "reflect",
             only_positive: bool = False, frame: Sequence[str] = ("ts",), value: str = "value") -> DataFrame:
    """G20; with ``only_positive`` frames without any value above zero pass through."""
    rows, cols = (gaussian_line(n, sigma, border) for n in shape)
    packed = pack_points(grid, frame, value)
    if not only_positive:
        return kernels.separable(packed, rows, cols, frame, value)
    lit = F.exists("points", lambda p: F.coalesce(p["v"] > 0, F.lit(False)))
    rest = packed.where(~lit).select(*frame, F.explode("points").alias("p")).select(*frame, "p.x", "p.y", F.col("p.v").alias(value))
    return kernels.separable(packed.where(lit), rows, cols, frame, value).unionByName(rest)


@dataclass(frozen=True)
class Taps:
    """A sparse map of n x n cells to n x n cells: out[o] = sum of weight * in[i], entries ordered by o."""

    out: np.ndarray
    source: np.ndarray
    weight: np.ndarray


def _taps(out: np.ndarray, source: np.ndarray, weight: np.ndarray, size: int) -> Taps:
    """Entries of one pair of cells are added up; zero weights do not count as a tap."""
    keep = weight != 0
    pair, inverse = np.unique(out[keep] * size + source[keep], return_inverse=True)
    return Taps(pair // size, pair % size, np.bincount(inverse, weight[keep], len(pair)))


def _rotation_terms(n: int, degrees: float) -> tuple[float, ...]:
    """cos, sin, offsets of the source position and first kept output row and column."""
    t = math.radians(degrees)
    c, s = math.cos(t), math.sin(t)
    # Bounding box of the rotated square.
    corners = [(c * a + s * b, -s * a + c * b) for a in (0, n) for b in (0, n)]
    size = [int(max(p[k] for p in corners) - min(p[k] for p in corners) + 0.5) for k in (0, 1)]
    mid = [(v - 1) / 2 for v in size]
    return (c, s, (n - 1) / 2 - (c * mid[0] + s * mid[1]), (n - 1) / 2 - (-s * mid[0] + c * mid[1]),
            float((size[0] - n) // 2), float((size[1] - n) // 2))


def rotation_taps(n: int, degrees: float) -> Taps:
    """X9 on a square grid: rotation into the bounding box, mirrored outside, then a centre crop."""
    c, s, bx, by, cx, cy = _rotation_terms(n, degrees)
    cell = np.arange(n * n)
    ux, uy = cell // n + cx, cell % n + cy
    sx, sy = ux * c + uy * s + bx, -ux * s + uy * c + by
    lx, ly = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - lx, sy - ly
    parts = [(cell, _mirror(lx + dx, n) * n + _mirror(ly + dy, n), (fx if dx else 1 - fx) * (fy if dy else 1 - fy)) for dx in (0, 1) for dy in (0, 1)]
    return _taps(*(np.concatenate(p) for p in zip(*parts)), n * n)


def zoom_taps(n: int, factor: float) -> Taps:
    """The product of its two lines."""
    o, i = np.nonzero(line := zoom_line(n, factor))
    w = line[o, i]
    return _taps((o[:, None] * n + o).ravel(), (i[:, None] * n + i).ravel(), np.outer(w, w).ravel(), n * n)


def compose(first: Taps, then: Taps, n: int) -> Taps:
    """X11: the map of applying ``first`` and then ``then``."""
    start = np.searchsorted(first.out, np.arange(n * n + 1))
    count = (start[1:] - start[:-1])[then.source]
    entry = np.repeat(np.arange(len(then.out)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[then.source][entry]
    return _taps(then.out[entry], first.source[inner], then.weight[entry] * first.weight[inner], n * n)
