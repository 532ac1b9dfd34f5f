"""Per-frame numpy kernels that Spark runs on Arrow batches.

A frame arrives as two arrays (cell index, value) that hold at most dim*dim entries, whatever
the number of raw readings, because readings are merged per cell before.  Each kernel returns
a dense field of dim*dim doubles per frame; frames are independent and spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

_CHUNK = 4_000_000      # distances held at once


def frames_at_once(size: int) -> int:
    """Dense fields of ``size`` cells held at once."""
    return max(1, _CHUNK // (2 * size))


def _by_distance(cells, points, z, dim):
    """All points of each cell in order of distance, with the squared distances; ``points`` is
    sorted and the sort is stable, so ties go to the smaller (x, y)."""
    d2 = ((cells // dim)[:, None] - points // dim) ** 2.0 + ((cells % dim)[:, None] - points % dim) ** 2.0
    if z is not None:
        d2 += (z[cells][:, None] - z[points]) ** 2
    order = np.argsort(d2, axis=1, kind="stable")
    return order, np.take_along_axis(d2, order, axis=1)


def idw_batch(frames: list[tuple[np.ndarray, np.ndarray]], z: np.ndarray | None, dim: int, power: float, k: int) -> list[np.ndarray]:
    """Inverse-distance fields of a batch of frames.

    The order of the neighbours depends on the cells only, so it is computed once for all points
    of the batch.  A frame that misses m of them finds its k nearest reporting ones among the
    first k + m columns.
    """
    out = [np.full(dim * dim, np.nan) for _ in frames]
    union = np.unique(np.concatenate([p for p, _ in frames])) if frames else np.empty(0, dtype=np.int64)
    if len(union) == 0:
        return out
    rows = []
    for points, values in frames:
        row = np.full(len(union), np.nan)
        row[np.searchsorted(union, points)] = values
        rows.append(row)
    with np.errstate(divide="ignore", invalid="ignore"):
        for cells in np.array_split(np.arange(dim * dim), dim * dim * len(union) // _CHUNK + 1):
            order, d2 = _by_distance(cells, union, z, dim)
            weight = d2 ** (-power / 2)
            for field, row in zip(out, rows):
                present = ~np.isnan(row)
                width = min(len(union), k + int((~present).sum()))
                near = order[:, :width]
                keep = present[near]
                keep &= np.cumsum(keep, axis=1) <= k
                w = np.where(keep, weight[:, :width], 0.0)
                field[cells] = (w * np.nan_to_num(row)[near]).sum(axis=1) / w.sum(axis=1)
    for field, (points, values) in zip(out, frames):
        field[points] = values
    return out


def idw_all(frames: list[tuple[np.ndarray, np.ndarray]], dim: int, power: float) -> list[np.ndarray]:
    """Fields of all non-zero points of each frame; frames with the same points share their weights."""
    cells, out, held, weight = np.arange(dim * dim), [], None, None
    for points, values in frames:
        points, values = points[values != 0], values[values != 0]
        if len(points) < 2:
            field = np.zeros(dim * dim)
            if len(points):
                d = np.hypot(cells // dim - points[0] // dim, cells % dim - points[0] % dim)
                field = np.where(d < 0.2 * dim, values[0] * (1 - d / (0.2 * dim)), 0.0)
        else:
            if held is None or not np.array_equal(points, held):
                held, parts = points, []
                for some in np.array_split(cells, dim * dim * len(points) // _CHUNK + 1):
                    d = np.hypot((some // dim)[:, None] - points // dim, (some % dim)[:, None] - points % dim)
                    w = np.where(d < 1e-10, 0.0, np.maximum(d, 1e-10) ** -power)
                    parts.append((w / np.maximum(w.sum(1, keepdims=True), 1e-300)).astype(float))
                weight = parts
            field = np.concatenate([w @ values for w in weight])
            field[points] = values
        out.append(field)
    return out


def idw_nodes(lat: np.ndarray, lon: np.ndarray, values: np.ndarray, nodes: tuple[np.ndarray, np.ndarray], weigh: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Weighted means (values x nodes) of the rows of ``values`` at the nodes; ``weigh`` turns distances and
    node numbers into weights.  A node that a point hits takes the first such point's values."""
    parts = []
    for some in np.array_split(np.arange(len(nodes[0])), len(nodes[0]) * len(lat) // _CHUNK + 1):
        d = np.sqrt((nodes[1][some][:, None] - lon) ** 2 + (nodes[0][some][:, None] - lat) ** 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = weigh(d, some)
            field = (w @ values.T) / w.sum(1)[:, None]
        hit = d < 1e-10
        at = np.flatnonzero(hit.any(1))
        field[at] = values.T[hit[at].argmax(1)]
        parts.append(field.T)
    return np.concatenate(parts, axis=1)


def fixed_neighbours(frames: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray, dim: int) -> list[np.ndarray]:
    """Fields from a table of (cell, neighbour cell, weight) triples; missing neighbours are left out and
    an observed cell keeps its value."""
    cell, near, weight = (table.reshape(-1, 3)[:, k] for k in range(3))
    cell, near, out = cell.astype(int), near.astype(int), []
    for points, values in frames:
        row = np.full(dim * dim, np.nan)
        row[points] = values
        v = row[near]
        w = np.where(np.isnan(v), 0.0, weight)
        total = np.bincount(cell, w, dim * dim)
        with np.errstate(invalid="ignore"):
            field = np.bincount(cell, w * np.nan_to_num(v), dim * dim) / np.where(total > 0, total, np.nan)
        own = (cell == near) & ~np.isnan(v)
        field[cell[own]] = v[own]
        out.append(field)
    return out


def box_means(frames: list[tuple[np.ndarray, np.ndarray]], radii: np.ndarray, dim: int) -> list[np.ndarray]:
    """Mean over the in-bounds square of each cell's radius, by sums over rectangles."""
    x, y = np.divmod(np.arange(dim * dim), dim)
    r = radii.astype(int)
    x0, x1, y0, y1 = np.maximum(x - r, 0), np.minimum(x + r, dim - 1) + 1, np.maximum(y - r, 0), np.minimum(y + r, dim - 1) + 1
    out = []
    for points, values in frames:
        sums = np.zeros((2, dim + 1, dim + 1))
        sums[0, points // dim + 1, points % dim + 1], sums[1, points // dim + 1, points % dim + 1] = values, 1
        s = sums.cumsum(1).cumsum(2)
        total, n = (a[x1, y1] - a[x0, y1] - a[x1, y0] + a[x0, y0] for a in s)
        out.append(np.where(n > 0, total / np.maximum(n, 1), np.nan))
    return out


def nearest_frame(points: np.ndarray, values: np.ndarray, dim: int) -> np.ndarray:
    """Value of the nearest point; ties by (x, y).  Two separable passes, dim^3 steps."""
    if len(points) == 0:
        return np.full(dim * dim, np.nan)
    grid = np.full((dim, dim), np.nan)
    grid[points // dim, points % dim] = values
    y = np.arange(dim)
    gap = np.where(np.isnan(grid)[:, None, :], np.inf, np.abs(y[:, None] - y)[None, :, :])   # row, target y, source y
    src = gap.argmin(axis=2)                                                                # nearest in the row
    dy2 = gap.min(axis=2) ** 2
    dx2 = (y[:, None] - y) ** 2                                                             # target x, source x
    row = (dx2[:, :, None] + dy2[None, :, :]).argmin(axis=1)                                # nearest row per cell
    return grid[row, src[row, y[None, :]]].ravel()


def pair_sums(points: np.ndarray, values: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per offset between two cells, each pair once: squared distance, number of pairs, sum of squared differences.

    Cells lie on a lattice, so all pairs of an offset come from correlations of mask, value and square:
    dim^2 log(dim) steps whatever the number of points.
    """
    v = values - values.mean()
    planes = np.zeros((3, 2 * dim, 2 * dim))
    for plane, w in zip(planes, (np.ones(len(points)), v, v * v)):
        plane[points // dim, points % dim] = w
    mask, value, square = np.fft.rfft2(planes)
    counts = np.fft.irfft2(mask * mask.conj(), (2 * dim, 2 * dim))
    diffs = np.fft.irfft2(2 * (square * mask.conj()).real - 2 * value * value.conj(), (2 * dim, 2 * dim))
    off = (np.arange(2 * dim) + dim) % (2 * dim) - dim
    dx, dy = off[:, None], off[None, :]
    half = (dx > 0) | ((dx == 0) & (dy > 0))
    n = np.rint(counts[half]).astype(np.int64)
    d2 = (dx * dx + dy * dy)[half]
    return d2[n > 0], n[n > 0], np.maximum(diffs[half][n > 0], 0)


def best_cuts(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """First index of each of k runs of the sorted ``x`` with the least weighted square error; of equally good
    cuts the one whose last run starts first, then the run before it."""
    m = len(x)
    k = min(k, m)
    w, s, q = (np.concatenate([[0.0], np.cumsum(c)]) for c in (weight, weight * x, weight * x * x))
    cost = np.full(m + 1, np.inf)
    cost[0] = 0
    starts = np.zeros((k, m + 1), dtype=np.int64)
    step = max(1, _CHUNK // (m + 1))
    for run in range(k):
        best = np.full(m + 1, np.inf)
        for lo in range(1, m + 1, step):
            j = np.arange(lo, min(lo + step, m + 1))
            i = np.arange(j[-1])[:, None]
            mass = np.where(i < j, w[j] - w[i], 1)
            total = cost[i] + np.where(i < j, np.maximum(q[j] - q[i] - (s[j] - s[i]) ** 2 / mass, 0), np.inf)
            best[j] = total.min(axis=0)
            starts[run, j] = (total <= best[j] + 1e-9).argmax(axis=0)
        cost = best
    cuts, end = [], m
    for run in range(k - 1, -1, -1):
        end = int(starts[run, end])
        cuts.append(end)
    return np.array(cuts[::-1])


def variogram(points: np.ndarray, values: np.ndarray, dim: int, lags: int, bins: str = "equal") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matheron estimate over distance bins: upper bin edge, pair count, semivariance.

    ``bins``: "equal" for bins of one width up to the largest distance, "cluster" for the best partition of the
    distances into ``lags`` clusters (fewer where there are fewer distances); their edge is the largest distance inside.
    """
    if len(points) < 2:
        return np.zeros(lags), np.zeros(lags), np.zeros(lags)
    d2, pairs, sums = pair_sums(points, values, dim)
    d = np.sqrt(d2)
    if bins == "equal":
        far = d.max()
        b = np.minimum((d / far * lags).astype(int), lags - 1)
        edge = far * (np.arange(lags) + 1) / lags
    elif bins == "cluster":
        each, at = np.unique(d2, return_inverse=True)
        cuts = best_cuts(np.sqrt(each), np.bincount(at, pairs), lags)
        b, lags = np.searchsorted(cuts, at, side="right") - 1, len(cuts)
        edge = np.sqrt(each[np.append(cuts[1:], len(each)) - 1])
    else:
        raise ValueError(f"no bins of this kind: {bins}")
    n, total = np.bincount(b, pairs, minlength=lags), np.bincount(b, sums, minlength=lags)
    return edge, n, np.divide(total, 2 * n, out=np.zeros(lags), where=n > 0)


def fit_exponential(h: np.ndarray, n: np.ndarray, g: np.ndarray) -> tuple[float, float]:
    """Sill and effective range of sill*(1 - exp(-3h/range)), no nugget: least squares over a
    range scan with the sill in closed form."""
    h, g = h[n > 0], g[n > 0]
    ranges = h.max() * np.linspace(0.02, 1.0, 200)
    basis = 1 - np.exp(-3 * h[None, :] / ranges[:, None])
    sill = (basis * g).sum(axis=1) / (basis ** 2).sum(axis=1)
    error = ((basis * sill[:, None] - g) ** 2).sum(axis=1)
    best = (error <= error.min() + 1e-9 * (g ** 2).sum()).argmax()     # the shortest of equally good ranges
    return float(sill[best]), float(ranges[best])


def kriging_frame(points: np.ndarray, residuals: np.ndarray, dim: int, lags: int, min_points: int, max_points: int, bins: str = "equal") -> np.ndarray:
    """Ordinary kriging of the residuals; cells with too few points in range are 0."""
    out = np.zeros(dim * dim)
    if len(points) < max(min_points, 2):
        return out
    if np.ptp(residuals) == 0:
        return out + residuals[0]
    sill, reach = fit_exponential(*variogram(points, residuals, dim, lags, bins))
    gamma = lambda d: sill * (1 - np.exp(-3 * d / reach))
    px, py = points // dim, points % dim
    near_first = [[m[:, :max_points] for m in _by_distance(some, points, None, dim)] for some in np.array_split(np.arange(dim * dim), dim * dim * len(points) // _CHUNK + 1)]
    order, d2 = (np.concatenate(part) for part in zip(*near_first))
    near = (d2 <= reach ** 2).sum(axis=1)
    for m in range(min_points, order.shape[1] + 1):                 # one batch per system size
        cells = np.flatnonzero(near == m)
        if len(cells) == 0:
            continue
        pick = order[cells, :m]
        a = np.ones((len(cells), m + 1, m + 1))
        a[:, m, m] = 0
        a[:, :m, :m] = gamma(np.hypot(px[pick][:, :, None] - px[pick][:, None, :], py[pick][:, :, None] - py[pick][:, None, :]))
        b = np.ones((len(cells), m + 1, 1))
        b[:, :m, 0] = gamma(np.sqrt(d2[cells, :m]))
        out[cells] = (np.linalg.solve(a, b)[:, :m, 0] * residuals[pick]).sum(axis=1)
    return out


def _arrays(c, v):
    return np.asarray(c, dtype=np.int64), np.asarray(v, dtype=float)


def fields(packed: DataFrame, dim: int, frame: Sequence[str], kernel: Callable[[list, np.ndarray | None], list[np.ndarray]],
           value: str, layer: str | None = None) -> DataFrame:
    """Run ``kernel`` on packed frames and return (frame, x, y, value) rows.

    Frames stream through in slices, so a task holds a bounded number of dense fields whatever the
    size of its Arrow batches.  ``layer`` names a column with a static field, given at least in the
    first row of every partition.
    """
    kept = packed.select(*frame, "cells", "values", *([layer] if layer else []))
    schema = T.StructType([packed.schema[c] for c in frame] + [
        T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField(value, T.DoubleType())])
    size = dim * dim
    step = frames_at_once(size)
    x, y = (v.astype(np.int32) for v in np.divmod(np.arange(size), dim))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        static = None
        for pdf in batches:
            if layer and static is None and len(pdf):
                static = np.asarray(pdf[layer].iloc[0], dtype=float)
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i:i + step]
                out = kernel([_arrays(c, v) for c, v in zip(part["cells"], part["values"])], static)
                yield pd.DataFrame({**{c: part[c].repeat(size).reset_index(drop=True) for c in frame},
                                    "x": np.tile(x, len(part)), "y": np.tile(y, len(part)), value: np.concatenate(out)})

    return kept.mapInPandas(run, schema)


def separable(packed: DataFrame, rows: np.ndarray, cols: np.ndarray, frame: Sequence[str], value: str) -> DataFrame:
    """rows @ field @ cols.T for every packed frame (``points``: x, y and value of its pixels).

    A missing input pixel makes the outputs that use it missing; outputs that use no pixel of the
    frame have no row.
    """
    kept = packed.select(*frame, "points.x", "points.y", F.col("points.v").alias("_v"))
    schema = T.StructType([packed.schema[c] for c in frame] + [
        T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField(value, T.DoubleType())])
    shape, used = (rows.shape[1], cols.shape[1]), ((rows != 0).astype(float), (cols != 0).astype(float))
    taps = np.outer(used[0].sum(1), used[1].sum(1))
    step = max(1, _CHUNK // (4 * max(rows.size, cols.size, shape[0] * shape[1], len(rows) * len(cols))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i:i + step]
                at = np.repeat(np.arange(len(part)), [len(x) for x in part["x"]])
                x, y = (np.concatenate(part[c].to_list()).astype(int) for c in ("x", "y"))
                v = np.concatenate([np.asarray(a, dtype=float) for a in part["_v"]])
                keep = (x >= 0) & (x < shape[0]) & (y >= 0) & (y < shape[1])
                at, x, y, v = at[keep], x[keep], y[keep], v[keep]
                field, seen, valid = np.zeros((3, len(part), *shape))
                field[at, x, y] = np.nan_to_num(v)
                seen[at, x, y] = 1
                valid[at, x, y] = ~np.isnan(v)
                out = rows @ field @ cols.T
                out[used[0] @ valid @ used[1].T < taps - 0.5] = np.nan
                f, ox, oy = np.nonzero(used[0] @ seen @ used[1].T > 0.5)
                yield pd.DataFrame({**{c: part[c].iloc[f].reset_index(drop=True) for c in frame},
                                    "x": ox.astype(np.int32), "y": oy.astype(np.int32), value: out[f, ox, oy]})

    return kept.mapInPandas(run, schema)


def rings(bx: np.ndarray, by: np.ndarray, d: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, bucket) pairs of all buckets that may hold a node's nearest point.

    ``d`` is the way from a bucket's middle to its best point.  A node in an occupied bucket is that far from a point at
    most; any other is bounded by the best of all ways over a bucket.
    """
    size = dim * dim
    x, y = np.divmod(np.arange(size), dim)
    bound = np.full(size, np.inf)
    inside = np.flatnonzero((bx >= 0) & (bx < dim) & (by >= 0) & (by < dim))
    bound[bx[inside] * dim + by[inside]] = d[inside]
    empty = np.flatnonzero(np.isinf(bound))
    for some in np.array_split(empty, len(empty) * len(bx) // _CHUNK + 1):
        if len(some):
            bound[some] = (np.hypot(bx - x[some][:, None], by - y[some][:, None]) + d).min(1)
    order = np.argsort(bx, kind="stable")
    sorted_bx = bx[order]
    node, bucket = [], []
    for row in range(dim):
        mine = np.arange(row * dim, (row + 1) * dim)
        most = bound[mine].max() + 0.5 + 1e-6
        low, high = np.searchsorted(sorted_bx, [row - most, row + most], side="left")
        near = order[low: high + np.count_nonzero(sorted_bx[high:] == row + most)]
        for some in np.array_split(mine, dim * len(near) // _CHUNK + 1):
            gap = np.hypot(np.maximum(np.abs(bx[near] - row) - 0.5, 0), np.maximum(np.abs(by[near] - y[some][:, None]) - 0.5, 0))
            a, b = np.nonzero(gap <= bound[some][:, None] + 1e-6)
            node.append(some[a])
            bucket.append(near[b])
    return np.concatenate(node), np.concatenate(bucket)


def ring_pairs(packed: DataFrame, dim: int, frame: Sequence[str]) -> DataFrame:
    """Nodes (x, y) and their buckets (bx, by) of packed frames (``_b``: bx, by, d)."""
    schema = T.StructType([packed.schema[c] for c in frame] + [T.StructField(c, T.IntegerType()) for c in ("x", "y")] + [T.StructField(c, T.LongType()) for c in ("bx", "by")])
    kept = packed.select(*frame, F.col("_b.bx").alias("_bx"), F.col("_b.by").alias("_by"), F.col("_b.d").alias("_d"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):
                own = pdf.iloc[[i]]
                bx, by, d = (np.asarray(own[c].iloc[0]) for c in ("_bx", "_by", "_d"))
                node, bucket = rings(bx.astype(np.int64), by.astype(np.int64), d.astype(float), dim)
                keys = own[list(frame)].iloc[np.zeros(len(node), int)].reset_index(drop=True)
                yield pd.DataFrame({**{c: keys[c] for c in frame}, "x": (node // dim).astype(np.int32), "y": (node % dim).astype(np.int32), "bx": bx[bucket], "by": by[bucket]})

    return kept.mapInPandas(run, schema)


def variogram_udf(dim: int, lags: int, bins: str = "equal"):
    @F.pandas_udf("array<struct<lag:int,distance:double,n_pairs:bigint,semivariance:double>>")
    def run(cells: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for c, v in zip(cells, values):
            h, n, g = variogram(*_arrays(c, v), dim, lags, bins)
            out.append([{"lag": i, "distance": h[i], "n_pairs": int(n[i]), "semivariance": g[i]} for i in range(len(n)) if n[i] > 0])
        return pd.Series(out)
    return run
