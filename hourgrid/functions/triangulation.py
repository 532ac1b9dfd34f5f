"""Delaunay triangulation of a frame's points, and linear interpolation on it.

Points are inserted one by one: a walk finds the triangle that holds the point, the triangles whose circumcircle holds
it are taken out, and the hole is filled from the point.  The plane outside the hull consists of triangles with the
vertex GHOST, so the hull is exact.  Signs of orientation and circle tests come from doubles where these are beyond
their error, else from rational numbers.

Where a few positions are wanted from many points, only points around them are inserted, with those of the hull.  A
triangle found so is one of all points as soon as its circle, border included, holds no point left out: of points on
one circle, those inserted first decide, and the points taken keep their order.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

GHOST = -1
#: Up to so many points for a wanted position, all are inserted.
FEW = 32
#: Points added for a position whose circle holds others, four times as many each round.
MORE = 64
#: Directions whose extreme points enclose most of the rest.
DIRECTIONS = 16
_ORIENT_ERROR = 4.0e-16
_CIRCLE_ERROR = 1.2e-15


class Triangulation:
    """Triangles of distinct points (two arrays), or of the points ``order`` alone in this order; ``triangles`` is empty
    where all these lie on a line."""

    def __init__(self, x: np.ndarray, y: np.ndarray, order: list[int] | None = None):
        self.x, self.y = np.asarray(x, float).tolist(), np.asarray(y, float).tolist()
        self.third: dict[tuple[int, int], int] = {}  # the vertex left of a directed edge
        if order is None:
            order = self._order(np.asarray(x, float), np.asarray(y, float))
        first = self._first(order)
        self.at: tuple[int, int] | None = None
        if first is not None:
            u, v, w = first
            for t in ((u, v, w), (v, u, GHOST), (w, v, GHOST), (u, w, GHOST)):
                self._add(*t)
            for p in order:
                if p not in first:
                    self._insert(p)
        found = {(u, v, w) for (u, v), w in self.third.items() if u < v and u < w and u != GHOST}
        self.triangles = np.array(sorted(found), np.int64).reshape(-1, 3)

    @staticmethod
    def _order(x: np.ndarray, y: np.ndarray) -> list[int]:
        """Strips in turn, so that a point lies near the one before."""
        n = len(x)
        if n == 0:
            return []
        strips = max(1, int(np.sqrt(n / 2)))
        span = x.max() - x.min() or 1.0
        strip = np.minimum((x - x.min()) / span * strips, strips - 1).astype(int)
        return np.lexsort((np.where(strip % 2, -y, y), strip)).tolist()

    def _first(self, order: list[int]) -> tuple[int, int, int] | None:
        for i in range(2, len(order)):
            side = self._orient(order[0], order[1], order[i])
            if side:
                return (order[0], order[1], order[i]) if side > 0 else (order[1], order[0], order[i])
        return None

    def _add(self, u: int, v: int, w: int) -> None:
        self.third[u, v], self.third[v, w], self.third[w, u] = w, u, v
        if GHOST not in (u, v, w):
            self.at = (u, v)

    def _remove(self, u: int, v: int, w: int) -> None:
        for edge in ((u, v), (v, w), (w, u)):
            del self.third[edge]

    def _orient(self, a: int, b: int, c: int) -> int:
        return self.side(a, b, self.x[c], self.y[c])

    def side(self, a: int, b: int, px: float, py: float) -> int:
        """1 where (px, py) lies left of the line from a to b, -1 right of it, 0 on it."""
        x, y = self.x, self.y
        one, two = (x[b] - x[a]) * (py - y[a]), (y[b] - y[a]) * (px - x[a])
        if abs(one - two) > _ORIENT_ERROR * (abs(one) + abs(two)) * 2:
            return 1 if one > two else -1
        f = Fraction
        exact = (f(x[b]) - f(x[a])) * (f(py) - f(y[a])) - (f(y[b]) - f(y[a])) * (f(px) - f(x[a]))
        return (exact > 0) - (exact < 0)

    def _in_circle(self, a: int, b: int, c: int, p: int) -> bool:
        """Does p lie inside the circle through a, b, c (counterclockwise)?  A circle through GHOST is a half-plane with
        its inner border."""
        if GHOST in (a, b, c):
            while c != GHOST:
                a, b, c = b, c, a
            side = self._orient(a, b, p)
            if side:
                return side > 0
            x, y = self.x, self.y
            return (x[p] - x[a]) * (x[p] - x[b]) + (y[p] - y[a]) * (y[p] - y[b]) < 0
        x, y = self.x, self.y
        ax, ay, bx, by, cx, cy = x[a] - x[p], y[a] - y[p], x[b] - x[p], y[b] - y[p], x[c] - x[p], y[c] - y[p]
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        det = a2 * (bx * cy - by * cx) - b2 * (ax * cy - ay * cx) + c2 * (ax * by - ay * bx)
        size = a2 * (abs(bx * cy) + abs(by * cx)) + b2 * (abs(ax * cy) + abs(ay * cx)) + c2 * (abs(ax * by) + abs(ay * bx))
        if abs(det) > _CIRCLE_ERROR * 10 * size:
            return det > 0
        f = Fraction
        px, py = f(x[p]), f(y[p])
        (ax, ay), (bx, by), (cx, cy) = ((f(x[i]) - px, f(y[i]) - py) for i in (a, b, c))
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return a2 * (bx * cy - by * cx) - b2 * (ax * cy - ay * cx) + c2 * (ax * by - ay * bx) > 0

    def locate(self, px: float, py: float) -> tuple[int, int, int]:
        """The triangle that holds a position, on its border too; one with GHOST last outside the hull."""
        u, v = self.at
        w = self.third[u, v]
        while True:
            for a, b, c in ((u, v, w), (v, w, u), (w, u, v)):
                if self.side(a, b, px, py) < 0:
                    u, v, w = b, a, self.third[b, a]
                    break
            else:
                self.at = (u, v)
                return u, v, w
            if w == GHOST:
                return u, v, w

    def _insert(self, p: int) -> None:
        u, v, w = self.locate(self.x[p], self.y[p])
        self._remove(u, v, w)
        todo = [(u, v), (v, w), (w, u)]
        while todo:
            a, b = todo.pop()
            c = self.third.get((b, a))
            if c is not None and self._in_circle(b, a, c, p):
                self._remove(b, a, c)
                todo += [(a, c), (c, b)]
            else:
                self._add(p, a, b)


class _Buckets:
    """Points by the cells of a lattice, about two in a cell."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.n = int(np.ceil(np.sqrt(len(x) / 2)))
        self.low = x.min(), y.min()
        self.scale = self.n / (np.ptp(x) or 1.0), self.n / (np.ptp(y) or 1.0)
        key = self.cell(x, 0) * self.n + self.cell(y, 1)
        self.points = np.argsort(key, kind="stable")
        self.start = np.searchsorted(key[self.points], np.arange(self.n * self.n + 1))

    def cell(self, v, axis: int):
        return np.clip(np.floor((v - self.low[axis]) * self.scale[axis]), 0, self.n - 1).astype(np.int64)

    def block(self, x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        """Points of the cells from (x0, y0) to (x1, y1)."""
        row = np.arange(max(x0, 0), min(x1, self.n - 1) + 1) * self.n
        begin, end = self.start[row + max(y0, 0)], self.start[row + min(y1, self.n - 1) + 1]
        size = end - begin
        return self.points[np.repeat(end - np.cumsum(size), size) + np.arange(int(size.sum()))]


def _in_closed_circle(x: np.ndarray, y: np.ndarray, buckets: _Buckets, corners: tuple[int, int, int]) -> np.ndarray:
    """All points in the circle through three points or on it, and any too near to it to tell."""
    a, b, c = corners
    f = Fraction
    ax, ay = f(float(x[a])), f(float(y[a]))
    bx, by, cx, cy = f(float(x[b])) - ax, f(float(y[b])) - ay, f(float(x[c])) - ax, f(float(y[c])) - ay
    turn = bx * cy - by * cx
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    wide, high = float((b2 * cy - c2 * by) / turn), float((c2 * bx - b2 * cx) / turn)  # twice the way from a to the centre
    mid, radius = (x[a] + wide / 2, y[a] + high / 2), np.hypot(wide, high) / 2
    reach = [radius * (1 + 1e-9) + 1e-12 * (abs(m) + abs(v[a])) for m, v in zip(mid, (x, y))]
    x0, x1 = buckets.cell(np.array([mid[0] - reach[0], mid[0] + reach[0]]), 0).tolist()
    y0, y1 = buckets.cell(np.array([mid[1] - reach[1], mid[1] + reach[1]]), 1).tolist()
    some = buckets.block(x0, x1, y0, y1)
    u, v = x[some] - x[a], y[some] - y[a]
    size = u * u + v * v + np.abs(u * wide) + np.abs(v * high)
    return some[u * (u - wide) + v * (v - high) <= 1e-14 * size]


def _hull(x: np.ndarray, y: np.ndarray, net: Triangulation) -> np.ndarray:
    """Corners of the hull.  Points clearly inside the polygon of the extreme ones are no candidates."""
    angle = np.arange(DIRECTIONS) * (2 * np.pi / DIRECTIONS)
    far = [int((x * np.cos(t) + y * np.sin(t)).argmax()) for t in angle]
    far = [p for i, p in enumerate(far) if p != far[i - 1]]
    inside = np.ones(len(x), bool)
    for a, b in zip(far, [*far[1:], *far[:1]]):
        one, two = (x[b] - x[a]) * (y - y[a]), (y[b] - y[a]) * (x - x[a])
        inside &= one - two > 1e-12 * (np.abs(one) + np.abs(two))
    some = np.flatnonzero(~inside)
    some = some[np.lexsort((y[some], x[some]))].tolist()
    out = []
    for way in (some, some[::-1]):
        chain: list[int] = []
        for p in way:
            while len(chain) > 1 and net._orient(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        out += chain
    return np.unique(np.array(out, np.int64))


def containing(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """The three points around every position; GHOST outside the hull.  Points are distinct."""
    corner = np.full((len(at_x), 3), GHOST, np.int64)
    if len(x) <= FEW * len(at_x) or not (np.isfinite(x).all() and np.isfinite(y).all()):
        net = Triangulation(x, y)
        for i, (px, py) in enumerate(zip(at_x.tolist(), at_y.tolist()) if len(net.triangles) else ()):
            if GHOST not in (found := net.locate(px, py)):
                corner[i] = found
        return corner
    order = Triangulation._order(x, y)
    net = Triangulation(x, y, [])
    first = net._first(order)
    if first is None:
        return corner
    start = [order[0], order[1], next(p for p in first if p not in order[:2])]
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    place[start] = [-3, -2, -1]
    always = np.union1d(_hull(x, y, net), start)
    buckets = _Buckets(x, y)
    cells = zip(buckets.cell(at_x, 0).tolist(), buckets.cell(at_y, 1).tolist())
    taken = {i: buckets.block(a - 1, a + 1, b - 1, b + 1) for i, (a, b) in enumerate(cells)}
    more = MORE
    while taken:
        some = np.unique(np.concatenate([always, *taken.values()]))
        net = Triangulation(x, y, some[np.argsort(place[some])].tolist())
        for i in list(taken):
            found = net.locate(float(at_x[i]), float(at_y[i]))
            if GHOST in found:
                del taken[i]
                continue
            left = np.setdiff1d(_in_closed_circle(x, y, buckets, found), some)
            if len(left):
                away = np.square(x[left] - at_x[i]) + np.square(y[left] - at_y[i])
                near = left if len(left) <= more else left[np.argpartition(away, more)[:more]]
                taken[i] = np.concatenate([taken[i], near])
            else:
                corner[i] = found
                del taken[i]
        more *= 4
    return corner


def linear_weights(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three points and their weights for every position; weights are NaN outside the hull.

    Points in one place count as the first of them.
    """
    order = np.lexsort((y, x))
    new = np.ones(len(x), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    first = np.sort(order[new])
    x, y = x[first], y[first]
    corner = containing(x, y, at_x, at_y)
    weight = np.full((len(at_x), 3), np.nan)
    inside = corner[:, 0] != GHOST
    corner[~inside] = 0
    if not inside.any():
        return corner, weight
    a, b, c = corner[inside].T
    px, py = at_x[inside], at_y[inside]
    area = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
    wb = ((px - x[a]) * (y[c] - y[a]) - (py - y[a]) * (x[c] - x[a])) / area
    wc = ((x[b] - x[a]) * (py - y[a]) - (y[b] - y[a]) * (px - x[a])) / area
    weight[inside] = np.stack([1 - wb - wc, wb, wc], axis=1)
    return first[corner], weight


def linear_fields(frames: list[tuple[np.ndarray, np.ndarray, np.ndarray]], nodes: tuple[np.ndarray, np.ndarray], outside: float | None) -> list[np.ndarray]:
    """Values at the nodes (y, x) of frames of (y, x, value); frames with the same points share their weights.

    Outside the hull a node takes ``outside``, or where that is None the value of the nearest point, the first of several.
    """
    out, held = [], None
    for y, x, value in frames:
        if held is None or not (np.array_equal(held[0], y) and np.array_equal(held[1], x)):
            corner, weight = linear_weights(x, y, nodes[1], nodes[0])
            beyond = np.flatnonzero(np.isnan(weight[:, 0]))
            near = np.zeros(0, np.int64)
            if outside is None and len(beyond) and len(x):
                step = max(1, 4_000_000 // len(x))
                near = np.concatenate([(np.square(nodes[1][s][:, None] - x) + np.square(nodes[0][s][:, None] - y)).argmin(1)
                                       for s in (beyond[i: i + step] for i in range(0, len(beyond), step))])
            held = (y, x, corner, weight, beyond, near)
        _, _, corner, weight, beyond, near = held
        if not len(value):
            out.append(np.full(len(nodes[0]), np.nan if outside is None else outside))
            continue
        field = (value[corner] * weight).sum(1)
        field[beyond] = value[near] if outside is None else outside
        out.append(field)
    return out
