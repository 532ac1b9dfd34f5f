"""Point clouds to grids: ring search and triangles next to brute force."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from hourgrid.functions import kernels, triangulation as D
from hourgrid.operators import interpolate as I
from hourgrid.plans import gridded

EXTENT = (0.0, 8.0, 0.0, 8.0)


def frame_of(spark, clouds):
    data = [(f, i, float(lat), float(lon), float(v)) for f, pts in clouds.items() for i, (lat, lon, v) in enumerate(pts)]
    return spark.createDataFrame(data, "ts int, pid int, lat double, lon double, value double")


def test_nearest_point_of_clouds_that_lie_outside(spark):
    rng, dim = np.random.default_rng(4), 9
    half = np.concatenate([rng.uniform(0, 8, (300, 2)), rng.uniform(-400, 400, (300, 2))])
    clouds = {0: half, 1: rng.uniform(9, 12, (40, 2)), 2: rng.uniform(-900, -300, (50, 2)), 3: np.array([[4.0, 4.0], [1e6, 1e6]]), 4: rng.uniform(7.4, 8.9, (200, 2)),
              5: np.repeat([[8.4, 3.3]], 50, axis=0)}
    out = I.nearest_point(frame_of(spark, {f: [(*p, i) for i, p in enumerate(pts)] for f, pts in clouds.items()}), EXTENT, dim, "pid").collect()
    assert len(out) == len(clouds) * dim * dim
    for r in out:
        d = np.round((clouds[r.ts][:, 0] - (8 - r.x)) ** 2 + (clouds[r.ts][:, 1] - r.y) ** 2, 12)
        assert int(r.value) == d.argmin()


def test_rings_hold_the_nearest_and_spare_the_rest():
    rng, dim = np.random.default_rng(1), 12
    for n, low, high in ((400, 0, 11), (900, -300, 300), (5, -2, 14), (1, 40, 41)):
        p = rng.uniform(low, high, (n, 2))
        b = np.rint(p).astype(int)
        d = np.hypot(*(p - b).T)
        buckets, index = np.unique(b, axis=0, return_inverse=True)
        best = np.full(len(buckets), np.inf)
        np.minimum.at(best, index.ravel(), d)
        node, bucket = kernels.rings(buckets[:, 0], buckets[:, 1], best, dim)
        held = set(zip(node.tolist(), bucket.tolist()))
        for c in range(dim * dim):
            near = int(np.hypot(p[:, 0] - c // dim, p[:, 1] - c % dim).argmin())
            assert (c, int(index.ravel()[near])) in held
        if n > 300:
            assert len(held) < 40 * dim * dim and not set(bucket.tolist()) & set(np.flatnonzero(np.abs(buckets).max(1) > 60).tolist())


def test_outside_points_do_not_pile_up(spark):
    """Buckets beyond the grid keep far points apart: no key of the join holds more than a few of them."""
    rng = np.random.default_rng(8)
    pts = np.concatenate([rng.uniform(0, 8, (1000, 2)), rng.uniform(-500, 500, (1000, 2))])
    bucket = np.rint(pts).astype(int)
    assert np.unique(bucket, axis=0, return_counts=True)[1].max() < 40
    plan = I.nearest_point(frame_of(spark, {0: [(*p, 1) for p in pts]}), EXTENT, 9, "pid")._jdf.queryExecution().analyzed().toString()
    assert "rint" in plan and "least" not in plan.lower()


def circle(p, q, r, s):
    m = np.array([[*(t - s), ((t - s) ** 2).sum()] for t in (p, q, r)])
    return np.linalg.det(m)


@pytest.mark.parametrize("n", [3, 4, 7, 25])
def test_triangles_have_empty_circles(n):
    rng = np.random.default_rng(n)
    pts = rng.uniform(0, 1, (n, 2))
    want = set()
    for t in combinations(range(n), 3):
        p, q, r = pts[list(t)]
        turn = np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
        if all(turn * circle(p, q, r, pts[s]) <= 0 for s in range(n) if s not in t):
            want.add(t)
    assert {tuple(sorted(t)) for t in D.Triangulation(*pts.T).triangles.tolist()} == want


def test_lattices_lines_and_repeated_places():
    x, y = (v.ravel().astype(float) for v in np.meshgrid(np.arange(15), np.arange(11)))
    net = D.Triangulation(x, y)
    a, b, c = net.triangles.T
    area = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
    assert (area > 0).all() and area.sum() == 2 * 14 * 10 and len(area) == 2 * 14 * 10
    assert len(D.Triangulation(np.arange(5.0), 2 * np.arange(5.0)).triangles) == 0
    assert len(D.Triangulation(np.zeros(0), np.zeros(0)).triangles) == 0
    corner, weight = D.linear_weights(np.array([0.0, 1, 0, 0, 1]), np.array([0.0, 0, 1, 0, 0]), np.array([0.25]), np.array([0.25]))
    assert sorted(corner[0].tolist()) == [0, 1, 2] and weight[0].sum() == pytest.approx(1)
    many = np.random.default_rng(0).uniform(0, 1, (3000, 2))
    assert len(D.Triangulation(*many.T).triangles) > 5900


def _clouds():
    rng = np.random.default_rng(5)
    lattice = np.stack(np.meshgrid(np.arange(40.0), np.arange(40.0))).reshape(2, -1)
    turn = rng.uniform(0, 2 * np.pi, 900)
    mixed = np.unique(np.concatenate([rng.normal(0, 0.01, (1200, 2)), rng.uniform(-100, 100, (200, 2)), [[1e6, 1e6]]]), axis=0).T
    return {"even": rng.uniform(0, 40, (2, 2500)), "lattice": lattice, "mixed lattice": lattice[:, rng.permutation(1600)], "ring": 20 + 20 * np.stack([np.cos(turn), np.sin(turn)]),
            "crowded": mixed, "whole numbers": np.unique(rng.integers(0, 40, (2, 1500)).astype(float), axis=1), "line": np.stack([np.arange(900.0), 2 * np.arange(900.0)])}


@pytest.mark.parametrize("kind", list(_clouds()))
def test_triangles_around_positions_are_those_of_all_points(kind, monkeypatch):
    """Ties on one circle included."""
    x, y = _clouds()[kind]
    at_x, at_y = np.random.default_rng(2).uniform(-5, 45, (2, 25))
    some = np.sort(D.containing(x, y, at_x, at_y), axis=1)
    monkeypatch.setattr(D, "FEW", 10**9)
    assert some.tolist() == np.sort(D.containing(x, y, at_x, at_y), axis=1).tolist()


def test_few_positions_do_not_insert_all_points(monkeypatch):
    x, y = np.random.default_rng(3).uniform(0, 1, (2, 20000))
    count, insert = [0], D.Triangulation._insert

    def counted(net, p):
        count[0] += 1
        insert(net, p)

    monkeypatch.setattr(D.Triangulation, "_insert", counted)
    corner, weight = D.linear_weights(x, y, np.linspace(0.1, 0.9, 9), np.linspace(0.2, 0.8, 9))
    assert count[0] < 2000 and (weight >= 0).all()
    assert (x[corner] * weight).sum(1) == pytest.approx(np.linspace(0.1, 0.9, 9))


def test_linear_grid_of_a_plane_and_beyond_the_hull(spark):
    rng, dim = np.random.default_rng(6), 9
    plane = lambda lat, lon: 3 * lat - 2 * lon + 1
    wide = rng.uniform(-3, 11, (60, 2))
    corners = [(-20.0, -20.0), (-20.0, 30.0), (30.0, -20.0), (30.0, 30.0)]
    lattice = [(i / 2, j / 2) for i in range(17) for j in range(17)]
    clouds = {0: [(a, b, plane(a, b)) for a, b in [*wide, *corners]], 1: [(a, b, plane(a, b)) for a, b in lattice],
              2: [(2.0, 2.0, 5.0), (2.0, 5.0, 6.0), (5.0, 2.0, 7.0), (2.0, 2.0, 99.0)], 3: [(1.0, 1.0, 4.0), (2.0, 2.0, 8.0), (3.0, 3.0, 9.0)], 4: [(1.0, 7.0, 2.5)]}
    cloud = frame_of(spark, clouds)
    for outside in (None, 0.0):
        got = {(r.ts, r.x, r.y): r.value for r in I.linear_point(cloud, EXTENT, dim, "pid", outside=outside).collect()}
        assert len(got) == 5 * dim * dim
        for (f, x, y), v in got.items():
            lat, lon = 8.0 - x, float(y)
            inside = f < 2 or f == 2 and lat >= 2 and lon >= 2 and lat + lon <= 7
            if inside:
                assert v == pytest.approx(plane(lat, lon) if f < 2 else 5 + (lat - 2) * 2 / 3 + (lon - 2) / 3)
            elif outside is None:
                d = [(lat - a) ** 2 + (lon - b) ** 2 for a, b, _ in clouds[f]]
                assert v == clouds[f][int(np.argmin(d))][2]
            else:
                assert v == 0


def test_series_by_triangles(spark):
    """P8 and P15 in linear mode on a plane, and P15 with 0 outside the hull."""
    day = "2024-01-01"
    hours = spark.sql(f"SELECT explode(sequence(timestamp_ntz'{day} 00:00:00', timestamp_ntz'{day} 03:00:00', interval 1 hour)) AS ts")
    pixels = spark.range(400).selectExpr(f"timestamp_ntz'{day} 00:00:00' AS ts", "id AS pixel", "cast(id div 20 as int) AS row", "cast(id % 20 as int) AS col",
                                         "(id div 20) * 0.6e0 - 1.7e0 AS lat", "(id % 20) * 0.6e0 - 1.3e0 AS lon")
    pixels = pixels.selectExpr("*", "2 * lat + lon AS value")
    out = gridded.model_series(pixels, hours, EXTENT, 9, linear=True).collect()
    assert len(out) == 4 * 81 and all(r.value == pytest.approx(2 * (8 - r.x) + r.y) for r in out)
    some = pixels.where("lat > 2").selectExpr("to_date(ts) AS day", "pixel", "lat", "lon", "value", "1.0e0 AS qa")
    out = gridded.polar_series(some, hours, EXTENT, 9, linear=True).collect()
    assert len(out) == 4 * 81
    for r in out:
        assert r.value == (pytest.approx(2 * (8 - r.x) + r.y) if 8 - r.x >= 2.5 else 0 if 8 - r.x <= 2 else pytest.approx(r.value))
