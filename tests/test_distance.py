import math

import numpy as np

from tessella.mesh import Block, Mesh
from tessella.operators import distance, sets
from tessella.sources import generate as G


def _mesh(spark, points, triangles, kind="TRI3"):
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)], "node_id long, x double, y double, z double")
    e = spark.createDataFrame([(0, i, [int(v) for v in t]) for i, t in enumerate(triangles)], "block_id int, elem_id long, nodes array<long>")
    return Mesh(p, e, (Block(0, "s", kind),), 3)


def _brute(p, points, triangles):
    """The smallest distance by sampling no region: projection inside each triangle, or else its three segments."""
    best = math.inf
    for t in triangles:
        a, b, c = (np.array(points[v], float) for v in t)
        for s, e in ((a, b), (b, c), (c, a)):
            d = e - s
            k = min(1, max(0, (p - s) @ d / (d @ d))) if d @ d else 0
            best = min(best, np.linalg.norm(p - s - k * d))
        n = np.cross(b - a, c - a)
        if n @ n:
            st = np.linalg.lstsq(np.stack([b - a, c - a], 1), p - a, rcond=None)[0]
            if (st >= 0).all() and st.sum() <= 1:
                best = min(best, abs((p - a) @ n) / math.sqrt(n @ n))
    return best


def _random_points(spark, rng, n, scale):
    rows = [(i, *map(float, rng.normal(size=3) * scale)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "node_id long, x double, y double, z double")


def test_triangle_soup_with_degenerate_ones(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(160, 3)).tolist()
    triangles = rng.integers(0, 160, size=(300, 3)).tolist() + [[1, 1, 1], [2, 2, 3], [4, 5, 4]]
    rows, df = _random_points(spark, rng, 60, 3.0)
    got = {r.node_id: r for r in distance.distance_to_surface(df, _mesh(spark, points, triangles)).collect()}
    for i, *p in rows:
        assert abs(abs(got[i].distance) - _brute(np.array(p), points, triangles)) < 1e-9


def test_sign_on_a_spike_with_sharp_edges(spark):
    """A thin tetrahedron: near its edges and corners, face normals alone give wrong signs."""
    points = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0.05, 0.05, 4)]
    triangles = [(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)]
    rng = np.random.default_rng(5)
    rows, df = _random_points(spark, rng, 400, 0.6)
    m = np.linalg.inv(np.array([np.subtract(points[k], points[0]) for k in (1, 2, 3)]).T)
    out = {r.node_id: r.distance for r in distance.distance_to_surface(df, _mesh(spark, points, triangles)).collect()}
    inside = 0
    for i, *p in rows:
        u = m @ np.array(p)
        within = bool((u > 0).all() and u.sum() < 1)
        inside += within
        assert (out[i] < 0) == within and abs(abs(out[i]) - _brute(np.array(p), points, triangles)) < 1e-9
    assert inside > 5


def test_far_points_equidistant_points_and_odd_ones(spark):
    skin = sets.skin(G.hex8_cube(spark, 6, 6, 6))
    rows = [(0, 0.5, 0.5, 0.5), (0, 0.5, 0.5, 0.5), (1, 100.0, 0.5, 0.5), (2, None, 0.25, 0.5), (3, float("nan"), 0.0, 0.0), (4, float("inf"), 0.0, 0.0), (None, 2.0, 2.0, 2.0), (5, 1.0, 0.3, 0.3), (6, 0.9, 0.5, 0.4)]
    df = spark.createDataFrame(rows, "node_id long, x double, y double, z double")
    out = sorted(((r.node_id, r.distance) for r in distance.distance_to_surface(df, skin).collect()), key=str)
    want = sorted([(0, -0.5), (0, -0.5), (1, 99.0), (2, 0.0), (3, None), (4, None), (None, math.sqrt(3)), (5, 0.0), (6, -0.1)], key=str)
    for (i, d), (j, e) in zip(out, want):
        assert i == j and (d is e if e is None else abs(d - e) < 1e-6)
    assert len(out) == len(want)
    empty = Mesh(skin.points, skin.elements.limit(0), skin.blocks, 3)
    assert {r.distance for r in distance.distance_to_surface(df, empty).collect()} == {None}


def test_few_triangles_are_compared(spark):
    """Of 4800 triangles, a point near the surface meets a few leaves."""
    t = distance._numbered(distance.surface_triangles(sets.skin(G.hex8_cube(spark, 20, 20, 20))))
    n = t.count()
    rng = np.random.default_rng(6)
    rows = [(i, float(x), float(y), 1.01) for i, (x, y) in enumerate(rng.uniform(size=(50, 2)))]
    p = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    near = distance._candidates(p, distance._leaf_boxes(t), -(-n // 16))
    assert n == 4800 and near.count() < 50 * 12
