import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import solve
from tessella.sources import generate as G


def _dense(df, n):
    a = np.zeros((n, n))
    for r in df.collect():
        a[r.i, r.j] += r.value
    return a


def _vector(df, n, c="value"):
    out = np.full(n, np.nan)
    for r in df.collect():
        assert np.isnan(out[r.id])
        out[r.id] = r[c]
    return out


def _gradient_matrix(points, elements):
    """Stiffness by inverting each element's matrix of coordinates."""
    n = len(points)
    a = np.zeros((n, n))
    for e in elements:
        p = np.array([points[v] for v in e], float)
        m = np.linalg.inv(np.concatenate([np.ones((len(e), 1)), p], 1))
        size = abs(np.linalg.det(np.concatenate([np.ones((len(e), 1)), p], 1))) / (6 if len(e) == 4 else 2)
        a[np.ix_(e, e)] += size * m[1:].T @ m[1:]
    return a


@pytest.mark.parametrize("kind", ["TRI3", "TET4"])
def test_stiffness_mass_divergence(spark, kind):
    mesh = G.tri3_square(spark, 3, 2, (0.0, 0.0, 2.0, 1.0)) if kind == "TRI3" else G.tet4_cube(spark, 2, 1, 2)
    dim = 2 if kind == "TRI3" else 3
    points = {r.node_id: [r.x, r.y, r.z][:dim] for r in mesh.points.collect()}
    elements = [r.nodes for r in mesh.elements.collect()]
    n = len(points)
    assert np.allclose(_dense(solve.stiffness(mesh), n), _gradient_matrix(points, elements), atol=1e-6)
    mass = _vector(solve.lumped_mass(mesh), n)
    assert abs(mass.sum() - (2.0 if kind == "TRI3" else 1.0)) < 1e-6
    # The divergence of (x, 2y, 3z) is constant.
    field = mesh.points.select(F.col("node_id").alias("id"), "x", (2 * F.col("y")).alias("y"), (3 * F.col("z")).alias("z"))
    assert np.allclose(_vector(solve.divergence(mesh, field), n), (3 if dim == 2 else 6) * mass, atol=1e-5)


def test_several_right_hand_sides_and_rounds(spark):
    rng = np.random.default_rng(1)
    n = 30
    m = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.2)
    a = m @ m.T + np.diag(np.arange(1.0, n + 1))
    b = rng.normal(size=(n, 2))
    matrix = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "i long, j long, value double")
    rhs = spark.createDataFrame([(i, float(b[i, 0]), float(b[i, 1]), 0.0) for i in range(n)], "id long, u double, v double, w double")
    s = solve.conjugate_gradients(matrix, rhs, ("u", "v", "w"))
    x = np.linalg.solve(a, b)
    assert np.allclose(_vector(s.values, n, "u"), x[:, 0], atol=1e-9) and np.allclose(_vector(s.values, n, "v"), x[:, 1], atol=1e-9)
    assert (_vector(s.values, n, "w") == 0).all() and 0 < s.rounds <= n + 5 and max(s.residuals.values()) <= 1e-12
    with pytest.raises(RuntimeError, match="no solution"):
        solve.conjugate_gradients(matrix, rhs, ("u",), max_rounds=2)
    bad = spark.createDataFrame([(0, 0, -1.0)], "i long, j long, value double")
    with pytest.raises(ValueError, match="positive definite"):
        solve.conjugate_gradients(bad, spark.createDataFrame([(0, 1.0)], "id long, value double"))


def test_diffused_distance_against_a_dense_solver(spark):
    """A circle's distance near it and on the boundary, diffused over a square."""
    k = 6
    mesh = G.tri3_square(spark, k, k)
    points = {r.node_id: (r.x, r.y) for r in mesh.points.collect()}
    n = len(points)
    known = []
    for i, (x, y) in points.items():
        d = np.hypot(x - 0.5, y - 0.5)
        if abs(d - 0.33) < 0.06 or min(x, y, 1 - x, 1 - y) < 1e-6:
            known.append((i, float(d - 0.33), float((x - 0.5) / d), float((y - 0.5) / d), None))
    out = solve.diffused_distance(mesh, spark.createDataFrame(known, "id long, value double, x double, y double, z double"))
    a = _gradient_matrix(points, [r.nodes for r in mesh.elements.collect()])
    fixed = [r[0] for r in known]
    free = [i for i in range(n) if i not in fixed]

    def full(values, load):
        x = np.zeros(n)
        x[fixed] = values
        x[free] = np.linalg.solve(a[np.ix_(free, free)], load[free] - a[np.ix_(free, fixed)] @ x[fixed])
        return x

    normal = np.stack([full([r[2 + c] for r in known], np.zeros(n)) for c in range(2)], 1)
    normal /= np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300)
    assert np.allclose(_vector(out.normals, n, "x"), normal[:, 0], atol=1e-5)
    field = spark.createDataFrame([(i, float(u), float(v), 0.0) for i, (u, v) in enumerate(normal)], "id long, x double, y double, z double")
    load = -_vector(solve.divergence(mesh, field), n)
    assert np.allclose(_vector(out.distance, n), full([r[1] for r in known], load), atol=1e-5)
    assert min(out.rounds) > 0


def test_patches_save_rounds(spark):
    """The rounds of a square's solution grow with the patches' width; the values are the same."""
    mesh, n = G.tri3_square(spark, 32, 32), 33 * 33
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    load = mesh.points.select(F.col("node_id").alias("id"), (F.sin(7 * x + 3 * y) / 1024).alias("value"))
    edge = mesh.points.where("x = 0 or y = 0").select(F.col("node_id").alias("id"), F.lit(0.0).alias("value"))
    groups = solve.patches(mesh)
    sizes = [r["count"] for r in groups.groupBy("grp").count().collect()]
    assert len(sizes) == 64 and sum(sizes) == n and max(sizes) <= 25
    matrix = solve.stiffness(mesh)
    s = solve.solve_with_fixed(matrix, load, edge, groups=groups)
    a, b = _dense(matrix, n), _vector(load, n)
    free = np.setdiff1d(np.arange(n), [r.id for r in edge.collect()])
    want = np.zeros(n)
    want[free] = np.linalg.solve(a[np.ix_(free, free)], b[free])
    # By its diagonal alone the system takes 144 rounds.
    assert np.allclose(_vector(s.values, n), want, atol=1e-9) and s.rounds < 90
