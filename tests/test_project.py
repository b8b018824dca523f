import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.mesh import Mesh
from tessella.operators import graph, lattice, project, transfer
from tessella.sources import generate as G

CORNERS = np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)], float)


def _bent(spark):
    mesh = G.hex8_cube(spark, 2, 2, 1)
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    return Mesh(mesh.points.select("node_id", (x + 0.1 * y * z).alias("x"), (y - 0.05 * x).alias("y"), (z + 0.2 * x * y).alias("z")), mesh.elements, mesh.blocks, 3)


def _brute(points, elements, f, order=3):
    t, w = np.polynomial.legendre.leggauss(order)
    t, w = (t + 1) / 2, w / 2
    total, share = np.zeros(len(points)), np.zeros(len(points))
    for nodes in elements:
        p, m, b = points[nodes], np.zeros((8, 8)), np.zeros(8)
        for i in range(order):
            for j in range(order):
                for k in range(order):
                    q = np.array([t[i], t[j], t[k]])
                    side = np.where(CORNERS == 1, q, 1 - q)
                    h = side.prod(1)
                    slope = np.stack([np.where(CORNERS[:, a] == 1, 1, -1) * np.delete(side, a, 1).prod(1) for a in range(3)], 1)
                    c = w[i] * w[j] * w[k] * np.linalg.det(p.T @ slope)
                    m += c * np.outer(h, h)
                    b += c * f(*(h @ p)) * h
        u, s = np.linalg.solve(m, b), m.sum(1)
        np.add.at(total, nodes, u * s)
        np.add.at(share, nodes, s)
    return total / share


def test_projection_on_bent_elements(spark):
    mesh = _bent(spark)
    points = np.array([(r.x, r.y, r.z) for r in mesh.points.orderBy("node_id").collect()])
    elements = [r.nodes for r in mesh.elements.collect()]
    got = lambda v: np.array([r.value for r in project.l2_projection(mesh, v, 3).orderBy("id").collect()])
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    assert np.abs(got(3 + x - 2 * y + 5 * z) - (3 + points @ [1, -2, 5])).max() < 1e-9
    assert np.abs(got(x * y * y + F.sin(z)) - _brute(points, elements, lambda a, b, c: a * b * b + np.sin(c))).max() < 1e-9
    with pytest.raises(ValueError, match="hexahedron"):
        project.quadrature_points(G.tet4_cube(spark, 1, 1, 1))


def test_micro_geometry_and_element_matrix_equal_the_refined_mesh(spark):
    from tessella.operators import convert, geometry

    fine = lattice.to_semistructured(G.hex8_cube(spark, 2, 1, 1, (0.0, 0.0, 0.0, 2.0, 3.0, 1.0)), 2)
    cells = convert.convert_to(fine, "HEX8")
    micro = project.micro_adjugate(project.macro_adjugate(fine), 2).collect()
    whole = geometry.adjugate_and_determinant(cells).collect()
    row = lambda r: np.array([r[f"a{k}"] for k in range(9)] + [r.det])
    assert len(whole) == 8 * len(micro) and all(np.allclose(row(r), row(micro[0]), atol=1e-6) for r in [*whole, *micro])
    # One matrix for all micro elements, applied over the lattice and over the refined mesh's own elements.
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(8, 8))
    n = fine.n_nodes()
    u = rng.normal(size=n)
    field = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(u)], "id long, comp int, value double")
    out = np.zeros(n)
    for r in transfer.apply_element_matrix(fine, matrix.tolist(), field).collect():
        out[r.id] = r.value
    want = np.zeros(n)
    for r in cells.elements.collect():
        np.add.at(want, r.nodes, matrix @ u[r.nodes])
    assert np.allclose(out, want)
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(graph.micro_node_to_node(fine)) == same(graph.node_to_node(cells))
    with pytest.raises(ValueError, match="lattice"):
        project.macro_adjugate(G.hex8_cube(spark, 1, 1, 1))
