"""Closed forms, round trips and invariants of the mesh engine, on small meshes."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessella.functions import elem_types as E
from tessella.functions.quadrature import gauss_lobatto
from tessella.mesh import Mesh
from tessella.operators import convert, geometry, graph, lattice, numbering, order, sets, transfer
from tessella.sources import generate as G
from tessella.sources import raw, sinks

# Elements, nodes, n2e, n2n, upper triangle, dual pairs, boundary sides.
SIZES = [("HEX8", (4, 3, 2), (24, 60, 192, 910, 425, 92, 52)), ("TET4", (2, 2, 2), (96, 35, 384, 343, 154, 336, 48))]


def ones(mesh: Mesh, value=None):
    return mesh.points.select(F.col("node_id").alias("id"), F.lit(0).alias("comp"), (F.lit(1.0) if value is None else value).alias("value"))


@pytest.mark.parametrize(("kind", "n", "want"), SIZES)
def test_sizes(spark, kind, n, want):
    m = G.cube(spark, kind, *n)
    got = (m.n_elements(), m.n_nodes(), graph.node_to_element(m).count(), graph.node_to_node(m).count(), graph.upper_triangular(m).count(), graph.dual(m).count(), sets.skin_sideset(m).count())
    assert got == want


def test_plane_sideset_and_nodeset(spark):
    m = G.hex8_cube(spark, 2, 3, 4)
    s = sets.sideset_on_plane(m, (1.0, 0.0, 0.0), 0.0)
    assert s.count() == 12 and sets.nodeset(m, s).count() == 20


def test_type_table():
    assert len(E.TYPES) == 53 and E.type_of_size(8) == "HEX8" and E.element_type("HEX27").side_type == "QUAD9"
    assert E.lattice_side(1, 0) == tuple(E.hex_corner(1, k) for k in (0, 1, 4, 5))
    assert not E.element_type("BEAM2").semistructured
    with pytest.raises(ValueError):
        E.element_type("NONE")


def test_upper_triangle_of_an_unused_node(spark):
    points = spark.range(4).select(F.col("id").alias("node_id"), *[F.lit(0.0).cast("float").alias(c) for c in "xyz"])
    rows = spark.createDataFrame([(0, 0, [0, 1, 2])], "block_id int, elem_id long, nodes array<long>")
    from tessella.mesh import Block

    g = graph.upper_triangular(Mesh(points, rows, (Block(0, "b", "TRI3"),), 2))
    assert [r.start for r in graph.row_pointers(g, 4).orderBy("row").collect()] == [0, 2, 3, 3, 3]


def test_dense_ids_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [r.n for r in numbering.dense_ids(df, ["k"], "n").orderBy("k").collect()] == list(range(1000))
    assert numbering.dense_ids(df.where("k < 0"), ["k"], "n").count() == 0


def test_folder_round_trip(spark, tmp_path):
    for m in (G.tet4_cube(spark, 2, 1, 1), G.hex8_checkerboard_cube(spark, 2, 2, 2)):
        d = str(tmp_path / m.blocks[0].elem_type)
        sinks.write_mesh(m, d)
        back = raw.read_mesh(spark, d)
        assert [(b.name, b.elem_type) for b in back.blocks] == [(b.name, b.elem_type) for b in m.blocks]
        key = lambda x: sorted((r.block_id, r.elem_id, tuple(r.nodes)) for r in x.elements.collect())
        assert key(back) == key(m)
        assert sorted(map(tuple, back.points.collect())) == sorted(map(tuple, m.points.collect()))


def test_sideset_and_split_reads(spark, tmp_path):
    m = G.hex8_cube(spark, 2, 2, 1)
    s = sets.skin_sideset(m)
    sinks.write_sideset(s, str(tmp_path / "s"))
    same = lambda x: sorted((r.parent, r.lfi) for r in x.collect())
    assert same(raw.read_sideset(spark, str(tmp_path / "s"))) == same(s)
    sinks.write_array(spark.range(1000).select("id", F.col("id").cast("double").alias("value")), str(tmp_path / "a.float64"))
    got = raw.read_columns(spark, [str(tmp_path / "a.float64")], split_bytes=800)
    assert got.rdd.getNumPartitions() == 10 and got.where("c0 <> id").count() == 0 and got.count() == 1000


@pytest.mark.parametrize("ids", [[0, 0, 2], [1, 2, 3], [0, 1, 3], [0, None, 1], [-1, 0, 1], [0, 1, 1, 2]])
def test_columns_with_wrong_ids_are_refused(spark, tmp_path, ids):
    df = spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)], "id long, value double")
    with pytest.raises(ValueError, match="ids have to be"):
        sinks.write_array(df, str(tmp_path / "a.float64"))


def test_fields_grids_descriptions_and_matrices(spark, tmp_path):
    m = G.hex8_cube(spark, 2, 1, 1)
    path = sinks.write_field(m, str(tmp_path), "f", ones(m, F.col("node_id") * 0.5))
    assert [r.value for r in raw.read_array(spark, path).orderBy("id").collect()] == [0.5 * i for i in range(12)]
    mapping = spark.createDataFrame([(0, 3), (1, 0)], "id long, source long")
    assert sorted((r.id, r.value) for r in raw.read_mapped_field(spark, path, mapping).collect()) == [(0, 1.5), (1, 0.0)]
    grid = spark.range(24).selectExpr("id % 4 as ix", "id div 4 % 3 as iy", "id div 12 as iz", "0 as comp", "cast(id as float) as value")
    sinks.write_grid(grid, str(tmp_path / "g"), (4, 3, 2), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    back, meta = raw.read_grid(spark, str(tmp_path / "g"), shift=1.0, scale=2.0)
    assert meta["nx"] == 4 and {(r.ix, r.iy, r.iz): r.value for r in back.collect()} == {(i % 4, i // 4 % 3, i // 12): 2.0 * (i + 1) for i in range(24)}
    sinks.write_csr(graph.node_to_node(m), 12, str(tmp_path / "c"))
    pointers = raw.read_array(spark, str(tmp_path / "c" / "rowptr.int32")).select(F.col("id").alias("row"), F.col("value").alias("start"))
    columns = raw.read_array(spark, str(tmp_path / "c" / "colidx.int32")).select(F.col("id").alias("k"), F.col("value").cast("long").alias("j"))
    same = lambda x: sorted((r.i, r.j) for r in x.collect())
    assert same(graph.from_row_pointers(pointers, columns)) == same(graph.node_to_node(m))
    sinks.write_mesh(m, str(tmp_path / "m"))
    again = raw.mesh_from_description(spark, {"type": "file", "path": "m"}, str(tmp_path))
    assert again.n_elements() == 2 and raw.mesh_from_description(spark, {"type": "sqare", "nx": 2, "ny": 3}).n_elements() == 6
    with pytest.raises(ValueError):
        raw.mesh_from_description(spark, {"type": "file"})


def test_refinement_and_volume(spark):
    m = convert.refine(G.tet4_cube(spark, 1, 1, 1))
    v = geometry.volumes(m).agg(F.count("*"), F.min("volume"), F.sum("volume")).first()
    assert v[0] == 96 and v[1] > 0 and math.isclose(v[2], 1, rel_tol=1e-5)


def test_lattice_levels_and_points(spark):
    assert lattice.levels_of(24) == [1, 6, 12, 24]
    m = lattice.to_semistructured(G.hex8_cube(spark, 1, 1, 2), 4, hierarchical=True)
    assert m.points.count() == 5 * 5 * 9 == m.points.select("x", "y", "z").distinct().count()
    assert lattice.derefine(m, 2).max_node_id().first()[0] == 3 * 3 * 5 - 1


def test_restriction_of_ones_and_linear_prolongation(spark):
    fine = lattice.to_semistructured(G.hex8_cube(spark, 1, 1, 1), 2, hierarchical=True)
    coarse = lattice.derefine(fine, 1)
    assert {round(r.value, 9) for r in transfer.Restrict(fine, coarse).apply(ones(fine)).collect()} == {3.375}
    f = F.col("x") + 2 * F.col("y") + 4 * F.col("z")
    p = transfer.prolongate(transfer.level_weights(fine, coarse), ones(coarse, f.cast("double")))
    assert p.join(fine.points, F.col("id") == F.col("node_id")).agg(F.max(F.abs(F.col("value") - f))).first()[0] < 1e-6


def test_hilbert_order(spark):
    keys = order.element_keys(G.hex8_cube(spark, 2, 2, 2)).orderBy("elem_id").collect()
    assert [r.key for r in keys] == [0, 1073741823, 498522989, 575218834, 153391689, 920350134, 306783378, 766958445]


def test_cuthill_mckee_is_a_permutation(spark):
    g = graph.node_to_node(G.tri3_square(spark, 2, 2))
    assert sorted(r.new_id for r in order.cuthill_mckee(g, 9).collect()) == list(range(9))


def test_cuthill_mckee_of_several_components(spark):
    """Against a plain queue: the first component has the least degree, the others start at their lowest ids."""
    links = [(0, 1), (1, 2), (0, 2), (5, 4), (5, 6), (5, 7), (6, 7), (9, 8)]
    both = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    g = spark.createDataFrame(sorted(both), "i long, j long")
    near = {i: sorted(b for a, b in both if a == i) for i in range(11)}
    want, todo = [], list(range(11))
    seed = min(todo, key=lambda i: (len(near[i]), i))
    while todo:
        level = [seed]
        while level:
            want += level
            todo = [i for i in todo if i not in level]
            place = {v: want.index(v) for v in level}
            new = {j for v in level for j in near[v] if j in todo}
            level = sorted(new, key=lambda j: (min(place[v] for v in near[j] if v in place), len(near[j]), j))
        seed = min(todo, default=0)
    assert [r.node for r in order.cuthill_mckee(g, 11).orderBy("new_id").collect()] == want


def test_rules():
    for n in (2, 3, 5, 7, 9, 17):
        x, w = gauss_lobatto(n)
        assert math.isclose(sum(w), 1) and math.isclose(sum(a * b for a, b in zip(x, w)), 0.5)


def test_distance_of_points_beyond_one_cell(spark):
    points = [(0, 0.0, 0.0, 0.0), (1, 0.05, 0.0, 0.0), (2, 0.33, 0.2, 0.0), (3, -40.0, 7.0, 3.0), (4, 0.0, 0.0, None)]
    surface = [(0, 0.0, 0.0, 0.0), (9, 0.6, 0.2, 0.05)]
    df = lambda rows: spark.createDataFrame(rows, "node_id long, x double, y double, z double")
    got = {r.node_id: r.distance for r in geometry.signed_distance(df(points), df(surface)).collect()}
    want = {i: min(math.dist([v or 0.0 for v in p], s) for _, *s in surface) for i, *p in points}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    assert [r.distance for r in geometry.signed_distance(df(points), df([])).collect()] == [None] * 5


def test_side_tables_look_outward_and_parts_fill_their_element():
    """On reference shapes: sides' normals lead away from the middle, nodes between corners lie between them, and the parts
    that an element is cut into have positive volumes that add up."""
    import numpy as np

    from tessella.operators import convert

    tet = np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], float)
    hexa = np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)], float)
    wedge = np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1)], float)
    mid = lambda p, pairs: np.concatenate([p, [(p[a] + p[b]) / 2 for a, b in pairs]])
    tet10 = mid(tet, [(0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3)])
    hexa20 = mid(hexa, [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)])
    hexa27 = np.concatenate([hexa20, [hexa[list(s)].mean(0) for s in E.SIDES["HEX8"]], [hexa.mean(0)]])
    for kind, p in (("TET4", tet), ("HEX8", hexa), ("WEDGE6", wedge)):
        for s in E.SIDES[kind]:
            q = p[list(s)]
            assert np.cross(q[1] - q[0], q[2] - q[0]) @ (q.mean(0) - p.mean(0)) > 0, (kind, s)
    for kind, p, n in (("TET10", tet10, 3), ("HEX27", hexa27, 4)):
        for s in E.SIDES[kind]:
            q = p[list(s)]
            for k in range(n):
                assert np.allclose(q[n + k], (q[k] + q[(k + 1) % n]) / 2), (kind, s)
            assert n == 3 or np.allclose(q[8], q[:4].mean(0))
    volume = lambda q: float(np.linalg.det(np.stack([q[1] - q[0], q[2] - q[0], q[3] - q[0]])) / 6)
    for pattern, p, whole in ((convert.HEX8_TO_TET4, hexa, 1), (convert.WEDGE6_TO_TET4, wedge, 1 / 2), (convert.TET10_TO_TET4, tet10, 1 / 6)):
        parts = [volume(p[list(t)]) for t in pattern]
        assert min(parts) > 0 and math.isclose(sum(parts), whole)


def _broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_unfolded_rows_are_never_broadcast(spark):
    """A small range or file that grows to many rows by explode passed for small."""
    tets = G.tet4_cube(spark, 6, 6, 6)
    points = spark.range(10**9).select(F.col("id").alias("node_id"), *[F.lit(0.0).alias(c) for c in "xyz"])
    assert not _broadcasts(tets.incidence().join(points, "node_id"))
    assert not _broadcasts(geometry.corner_columns(replace(tets, points=points)))
    assert not _broadcasts(convert.promote_to(tets, "TET15").elements)


def test_what_tasks_hold_does_not_grow_with_the_mesh(spark):
    """Partitions grow with the cells; coordinates meet in hash tables of points, and rows are dealt to their elements as they are."""
    assert G.hex8_cube(spark, 80, 80, 80).elements.rdd.getNumPartitions() >= 80**3 / G.SLAB
    assert G.hex8_cube(spark, 80, 80, 80, slabs=3).elements.rdd.getNumPartitions() == 3
    mesh = G.tet4_cube(spark, 2, 2, 2)
    for out in (geometry.volumes(mesh), sets.centroids(mesh)):
        plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 3
    assert abs(geometry.volumes(mesh).agg(F.sum("volume")).first()[0] - 1) < 1e-6


def test_elements_that_share_two_nodes(spark):
    """Only pairs with two common nodes meet, so what is held doesn't grow with the square of a node's elements."""
    sets_ = {e: {0, *(10 + (e * k) % 23 for k in range(e % 7))} for e in range(40)}
    h = spark.createDataFrame([(e, v) for e, s in sets_.items() for v in s], "elem_id long, node_id long")
    want = {(a, b, len(sets_[a] & sets_[b])) for a in sets_ for b in sets_ if a < b and len(sets_[a] & sets_[b]) > 1}
    assert set(map(tuple, graph.sharing_two(h).collect())) == want and len({k for *_, k in want}) > 2
    # 3000 elements around one node: 4.5 million pairs of them, none of which meet.
    star = spark.range(3000).select(F.col("id").alias("elem_id"), F.explode(F.array(F.lit(-1).cast("long"), F.col("id"))).alias("node_id"))
    assert graph.sharing_two(star).count() == 0


def test_volumes_of_located_elements_shuffle_nothing_after_a_split(spark):
    tets = G.cube(spark, "TET4", 2, 1, 1)
    m = convert.promote_to(tets, "TET15")
    whole, at = (convert.convert_to(convert.convert_to(x, "HEX8"), "TET4") for x in (m, geometry.located(m)))
    want, got = ({r.elem_id: r.volume for r in geometry.volumes(x).collect()} for x in (whole, at))
    assert got == want and len(got) == 24 * 24 and abs(sum(got.values()) - 1) < 1e-5
    plans = [geometry.volumes(x)._jdf.queryExecution().optimizedPlan().toString() for x in (at, geometry.located(m))]
    assert plans[0].count("Join") == plans[1].count("Join")
