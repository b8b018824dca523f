"""Semistructured meshes of any level, and the transfer between quadrilateral lattices."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import elem_types as E
from tessella.mesh import Block, Mesh
from tessella.operators import convert, geometry, lattice, transfer
from tessella.sources import generate as G


def single(spark, level, ids):
    """One quadrilateral lattice with these node ids."""
    rows = spark.createDataFrame([(0, 0, list(ids))], "block_id int, elem_id long, nodes array<long>")
    points = spark.range(max(ids) + 1).select(F.col("id").alias("node_id"), *[F.lit(0.0).cast("float").alias(c) for c in "xyz"])
    return Mesh(points, rows, (Block(0, "q", E.proteus_quad(level)),), 2)


def values(spark, xs):
    return spark.createDataFrame([(i, 0, float(x)) for i, x in enumerate(xs)], "id long, comp int, value double")


def got(field):
    return {r.id: round(r.value, 12) for r in field.collect()}


def test_level_24_and_its_nested_levels(spark):
    assert E.element_type("PROTEUS_HEX15625").level == 24 and E.element_type("PROTEUS_QUADSHELL625").level == 24
    with pytest.raises(ValueError):
        E.element_type("PROTEUS_HEX15624")
    m = lattice.to_semistructured(G.hex8_cube(spark, 1, 1, 2), 24, hierarchical=True)
    m = Mesh(m.points.cache(), m.elements.cache(), m.blocks, 3)
    assert m.elem_type == "PROTEUS_HEX15625" and m.points.count() == 25 * 25 * 49
    for k in (12, 6, 1):
        assert lattice.derefine(m, k).max_node_id().first()[0] == (k + 1) ** 2 * (2 * k + 1) - 1
    v = geometry.volumes(convert.convert_to(m, "HEX8")).agg(F.count("*"), F.min("volume"), F.sum("volume")).first()
    assert v[0] == 2 * 24**3 and v[1] > 0 and abs(v[2] - 1) < 1e-3


def test_gll_points_keep_the_corners(spark):
    m = lattice.to_semistructured(G.hex8_cube(spark, 1, 1, 1), 4, gll=True)
    xs = sorted(r.x for r in m.points.select("x").distinct().collect())
    assert len(xs) == 5 and xs[0] == 0 and abs(xs[2] - 0.5) < 1e-6 and xs[4] == 1 and abs(xs[1] - 0.25) > 0.05


STRIDED = [0, 4, 1, 7, 8, 5, 3, 6, 2]


def test_quadrilateral_restriction_and_prolongation(spark):
    fine = single(spark, 2, STRIDED)
    coarse = lattice.derefine(fine, 1)
    w = transfer.level_weights(fine, coarse)
    assert got(transfer.restrict(w, values(spark, [1] * 9))) == dict.fromkeys(range(4), 2.25)
    p = got(transfer.prolongate(w, values(spark, [0, 2, 2, 0])))
    assert [p[i] for i in STRIDED] == [0, 1, 2] * 3
    w = transfer.level_weights(single(spark, 4, range(25)), single(spark, 2, range(9)))
    assert list(dict(sorted(got(transfer.restrict(w, values(spark, [1] * 25))).items())).values()) == [2.25, 3, 2.25, 3, 4, 3, 2.25, 3, 2.25]
    assert list(dict(sorted(got(transfer.prolongate(w, values(spark, [0, 0, 0, 2, 2, 2, 4, 4, 4]))).items())).values()) == [y for y in range(5) for _ in range(5)]


def test_quadrilateral_incidence_and_matrix(spark):
    rows = spark.createDataFrame([(0, 0, list(range(9))), (0, 1, list(range(6, 15)))], "block_id int, elem_id long, nodes array<long>")
    two = Mesh(single(spark, 2, range(15)).points, rows, (Block(0, "q", E.proteus_quad(2)),), 2)
    assert {r.node_id: r.n for r in transfer.multiplicity(two).collect()} == {i: 2 if 6 <= i < 9 else 1 for i in range(15)}
    fine = single(spark, 2, STRIDED)
    pointers, entries = transfer.prolongation_matrix(transfer.level_weights(fine, lattice.derefine(fine, 1)), 9)
    starts = [r.start for r in pointers.orderBy("row").collect()]
    assert starts == [0, 1, 2, 3, 4, 6, 8, 10, 12, 16]
    rows = entries.orderBy("k").collect()
    assert all(starts[r.i] <= r.k < starts[r.i + 1] for r in rows) and [r.value for r in rows[12:]] == [0.25] * 4


def test_weights_of_inner_nodes_are_not_shuffled(spark):
    """Elements meet whole, in one row each: no join on local places, and only shared nodes go through a distinct."""
    fine = lattice.to_semistructured(G.cube(spark, "HEX8", 2, 2, 2), 4, hierarchical=True)
    coarse = lattice.derefine(fine, 2)
    w = transfer.level_weights(fine, coarse)
    assert len(transfer.inner_places(fine)) == 27 and "localtablescan" not in w._jdf.queryExecution().executedPlan().toString().lower()
    rows = w.collect()
    assert len(rows) == len(set(map(tuple, rows))) == 13**3  # along an axis: 9 fine nodes, 4 of them between two
    total = {}
    for r in rows:
        total[r.row] = total.get(r.row, 0.0) + r.weight
    assert len(total) == 9**3 and set(total.values()) == {1.0}


def test_lattice_points_are_made_inside_the_elements_rows(spark):
    """No row for each pair of a lattice node and a corner: coordinates come from an element's corners side by side."""
    from tessella.operators import lattice
    from tessella.sources import generate

    macro = generate.hex8_cube(spark, 2, 1, 1)
    rows, n = lattice.generate_elements(macro, 3)
    points = lattice.fill_points(macro, rows, 3)
    assert "corner#" not in points._jdf.queryExecution().toString()
    assert points.count() == n == points.select("node_id").distinct().count() == 7 * 4 * 4


@pytest.mark.parametrize("hierarchical", [False, True])
def test_first_elements_give_the_same_lattice_without_its_nodes_shuffled(spark, hierarchical):
    """Numbers, points and pairs by the first element of each corner, edge and side equal those of the general steps."""
    from tessella.operators import graph

    macro = G.cube(spark, "HEX8", 3, 2, 1)
    turned = F.array(*[F.get("nodes", F.lit(k)) for k in (1, 2, 3, 0, 5, 6, 7, 4)])
    macro = Mesh(macro.points, macro.elements.withColumn("nodes", F.when(F.col("elem_id") % 2 == 1, turned).otherwise(F.col("nodes"))), macro.blocks)
    fine = lattice.to_semistructured(macro, 4, hierarchical=hierarchical)
    plain = lattice.to_semistructured(macro, 4)
    want = lattice.hierarchical_renumbering(Mesh(plain.points, plain.elements, plain.blocks)) if hierarchical else Mesh(lattice.fill_points(macro, plain.elements, 4), lattice.generate_elements(macro, 4)[0], plain.blocks)
    told = lambda df: sorted(map(tuple, df.collect()))
    assert {r.elem_id: r.nodes for r in fine.elements.collect()} == {r.elem_id: r.nodes for r in want.elements.collect()}
    assert [[round(v, 5) for v in r] for r in told(fine.points)] == [[round(v, 5) for v in r] for r in told(want.points)]
    pairs = graph.micro_node_to_node(fine)
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert told(pairs) == told(graph.micro_node_to_node(want))
    if hierarchical:
        coarse = lattice.derefine(fine, 2)
        assert coarse.points.count() == 7 * 5 * 3
        field = lambda m: m.points.select(F.col("node_id").alias("id"), F.lit(0).alias("comp"), (F.col("node_id") % 13).cast("double").alias("value"))
        w = transfer.level_weights(fine, coarse)
        assert got(transfer.prolongate_level(fine, coarse, field(coarse))) == got(transfer.prolongate(w, field(coarse)))
        some = field(fine).where("id % 5 <> 0 and id % 2 = 0")
        assert got(transfer.restrict_level(fine, coarse, some)) == got(transfer.restrict(w, some))
