import random

import pytest
from pyspark.sql import functions as F

from tessella.mesh import Block, Mesh
from tessella.operators import colocated, convert, sets
from tessella.functions.elem_types import SIDES
from tessella.sources import generate as G


def _mesh(spark, blocks):
    """blocks: (type, lists of nodes)."""
    rows = [(b, e, nodes) for b, (_, elements) in enumerate(blocks) for e, nodes in enumerate(elements)]
    points = spark.createDataFrame([], "node_id long, x float, y float, z float")
    return Mesh(points, spark.createDataFrame(rows, "block_id int, elem_id long, nodes array<long>"), tuple(Block(b, f"b{b}", t) for b, (t, _) in enumerate(blocks)))


def _uncovered(blocks):
    out = set()
    for b, (t, elements) in enumerate(blocks):
        for e, nodes in enumerate(elements):
            for s, local in enumerate(SIDES[t]):
                side = {nodes[k] for k in local}
                if not any(side <= set(o) for c, (_, others) in enumerate(blocks) for f, o in enumerate(others) if (b, e) != (c, f)):
                    out.add((e, s, b))
    return out


def _found(mesh):
    return [tuple(r) for r in sets.uncovered_sides(mesh).select("parent", "lfi", "block_id").collect()]


def test_unequal_sides_of_hexahedra_wedges_and_tetrahedra(spark):
    hexa = [0, 1, 2, 3, 4, 5, 6, 7]
    blocks = [
        ("HEX8", [hexa, [1, 8, 9, 2, 5, 10, 11, 6]]),
        ("WEDGE6", [[3, 2, 12, 7, 6, 13], [4, 5, 6, 14, 15, 16]]),  # a whole side of the first; a triangle of its top
        ("TET4", [[4, 6, 7, 17], [0, 1, 2, 18], [19, 20, 21, 22]]),
    ]
    got = _found(_mesh(spark, blocks))
    assert len(got) == len(set(got)) and set(got) == _uncovered(blocks)
    assert (0, 5, 0) in got and (0, 4, 0) in got and (1, 3, 1) not in got  # quadrilaterals stay, triangles on them go


def test_random_meshes_against_brute_force(spark):
    rng = random.Random(5)
    for _ in range(3):
        pick = lambda n: [rng.sample(range(14), n) for _ in range(12)]
        blocks = [("TET4", pick(4) + [[1, 2, 3, 4]] * 2), ("HEX8", pick(8)), ("WEDGE6", pick(6))]
        got = _found(_mesh(spark, blocks))
        assert len(got) == len(set(got)) and set(got) == _uncovered(blocks)


def test_repeated_nodes_and_no_elements(spark):
    flat = [("HEX8", [[0, 1, 1, 0, 4, 5, 5, 4], [0, 1, 2, 3, 4, 5, 6, 7]]), ("TET4", [[9, 9, 9, 8]])]
    got = _found(_mesh(spark, flat))
    assert len(got) == len(set(got)) and set(got) == _uncovered(flat)
    assert _found(_mesh(spark, [("HEX8", []), ("TET4", [])])) == []


@pytest.mark.parametrize("kind", ["HEX8", "TET4"])
def test_whole_sides_give_the_plain_skin(spark, kind):
    mesh = G.cube(spark, kind, 3, 2, 2)
    plain = {tuple(r) for r in sets.skin_sideset(mesh).collect()}
    assert set(_found(mesh)) == plain
    if kind == "TET4":
        assert set(_found(convert.promote_to(mesh, "TET10"))) == plain


def test_lattices_go_by_their_corners(spark):
    from tessella.operators import lattice

    coarse = G.hex8_cube(spark, 2, 2, 1)
    assert set(_found(lattice.to_semistructured(coarse, 4))) == {tuple(r) for r in sets.skin_sideset(coarse).collect()}


def test_sides_beside_their_parents_without_an_exchange(spark):
    mesh = G.hex8_cube(spark, 4, 3, 3)
    two = Mesh(mesh.points, mesh.elements.unionByName(mesh.elements.where("elem_id < 7").withColumn("block_id", F.lit(1))), (Block(0, "a", "HEX8"), Block(1, "b", "HEX8")))
    sides = sets.skin_sideset(mesh)
    sides = sides.unionByName(spark.createDataFrame([(6, 2, 1), (6, 2, 1), (0, 0, 1)], "parent long, lfi short, block_id int"))
    elements = colocated.element_table(two, 5, buckets=3)
    out = colocated.beside_parents(colocated.side_table(sides, 3), elements)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    nodes = {(r.block_id, r.elem_id): r.nodes for r in two.elements.collect()}

    def place(e, n):
        runs = [n // 5 + (p < n % 5) for p in range(5)]
        p = next(p for p in range(5) if e < sum(runs[: p + 1]))
        return p, e - sum(runs[:p])

    want = sorted((place(r.parent, 36 if r.block_id == 0 else 7)[0], r.block_id, r.parent, r.lfi, place(r.parent, 36 if r.block_id == 0 else 7)[1], nodes[r.block_id, r.parent]) for r in sides.collect())
    assert sorted(map(tuple, out.collect())) == want
    owners = {(r.block_id, r.elem_id): (r.part, r.local_id) for r in elements.collect()}
    assert owners[0, 7] == (0, 7) and owners[0, 8] == (1, 0) and owners[1, 6] == (4, 0)


def test_sides_without_a_parent_are_refused(spark):
    mesh = G.hex8_cube(spark, 2, 2, 2)
    lost = spark.createDataFrame([(8, 0, 0)], "parent long, lfi short, block_id int")
    with pytest.raises(Exception, match="has no element 8"):
        colocated.redistributed(mesh, lost, 3, 2).collect()
    assert colocated.redistributed(mesh, lost.limit(0), 3, 2).count() == 0
