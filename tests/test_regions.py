import random

import numpy as np

from tessella.mesh import Block, Mesh
from tessella.operators import convert, graph, regions, sets
from tessella.sources import generate as G


def _groups(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_groups_of_random_links_and_of_a_strip(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(7, 7)]
    got = regions.linked_groups(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.group for r in got.members.collect()} == _groups((a, b) for a, b in pairs if a != b)
    order = list(range(10_000))
    rng.shuffle(order)
    strip = regions.linked_groups(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long"))
    assert {r.group for r in strip.members.select("group").distinct().collect()} == {0} and strip.members.count() == 10_000
    assert strip.rounds <= 16
    assert regions.linked_groups(spark.createDataFrame([], "a long, b long")).members.count() == 0


def test_patches_of_a_bent_surface_against_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 6
    heights = rng.integers(0, 3, n + 1) * 0.5
    points = [(i * (n + 1) + j, float(i), float(j), float(heights[i])) for i in range(n + 1) for j in range(n + 1)]
    quads = [(0, i * n + j, [i * (n + 1) + j, (i + 1) * (n + 1) + j, (i + 1) * (n + 1) + j + 1, i * (n + 1) + j + 1]) for i in range(n) for j in range(n)]
    mesh = Mesh(spark.createDataFrame(points, "node_id long, x double, y double, z double"), spark.createDataFrame(quads, "block_id int, elem_id long, nodes array<long>"), (Block(0, "s", "QUAD4"),), 3)
    at = np.array([p[1:] for p in points])
    normal = {e: (lambda v: v / np.linalg.norm(v))(np.cross(at[q[1]] - at[q[0]], at[q[2]] - at[q[0]])) for _, e, q in quads}
    pairs = [(a, b) for _, a, p in quads for _, b, q in quads if a < b and len(set(p) & set(q)) == 2 and abs(normal[a] @ normal[b]) > 0.95]
    want = {e: e for _, e, _ in quads} | _groups(pairs)
    got = {r.elem_id: r.patch for r in regions.surface_patches(mesh, 0.95).collect()}
    assert got == want and 1 < len(set(want.values())) < n * n
    seed = min(range(n * n), key=lambda e: (min(np.linalg.norm(at[v] - [2.2, 3.1, 0.0]) for v in quads[e][2]), e))
    assert {r.elem_id for r in regions.select_surface(mesh, (2.2, 3.1, 0.0), 0.95).collect()} == {e for e in want if want[e] == want[seed]}


def test_submesh_along_the_elements(spark):
    mesh = G.tri3_square(spark, 4, 4)
    neighbours = {}
    for r in graph.node_to_node(mesh).collect():
        neighbours.setdefault(r.i, set()).add(r.j)
    for most in (1, 7, 18, 1000):
        queue, chosen = [12], []
        seen = {12}
        while queue and len(chosen) < most:
            v = queue.pop(0)
            chosen.append(v)
            for w in sorted(neighbours[v] - seen):
                seen.add(w)
                queue.append(w)
        got = {r.node_id for r in regions.nodes_around(mesh, (0.52, 0.51, 0.0), most, along=True).collect()}
        assert got == set(chosen)
    sub = regions.submesh_around(mesh, (0.52, 0.51, 0.0), 1, along=True)
    whole = {r.elem_id: r.nodes for r in mesh.elements.collect()}
    back = {r.node_id: r.source_id for r in sub.node_mapping.collect()}
    touching = [nodes for _, nodes in sorted(whole.items()) if 12 in nodes]
    assert [[back[v] for v in r.nodes] for r in sub.elements.orderBy("elem_id").collect()] == touching
    assert [back[k] for k in sorted(back)] == sorted({v for nodes in touching for v in nodes})
    assert regions.nodes_around(mesh, (0.0, 0.0, 0.0), 0, along=True).count() == 0


def test_dual_by_sides_equals_dual_by_count(spark):
    two = convert.convert_to(G.hex8_cube(spark, 2, 2, 1), "TET4")
    for mesh in (G.hex8_cube(spark, 3, 2, 2), two, G.tri3_square(spark, 3, 3), G.hex8_checkerboard_cube(spark, 2, 2, 2), sets.skin(G.hex8_cube(spark, 2, 2, 2))):
        assert sorted(map(tuple, graph.dual(mesh).collect())) == sorted(map(tuple, graph.dual_by_count(mesh).collect()))
