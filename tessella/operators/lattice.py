"""Semistructured elements: lattices of (level + 1)^3 or (level + 1)^2 nodes with unique ids on shared edges and faces."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elem_types import EDGES, SIDES, corners, element_type, lattice_index, linear, proteus_hex, proteus_quad
from ..functions.quadrature import gauss_lobatto
from ..mesh import Block, Mesh, unfolded
from ..storage import materialize
from . import graph
from .numbering import dense_ids

_AT = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))


def levels_of(level: int) -> list[int]:
    """Nested levels: the level, its halves as long as they are whole, and 1; 24 gives 1, 6, 12, 24."""
    out, n = {1, level}, level
    while n > 1 and n % 2 == 0:
        out.add(n)
        n //= 2
    return sorted(out)


def entity_of(level: int, dim: int = 3) -> list[int]:
    """Of each lattice place the entity that it lies in, as its place in `firsts`: edges, then a hexahedron's sides, then corners, and
    last the inside."""
    at = entity_codes(dim)
    code = lambda c: 0 if c == 0 else 2 if c == level else 1
    r = range(level + 1)
    return [at[code(x) + 3 * code(y) + (9 * code(z) if dim == 3 else 0)] for z in (r if dim == 3 else (0,)) for y in r for x in r]


def entity_codes(dim: int = 3) -> list[int]:
    """The same by where a place (or several) lies along each axis: 0 at the lower end, 2 at the upper, 1 between, x fastest."""
    kind = "HEX8" if dim == 3 else "QUAD4"
    held = [*EDGES[kind], *(SIDES[kind] if dim == 3 else ()), *((k,) for k in range(2**dim))]
    out = [len(held)] * 3**dim
    for e, at in enumerate(held):
        ends = [{_AT[k][d] for k in at} for d in range(dim)]
        out[sum(3**d * (1 if len(x) > 1 else 2 * min(x)) for d, x in enumerate(ends))] = e
    return out


def owned(firsts: Column, entity: Column) -> Column:
    """Whether an element is the first that has an entity; what is inside it is its own."""
    return F.coalesce(F.get(firsts, entity), F.lit(True))


def _walks(nodes: Column, level: int, solid: bool) -> list[Column]:
    """The lattice places inside each edge and side, in an order that all elements around it share: edges from the lower corner;
    sides from the smallest corner, inner axis toward the smaller of its two neighbours."""
    kind = "HEX8" if solid else "QUAD4"
    out = []
    # Both orientations' lattice places are fixed lists; the lower corner decides which one is used.
    for a, b in EDGES[kind]:
        w = [lattice_index(level, *(_AT[a][d] * level + (_AT[b][d] - _AT[a][d]) * t for d in range(3))) for t in range(1, level)]
        out.append(F.when(F.get(nodes, F.lit(a)) < F.get(nodes, F.lit(b)), graph.ints(w)).otherwise(graph.ints(w[::-1])))
    if not solid:
        return out

    def walk(side: int, origin: int, turn: int) -> list[int]:
        """One of eight oriented walks of a side."""
        c = [_AT[k] for k in SIDES["HEX8"][side]]
        o, u, v = c[origin], c[(origin + turn) % 4], c[(origin - turn) % 4]
        at = lambda d, i, j: o[d] * level + (u[d] - o[d]) * i + (v[d] - o[d]) * j
        return [lattice_index(level, *(at(d, i, j) for d in range(3))) for j in range(1, level) for i in range(1, level)]

    lists = F.array(*[F.array(*[graph.ints(walk(side, o, t)) for o in range(4) for t in (1, -1)]) for side in range(6)])
    for side, corner in enumerate(SIDES["HEX8"]):
        own = graph.picked(nodes, tuple(corner))
        o = F.array_position(own, F.array_min(own)).cast("int") - 1
        turn = F.when(F.get(own, (o + 1) % 4) < F.get(own, (o + 3) % 4), 0).otherwise(1)
        out.append(F.get(F.get(lists, F.lit(side)), o * 2 + turn))
    return out


def _told(lnode: Column, node: Column) -> Column:
    return F.struct(lnode.cast("int").alias("lnode"), node.cast("long").alias("n"))


def _inside(level: int, solid: bool) -> list[int]:
    r = range(1, level)
    return [lattice_index(level, x, y, z) for z in (r if solid else (0,)) for y in r for x in r]


def _skeleton(mesh: Mesh, hierarchical: bool) -> tuple[DataFrame, int, int, int]:
    """block_id, elem_id, nodes, at (for each edge, side and corner in the order of `entity_of`: its number n, whether the element is
    the first that has it, and a corner's x, y, z), and how many corners, edges and sides there are. Edges are numbered by (i, j),
    sides by their first element and side, corners keep their ids; hierarchical: corners by (corner, element)."""
    kind = linear(mesh.elem_type)
    nodes, n_at = F.col("nodes"), len(EDGES[kind])
    own = F.struct("elem_id", "at").alias("first")
    ends = F.array(*[F.struct(F.least(F.get(nodes, F.lit(a)), F.get(nodes, F.lit(b))).alias("i"), F.greatest(F.get(nodes, F.lit(a)), F.get(nodes, F.lit(b))).alias("j")) for a, b in EDGES[kind]])
    e = mesh.elements.select("block_id", "elem_id", F.posexplode(ends).alias("at", "s")).select("block_id", "elem_id", "at", "s.i", "s.j")
    edges = materialize(dense_ids(e.where("i < j").groupBy("i", "j").agg(F.min(own).alias("first")), ["i", "j"], "n"))
    first = F.col("first") == F.struct("elem_id", "at")
    none = [F.lit(None).cast("float").alias(c) for c in "xyz"]
    rows = ["block_id", "elem_id", "at", "n", first.alias("f")]
    numbered = unfolded(e).join(edges, ["i", "j"]).select(*rows, *none)
    n_edges, n_sides = edges.count(), 0
    if kind == "HEX8":
        s = graph.sides(mesh, corners_only=True).select("block_id", "elem_id", F.col("lfi").cast("int").alias("at"), "key")
        sides = materialize(dense_ids(s.groupBy("key").agg(F.min(own).alias("first")), ["first.elem_id", "first.at"], "n"))
        n_sides = sides.count()
        numbered = numbered.unionByName(unfolded(s).join(sides, "key").select(*rows, *none).withColumn("at", F.col("at") + n_at))
        n_at += 6
    c = mesh.elements.select("block_id", "elem_id", F.posexplode("nodes").alias("at", "node_id"))
    # The first by (corner, element) here, which is how corners are numbered; corners in the lattice's order.
    mine = F.struct(F.get(graph.ints(lattice_index(1, *p) for p in _AT), F.col("at")).alias("place"), "elem_id")
    corner = c.groupBy("node_id").agg(F.min(mine).alias("first"))
    corner = materialize((dense_ids(corner, ["first.place", "first.elem_id"], "n") if hierarchical else corner.withColumn("n", F.col("node_id"))).join(mesh.points, "node_id"))
    placed = unfolded(c).join(corner, "node_id").select("block_id", "elem_id", "at", "n", (F.col("first") == mine).alias("f"), *"xyz")
    numbered = numbered.unionByName(placed.withColumn("at", F.col("at") + n_at))
    by = numbered.groupBy("block_id", "elem_id").agg(F.sort_array(F.collect_list(F.struct("at", "n", "f", *"xyz"))).alias("at"))
    return unfolded(mesh.elements).join(by, ["block_id", "elem_id"]), corner.count() if hierarchical else mesh.n_nodes(), n_edges, n_sides


def _plain(level: int, solid: bool, n0: int, n_edges: int, n_sides: int) -> Column:
    """A skeleton row's nodes, unless they are hierarchical."""
    inner, nodes, number = level - 1, F.col("nodes"), F.col("at.n")
    n_e = 12 if solid else 4
    n_at = n_e + (6 if solid else 0)
    parts = [F.array(*[_told(F.lit(lattice_index(level, *(level * c for c in p))), F.get(number, F.lit(n_at + k))) for k, p in enumerate(_AT if solid else _AT[:4])])]
    first_side = n0 + n_edges * inner
    first_cell = first_side + n_sides * inner**2
    along = lambda lnodes, k, step, start: F.transform(lnodes, lambda lnode, t: _told(lnode, k * step + t + start))
    for at, w in enumerate(_walks(nodes, level, solid)):
        parts.append(along(w, F.get(number, F.lit(at)), *((inner, n0) if at < n_e else (inner**2, first_side))))
    inside = _inside(level, solid)
    parts.append(along(graph.ints(inside), F.col("elem_id"), len(inside), first_cell))
    return F.sort_array(F.concat(*parts)).getField("n")


def generate_elements(mesh: Mesh, level: int) -> tuple[DataFrame, int]:
    """Lattice connectivity of a HEX8, QUAD4 or QUADSHELL4 mesh and the number of nodes.

    Corners keep their ids; level - 1 ids an edge, edges by (i, j), counted from the lower corner; (level - 1)^2 ids a
    face, faces by their first element and side, counted from the smallest corner, inner axis toward the smaller of its
    two neighbours; (level - 1)^3 ids inside, by element.
    """
    solid = linear(mesh.elem_type) == "HEX8"
    if level == 1:
        at = sorted((lattice_index(1, *p), k) for k, p in enumerate(_AT if solid else _AT[:4]))
        return mesh.elements.select("block_id", "elem_id", graph.picked(F.col("nodes"), tuple(k for _, k in at)).alias("nodes")), mesh.n_nodes()
    rows, *n = _skeleton(mesh, False)
    inner = level - 1
    total = n[0] + n[1] * inner + n[2] * inner**2 + mesh.n_elements() * inner ** (3 if solid else 2)
    return rows.select("block_id", "elem_id", _plain(level, solid, *n).alias("nodes")), total


def _ranks(level: int, dim: int) -> list[int]:
    """The coarsest nested level that has each lattice place, counted from 0."""
    coarse, r = levels_of(level), range(level + 1)
    return [next(k for k, lv in enumerate(coarse) if all(c % (level // lv) == 0 for c in (x, y, z))) for z in (r if dim == 3 else (0,)) for y in r for x in r]


def _hierarchical(rows: DataFrame, level: int, solid: bool, n0: int, n_edges: int, n_sides: int) -> DataFrame:
    """Skeleton rows -> block_id, elem_id, at, ids: nodes as `hierarchical_renumbering` numbers them.

    A node counts with the first element that has its edge or side, so an element's numbers follow from how many edges and sides
    the elements before it are the first of. Only rows of edges and sides are sent to the elements that share them.
    """
    from pyspark.sql import Window as W

    dim = 3 if solid else 2
    ranks, entity = _ranks(level, dim), entity_of(level, dim)
    n_e = 12 if solid else 4
    n_at, inside = (18, 26) if solid else (4, 8)
    rank_of = range(1, max(ranks) + 1)
    per = {r: [sum(1 for k, x in zip(ranks, entity) if k == r and x == e) for e in (0, n_e if solid else None, inside)] for r in rank_of}
    firsts = F.col("at.f")

    # Edges and sides that elements before are the first of, by ranges of elements first, as in `running_total`.
    count = lambda lo, hi: F.size(F.filter(F.slice(firsts, lo + 1, hi - lo), lambda f: f)).cast("long") if hi > lo else F.lit(0).cast("long")
    thin = rows.select("block_id", "elem_id", "nodes", "at.n", "at.f", F.lit(1).cast("long").alias("c0"), count(0, n_e).alias("c1"), count(n_e, n_at).alias("c2"), F.shiftright("elem_id", 16).alias("r"))
    sums = [f"c{k}" for k in range(3)]
    total = thin.groupBy("r").agg(*[F.sum(c).alias(f"t{c}") for c in sums])
    upto = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    before = materialize(total.select(F.col("r").alias("br"), *[F.coalesce(F.sum(f"t{c}").over(upto), F.lit(0)).alias(f"b{c}") for c in sums]))
    inner = W.partitionBy("r").orderBy("elem_id").rowsBetween(W.unboundedPreceding, -1)
    thin = thin.withColumns({f"o{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in sums}).join(F.broadcast(before), F.col("r") == F.col("br"))
    n_elements = rows.count()
    shift, start, low = [], F.lit(0).cast("long"), n0
    for r in rank_of:
        e, s, i = per[r]
        shift.append(F.lit(low) + (F.col("oc1") + F.col("bc1")) * e + (F.col("oc2") + F.col("bc2")) * s + (F.col("oc0") + F.col("bc0")) * i - start)
        start = start + F.col("c1") * e + F.col("c2") * s + F.lit(i)
        low += e * n_edges + s * n_sides + i * n_elements
    thin = thin.select("block_id", "elem_id", "nodes", "n", "f", F.array(*shift).alias("shift"))

    # All places but corners by (rank, place): an element's own ones keep that order, so its numbers count along it.
    order = sorted((k, p) for p, k in enumerate(ranks) if k)
    fixed = F.arrays_zip(graph.ints(p for _, p in order).alias("p"), graph.ints(k for k, _ in order).alias("k"), graph.ints(entity[p] for _, p in order).alias("e"))
    corner = [lattice_index(level, *(level * c for c in p)) for p in (_AT if solid else _AT[:4])]

    def own(f: Column, shift: Column) -> Column:
        return F.transform(F.filter(fixed, lambda x: owned(f, x["e"])), lambda x, i: _told(x["p"], F.get(shift, x["k"] - 1) + i))

    rest = F.transform(F.filter(fixed, lambda x: ~owned(F.col("f"), x["e"])), lambda x: _told(x["p"], F.lit(None)))
    known = F.sort_array(F.concat(own(F.col("f"), F.col("shift")), rest, F.array(*[_told(F.lit(p), F.lit(None)) for p in corner]))).getField("n")
    thin = materialize(thin.withColumn("known", known))
    sent = [F.struct(F.lit(k).alias("at"), F.get("n", F.lit(k)).alias("n"), F.transform(w, lambda p: F.get("known", p)).alias("ids")) for k, w in enumerate(_walks(F.col("nodes"), level, solid))]
    sent = thin.select(F.explode(F.filter(F.array(*sent), lambda x: F.get("f", x["at"]))).alias("s")).select(F.col("s.n").alias("n"), (F.col("s.at") >= n_e).alias("side"), "s.ids")
    asked = rows.select("block_id", "elem_id", F.explode(F.filter(F.transform(F.slice("at", 1, n_at), lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["f"].alias("f"))), lambda x: ~x["f"])).alias("s"))
    asked = unfolded(asked.select("block_id", "elem_id", "s.at", "s.n", (F.col("s.at") >= n_e).alias("side")))
    given = asked.join(sent, ["n", "side"]).select("block_id", "elem_id", "at", "ids")
    given = given.unionByName(thin.select("block_id", "elem_id", F.lit(n_at).alias("at"), F.col("shift").alias("ids")))
    given = given.groupBy("block_id", "elem_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "ids"))).alias("given"))
    both = unfolded(rows).join(given, ["block_id", "elem_id"])
    parts = [F.array(*[_told(F.lit(p), F.get("at.n", F.lit(n_at + k))) for k, p in enumerate(corner)]), own(firsts, F.element_at("given", F.lit(n_at)))]
    for k, w in enumerate(_walks(F.col("nodes"), level, solid)):
        ids = F.col("given")[F.lit(k)]
        parts.append(F.when(F.get(firsts, F.lit(k)), F.expr("cast(array() as array<struct<lnode:int,n:bigint>>)")).otherwise(F.transform(w, lambda p, t: _told(p, F.get(ids, t)))))
    return both.select("block_id", "elem_id", "at", F.sort_array(F.concat(*parts)).getField("n").alias("ids"))


def multilinear(level: int, nodes_1d: list[float] | None = None, dim: int = 3) -> list[tuple[int, int, float]]:
    """(lattice index, corner, weight) of the map from an element's corners, uniform or on given 1-D nodes."""
    x1 = nodes_1d or [i / level for i in range(level + 1)]
    out = []
    r = range(level + 1)
    for z in r if dim == 3 else (0,):
        for y in r:
            for x in r:
                for c, (a, b, d) in enumerate(_AT[: 2**dim]):
                    w = (x1[x] if a else 1 - x1[x]) * (x1[y] if b else 1 - x1[y]) * ((x1[z] if d else 1 - x1[z]) if dim == 3 else 1)
                    if w:
                        out.append((lattice_index(level, x, y, z), c, w))
    return out


def fill_points(macro: Mesh, elements: DataFrame, level: int, nodes_1d: list[float] | None = None) -> DataFrame:
    """Lattice coordinates by the multilinear map of each element's corners; one row a node.

    The map is applied inside the element's row. A node of several elements takes what the first gives; nodes inside an element
    are not shuffled for that.
    """
    from .geometry import corner_columns
    from .transfer import inner_places

    t = element_type(macro.elem_type)
    n = 2**t.dim
    weight = [0.0] * ((level + 1) ** t.dim * n)
    for lidx, c, w in multilinear(level, nodes_1d, t.dim):
        weight[lidx * n + c] = w
    weights = F.split(F.lit(",".join(map(repr, map(float, weight)))), ",").cast("array<double>")
    both = unfolded(elements).join(corner_columns(macro, n), ["block_id", "elem_id"])
    w = [F.get(weights, F.col("lidx") * n + c) for c in range(n)]
    at = lambda c: sum((F.when(w[k] == 0, 0.0).otherwise(w[k] * F.col(f"{c}{k}")) for k in range(n)), F.lit(0.0)).cast("float").alias(c)
    inside = inner_places(Mesh(macro.points, elements, (Block(0, "lattice", proteus_hex(level)),))) if t.dim == 3 else set()
    corner = [f"{c}{k}" for c in "xyz" for k in range(n)]
    long = both.select("block_id", "elem_id", *corner, F.posexplode("nodes").alias("lidx", "node_id"))
    alone = F.get(graph.ints(int(k in inside) for k in range((level + 1) ** t.dim)), F.col("lidx")) == 1
    rows = lambda which: long.where(which).select("block_id", "elem_id", "lidx", "node_id", *[at(c) for c in "xyz"])
    first = rows(~alone).groupBy("node_id").agg(F.min(F.struct("block_id", "elem_id", "lidx", *"xyz")).alias("o")).select("node_id", "o.x", "o.y", "o.z")
    return first.unionByName(rows(alone).select("node_id", *"xyz")) if inside else first


def to_semistructured(mesh: Mesh, level: int, hierarchical: bool = False, gll: bool = False) -> Mesh:
    """Elements are written once, beside their corners' coordinates; points are made of those rows, each by the first element that
    has it."""
    names = {"HEX8": proteus_hex(level), "QUAD4": proteus_quad(level), "QUADSHELL4": proteus_quad(level, True)}
    if mesh.elem_type not in names:
        raise ValueError("only HEX8, QUAD4 and QUADSHELL4 meshes become semistructured")
    nodes_1d = gauss_lobatto(level + 1)[0] if gll else None
    blocks = (replace(mesh.blocks[0], elem_type=names[mesh.elem_type]),)
    if level == 1:
        rows = materialize(generate_elements(mesh, level)[0])
        return Mesh(fill_points(mesh, rows, level, nodes_1d), rows, blocks, mesh.dim)
    solid = linear(mesh.elem_type) == "HEX8"
    rows, *n = _skeleton(mesh, hierarchical)
    if hierarchical:
        rows = _hierarchical(materialize(rows), level, solid, *n)
    else:
        rows = rows.select("block_id", "elem_id", "at", _plain(level, solid, *n).alias("ids"))
    n_at = 18 if solid else 4
    corner = F.slice("at", n_at + 1, 8 if solid else 4)
    wide = materialize(rows.select("block_id", "elem_id", F.col("ids").alias("nodes"), F.col("at.f").alias("firsts"), *[corner.getField(c).alias(c) for c in "xyz"]))
    elements = wide.select("block_id", "elem_id", "nodes")
    return Mesh(_own_points(wide, level, nodes_1d, 3 if solid else 2), elements, blocks, mesh.dim, told=(elements, wide.select("block_id", "elem_id", "nodes", "firsts", *([F.lit(True).alias("levels")] if hierarchical else []))))


def _own_points(wide: DataFrame, level: int, nodes_1d: list[float] | None, dim: int) -> DataFrame:
    """node_id, x, y, z of the nodes whose first element a row is, by the multilinear map of its corners (x, y, z, side by side)."""
    n = 2**dim
    weight = [0.0] * ((level + 1) ** dim * n)
    for lidx, c, w in multilinear(level, nodes_1d, dim):
        weight[lidx * n + c] = w
    weights = F.split(F.lit(",".join(map(repr, map(float, weight)))), ",").cast("array<double>")
    entity = graph.ints(entity_of(level, dim))
    corner = [F.get(c, F.lit(k)).cast("double").alias(f"{c}{k}") for c in "xyz" for k in range(n)]
    long = wide.select("firsts", *corner, F.posexplode("nodes").alias("lidx", "node_id")).where(owned(F.col("firsts"), F.get(entity, F.col("lidx"))))
    w = [F.get(weights, F.col("lidx") * n + c) for c in range(n)]
    at = lambda c: sum((F.when(w[k] == 0, 0.0).otherwise(w[k] * F.col(f"{c}{k}")) for k in range(n)), F.lit(0.0)).cast("float").alias(c)
    return long.select("node_id", *[at(c) for c in "xyz"])


def hierarchical_renumbering(mesh: Mesh, keep_corners: bool = False) -> Mesh:
    """Nodes of coarser levels get lower ids: corners first by (corner, element), then by (level, element, lattice place)."""
    t = element_type(mesh.elem_type)
    n = t.level
    coarse = levels_of(n)

    def rank(x: int, y: int, z: int) -> int:
        for k, lv in enumerate(coarse):
            if all(c % (n // lv) == 0 for c in (x, y, z)):
                return k
        return len(coarse)

    r = range(n + 1)
    ranks = graph.ints(rank(x, y, z) for z in (r if t.dim == 3 else (0,)) for y in r for x in r)
    long = mesh.incidence().withColumn("rank", F.get(ranks, F.col("lnode")))
    # Corners are numbered corner by corner over all elements, the others element by element.
    corner = F.col("rank") == 0
    first = F.struct("rank", F.when(corner, F.col("lnode").cast("long")).otherwise(F.col("elem_id")).alias("a"), F.when(corner, F.col("elem_id")).otherwise(F.col("lnode").cast("long")).alias("b"))
    seen = long.groupBy("node_id").agg(F.min(first).alias("f"))
    if keep_corners:
        top = long.where(corner).agg(F.max("node_id")).first()[0]
        rest = dense_ids(seen.where("f.rank > 0"), ["f.rank", "f.a", "f.b"], "new_id", top + 1).select("node_id", "new_id")
        ids = rest.unionByName(seen.where("f.rank = 0").select("node_id", F.col("node_id").alias("new_id")))
    else:
        ids = dense_ids(seen, ["f.rank", "f.a", "f.b"], "new_id").select("node_id", "new_id")
    from .sets import renumber_nodes

    return renumber_nodes(mesh, materialize(ids))


def derefine(mesh: Mesh, to_level: int) -> Mesh:
    """A coarser level of a hierarchically numbered mesh: a sub-lattice, points up to its largest id."""
    t = element_type(mesh.elem_type)
    if t.level % to_level:
        raise ValueError("levels have to be nested")
    step = t.level // to_level
    r = range(0, t.level + 1, step)
    at = tuple(lattice_index(t.level, x, y, z) for z in r for y in r for x in r) if t.dim == 3 else tuple(lattice_index(t.level, x, y) for y in r for x in r)
    name = proteus_hex(to_level) if t.dim == 3 else proteus_quad(to_level, "SHELL" in t.name)
    blocks = (replace(mesh.blocks[0], elem_type=name),)
    wide = mesh.first_rows()
    if wide is not None and "levels" in wide.columns:  # nodes of coarser levels come first, without a gap
        wide = wide.withColumn("nodes", graph.picked(F.col("nodes"), at))
        rows = wide.select("block_id", "elem_id", "nodes")
        top = rows.agg(F.max(F.array_max("nodes"))).first()[0]
        if top is not None:
            return replace(mesh, elements=rows, points=mesh.points.where(F.col("node_id") <= top), blocks=blocks, told=(rows, wide))
    rows = mesh.elements.withColumn("nodes", graph.picked(F.col("nodes"), at))
    used = rows.select(F.explode("nodes").alias("node_id")).distinct()
    return replace(mesh, elements=rows, points=mesh.points.join(used, "node_id", "left_semi"), blocks=blocks)


def corner_nodes(mesh: Mesh) -> Column:
    return graph.picked(F.col("nodes"), corners(mesh.elem_type))
