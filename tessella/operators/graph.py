"""Graphs of a mesh, as edge lists from group-by and self-join on its incidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elem_types import EDGES, SIDES, corners, element_type, linear, side_table
from ..mesh import Mesh

# The eight tetrahedra that a macro tetrahedron of ten nodes stands for.
MACRO_TET4 = ((0, 4, 6, 7), (4, 1, 5, 8), (6, 5, 2, 9), (7, 8, 9, 3), (4, 5, 6, 8), (7, 4, 6, 8), (6, 5, 9, 8), (7, 6, 9, 8))


#: Local nodes of a table above which it is one literal, walked through, and not an expression for each node.
UNROLLED = 512


def ints(values) -> Column:
    """An array literal of any length; folded before the query runs."""
    values = list(values)
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>") if values else F.expr("cast(array() as array<int>)")


def picked(nodes: Column, at: tuple[int, ...]) -> Column:
    if len(at) > UNROLLED:
        return F.transform(ints(at), lambda k: F.get(nodes, k))
    return F.array(*[F.get(nodes, F.lit(k)) for k in at])


def patterned(elements: DataFrame, pattern: tuple[tuple[int, ...], ...]) -> DataFrame:
    """block_id, elem_id, sub, nodes: every element once for each row of a fixed table of local nodes."""
    if sum(map(len, pattern)) > UNROLLED:
        width = len(pattern[0])
        flat = ints(k for p in pattern for k in p)
        subs = elements.select("block_id", "elem_id", F.col("nodes").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(len(pattern) - 1))).alias("sub"))
        return subs.select("block_id", "elem_id", "sub", F.transform(F.slice(flat, F.col("sub") * width + 1, F.lit(width)), lambda k: F.get("own", k)).alias("nodes"))
    rows = F.array(*[picked(F.col("nodes"), p) for p in pattern])
    return elements.select("block_id", "elem_id", F.posexplode(rows).alias("sub", "nodes"))


def by_type(mesh: Mesh, make) -> DataFrame:
    """make(elements of one type, type), put together over the mesh's types; one scan where all blocks share a type."""
    out = None
    for t in dict.fromkeys(b.elem_type for b in mesh.blocks):
        ids = [b.block_id for b in mesh.blocks if b.elem_type == t]
        mine = mesh.elements if len(ids) == len(mesh.blocks) else mesh.elements.where(F.col("block_id").isin(ids))
        part = make(mine, t)
        out = part if out is None else out.unionByName(part)
    return out


def node_to_element(mesh: Mesh) -> DataFrame:
    """node_id, block_id, elem_id: one row for every local node, repeated where an element names a node twice; a macro
    tetrahedron counts once for each of the eight it stands for."""

    def rows(elements: DataFrame, t: str) -> DataFrame:
        e = patterned(elements, MACRO_TET4).drop("sub") if t == "MACRO_TET4" else elements
        return e.select(F.explode("nodes").alias("node_id"), "block_id", "elem_id")

    return by_type(mesh, rows)


def node_to_element_lists(mesh: Mesh) -> DataFrame:
    """node_id, elems (sorted by block and element)."""
    return node_to_element(mesh).groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("block_id", "elem_id"))).alias("elems"))


def node_to_node(mesh: Mesh, elem_type: str | None = None) -> DataFrame:
    """i, j: distinct neighbours, a node's own included. Pairs are made inside each element's row, so nothing is joined.

    elem_type: restrict to the nodes of a lower type (corners).
    """

    def rows(elements: DataFrame, t: str) -> DataFrame:
        own = elements.select(picked(F.col("nodes"), corners(t)).alias("nodes")) if elem_type else elements.select("nodes")
        return own.select("nodes", F.explode("nodes").alias("i")).select("i", F.explode("nodes").alias("j"))

    return by_type(mesh, rows).distinct()


def micro_node_to_node(mesh: Mesh) -> DataFrame:
    """i, j of a hexahedral lattice's nodes over its micro elements, a node's own included: neighbours by index arithmetic inside
    the macro element's row. Where the mesh knows each element's first corners, edges and sides, a pair comes from the first element
    that has both, and nothing is shuffled; else rows of nodes on elements' sides are."""
    t = element_type(mesh.elem_type)
    if not t.semistructured or t.dim != 3:
        raise ValueError(f"{mesh.elem_type} is no hexahedral lattice")
    n, w = t.level, t.level + 1
    step = F.array(*[F.struct(*[F.lit(s).alias(c) for c, s in zip("abc", (a, b, c))]) for c in (-1, 0, 1) for b in (-1, 0, 1) for a in (-1, 0, 1)])
    k = F.col("k")
    first = mesh.first_rows()
    rows = mesh.elements.select("nodes", F.lit(None).cast("array<boolean>").alias("firsts")) if first is None else first.select("nodes", "firsts")
    at = rows.select("nodes", "firsts", F.posexplode("nodes").alias("k", "i"))
    at = at.select("nodes", "firsts", "i", (k % w).alias("x"), (F.call_function("div", k, F.lit(w)) % w).alias("y"), F.call_function("div", k, F.lit(w * w)).alias("z"))
    near = at.select("*", F.explode(step).alias("s"))
    px, py, pz = (F.col(c) + F.col(f"s.{s}") for c, s in zip("xyz", "abc"))
    near = near.where(px.between(0, n) & py.between(0, n) & pz.between(0, n))
    if first is not None:
        from .lattice import entity_codes, owned

        # The least corner, edge or side that holds both nodes: along each axis both at one end, or not.
        code = [F.when((F.col(c) == 0) & (p == 0), 0).when((F.col(c) == n) & (p == n), 2).otherwise(1) for c, p in zip("xyz", (px, py, pz))]
        both = F.get(ints(entity_codes()), (code[0] + 3 * code[1] + 9 * code[2]).cast("int"))
        return near.where(owned(F.col("firsts"), both)).select("i", F.get("nodes", ((pz * w + py) * w + px).cast("int")).alias("j"))
    near = near.select("i", F.get("nodes", ((pz * w + py) * w + px).cast("int")).alias("j"), *"xyz")
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & (F.col(c) > 0) & (F.col(c) < n)
    rows = near.select("i", "j", inside.alias("inside"))
    return rows.where("inside").select("i", "j").unionByName(rows.where("not inside").select("i", "j").distinct())


def upper_triangular(mesh: Mesh) -> DataFrame:
    """i, j with j > i; the filter stands before the distinct, so half of the pairs is shuffled."""

    def rows(elements: DataFrame, t: str) -> DataFrame:
        return elements.select("nodes", F.explode("nodes").alias("i")).select("i", F.explode("nodes").alias("j")).where("j > i")

    return by_type(mesh, rows).distinct()


def edges(mesh: Mesh) -> DataFrame:
    """i < j: geometric edges, each once."""

    def rows(elements: DataFrame, t: str) -> DataFrame:
        if linear(t) not in EDGES:
            raise ValueError(f"no edges known for {t}")
        at = corners(t)
        pairs = patterned(elements, tuple((at[a], at[b]) for a, b in EDGES[linear(t)]))
        return pairs.select(F.array_min("nodes").alias("i"), F.array_max("nodes").alias("j"))

    return by_type(mesh, rows).where("i < j").distinct()


def edges_both_ways(mesh: Mesh) -> DataFrame:
    """i, j and j, i for every geometric edge."""
    e = edges(mesh)
    return e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j")))


def sides(mesh: Mesh, corners_only: bool = False) -> DataFrame:
    """block_id, elem_id, lfi, nodes, key (sorted corner nodes): every side of every element."""

    def rows(elements: DataFrame, t: str) -> DataFrame:
        table = side_table(t)
        if element_type(t).semistructured or corners_only:
            at = corners(t)
            base = SIDES[linear(t)]
            keys = tuple(tuple(at[k] for k in s) for s in base)
        else:
            n = [len(s) for s in SIDES[linear(t)]] if linear(t) in SIDES else [len(s) for s in table]
            keys = tuple(s[:k] for s, k in zip(table, n))
        full = keys if corners_only else table
        both = F.array(*[F.struct(picked(F.col("nodes"), f).alias("nodes"), F.array_sort(picked(F.col("nodes"), k)).alias("key")) for f, k in zip(full, keys)])
        return elements.select("block_id", "elem_id", F.posexplode(both).alias("lfi", "s")).select("block_id", "elem_id", F.col("lfi").cast("short").alias("lfi"), "s.nodes", "s.key")

    return by_type(mesh, rows)


def dual(mesh: Mesh) -> DataFrame:
    """block1, e1, block2, e2: elements that share exactly as many corner nodes as a side has, in both blocks' types.

    Neighbours meet by a side's sorted corners, in one aggregation; the count is taken in the pair's row. Elements that share
    that many corners without sharing a side (degenerate meshes) are found by `dual_by_count` alone.
    """

    def rows(elements: DataFrame, t: str) -> DataFrame:
        base, at = SIDES[linear(t)], corners(t)
        n = len(base[0])
        keys = F.array(*[F.array_sort(picked(F.col("nodes"), tuple(at[k] for k in s))) for s in base if len(s) == n])
        own = F.struct("block_id", "elem_id", F.array_distinct(picked(F.col("nodes"), at)).alias("c")).alias("e")
        return elements.select(own, F.explode(keys).alias("key"))

    met = by_type(mesh, rows).groupBy("key").agg(F.collect_list("e").alias("m")).where(F.size("m") > 1)
    pairs = met.select(F.size("key").alias("size"), "m", F.explode("m").alias("a")).select("size", "a", F.explode("m").alias("b"))
    other = (F.col("a.block_id") != F.col("b.block_id")) | (F.col("a.elem_id") != F.col("b.elem_id"))
    found = pairs.where(other & (F.size(F.array_intersect("a.c", "b.c")) == F.col("size")))
    return found.select(F.col("a.block_id").alias("block1"), F.col("a.elem_id").alias("e1"), F.col("b.block_id").alias("block2"), F.col("b.elem_id").alias("e2")).distinct()


def sharing_two(incidence: DataFrame) -> DataFrame:
    """e1 < e2, shared: elements with two common nodes or more, and how many, from distinct (elem_id, node_id).

    They meet by pairs of nodes: k common nodes are k (k - 1) / 2 common pairs. An element has few nodes where a node may have
    many elements, and elements with one common node never meet.
    """
    v, w = (incidence.select(F.col("elem_id").alias("elem_id"), F.col("node_id").alias(c)) for c in "vw")
    pairs = v.join(w, "elem_id").where("v < w")
    met = pairs.withColumnRenamed("elem_id", "e1").hint("merge").join(pairs.withColumnRenamed("elem_id", "e2"), ["v", "w"]).where("e1 < e2")
    common = F.count("*")
    return met.groupBy("e1", "e2").agg(((1 + F.sqrt(1 + 8 * common)) / 2).cast("long").alias("shared"))


def dual_by_count(mesh: Mesh) -> DataFrame:
    """The same by counting shared corners of all pairs of elements around a node: for meshes whose elements may share corners
    that aren't a side's."""

    def rows(elements: DataFrame, t: str) -> DataFrame:
        n = len(SIDES[linear(t)][0])
        return elements.select("block_id", "elem_id", F.explode(F.array_distinct(picked(F.col("nodes"), corners(t)))).alias("node_id"), F.lit(n).alias("n"))

    a = by_type(mesh, rows)
    b = a.select(F.col("block_id").alias("block2"), F.col("elem_id").alias("e2"), "node_id", F.col("n").alias("n2"))
    pairs = a.select(F.col("block_id").alias("block1"), F.col("elem_id").alias("e1"), "node_id", "n").join(b, "node_id").where("block1 <> block2 or e1 <> e2")
    found = pairs.groupBy("block1", "e1", "block2", "e2", "n", "n2").agg(F.count("*").alias("shared"))
    return found.where("shared = n and shared = n2").select("block1", "e1", "block2", "e2")


def half_faces(mesh: Mesh) -> DataFrame:
    """block_id, elem_id, lfi, neigh_block, neigh: the element on the other side, null at the boundary.

    Sides meet by their sorted corners in one aggregation; of several candidates the lowest other element counts.
    """
    s = sides(mesh, corners_only=True).select("block_id", "elem_id", "lfi", "key")
    met = s.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block_id", "elem_id", "lfi"))).alias("m"))
    one = met.select("m", F.explode("m").alias("x"))
    other = F.get(F.filter("m", lambda y: (y["block_id"] != F.col("x.block_id")) | (y["elem_id"] != F.col("x.elem_id"))), F.lit(0))
    return one.select("x.block_id", "x.elem_id", "x.lfi", other["block_id"].alias("neigh_block"), other["elem_id"].alias("neigh"))


def block_to_scalar(graph: DataFrame, b: int, values: str | None = None) -> DataFrame:
    """Each entry of a block matrix as b * b scalars: row i * b + br, column j * b + bc; values: array, column-within
    (entry bc * b + br)."""
    at = F.array(*[F.struct(F.lit(r).alias("br"), F.lit(c).alias("bc")) for r in range(b) for c in range(b)])
    rows = graph.withColumn("at", F.explode(at))
    out = [(F.col("i") * b + F.col("at.br")).alias("i"), (F.col("j") * b + F.col("at.bc")).alias("j")]
    if values:
        out.append(F.get(values, F.col("at.bc") * b + F.col("at.br")).alias("value"))
    return rows.select(*out)


def row_pointers(graph: DataFrame, n: int) -> DataFrame:
    """row, start for row 0..n: exclusive running sums of row lengths.

    Sums within ranges of rows come first; only their totals, one for each of at most 1024 ranges, meet in one place.
    """
    from pyspark.sql import Window as W

    counts = graph.groupBy(F.col("i").alias("row")).agg(F.count("*").alias("c"))
    width = max(1, -(-(n + 1) // 1024))
    rows = graph.sparkSession.range(n + 1).withColumnRenamed("id", "row").join(counts, "row", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"), F.call_function("div", F.col("row"), F.lit(width)).alias("part"))
    totals = rows.groupBy("part").agg(F.sum("c").alias("t"))
    before = totals.select(F.col("part").alias("p"), (F.sum("t").over(W.orderBy("part")) - F.col("t")).alias("before"))
    inside = F.sum("c").over(W.partitionBy("part").orderBy("row")) - F.col("c")
    return rows.withColumn("inside", inside).join(F.broadcast(before), F.col("part") == F.col("p")).select("row", (F.col("before") + F.col("inside")).alias("start"))


def from_row_pointers(pointers: DataFrame, columns: DataFrame) -> DataFrame:
    """Row pointers (row, start) and columns (k, j) -> i, j. Lengths come from neighbouring pointers."""
    nxt = pointers.select((F.col("row") - 1).alias("row"), F.col("start").alias("stop"))
    spans = pointers.join(nxt, "row").where("stop > start")
    at = spans.select(F.col("row").alias("i"), F.explode(F.sequence("start", F.col("stop") - 1)).alias("k"))
    return at.join(columns, "k").select("i", "j")


def eccentricity(graph: DataFrame) -> DataFrame:
    """i, eccentricity: largest |j - i| of a row, 0 without others."""
    return graph.groupBy("i").agg(F.max(F.abs(F.col("j") - F.col("i"))).alias("eccentricity"))


def adjacency_matrix(graph: DataFrame, remove_diagonal: bool = True, laplacian: bool = False, normalize_rows: bool = False, remove_lower: bool = False, negate_lower: bool = False, directed: bool = False) -> DataFrame:
    """i, j, value from node-to-node pairs; zero entries stay stored.

    `directed` gives ones below the diagonal; `laplacian` ones with 1 - row sum on the diagonal; else ones, then in this
    order: zero diagonal, zero lower triangle, negated lower triangle, rows divided by their sums.
    """
    from pyspark.sql import Window as W

    i, j = F.col("i"), F.col("j")
    row = W.partitionBy("i")
    if directed:
        return graph.select("i", "j", F.when(j < i, 1.0).otherwise(0.0).alias("value"))
    if laplacian:
        return graph.select("i", "j", F.when(i == j, 1.0 - F.count("*").over(row)).otherwise(1.0).alias("value"))
    v = F.lit(1.0)
    if remove_diagonal:
        v = F.when(i == j, 0.0).otherwise(v)
    if remove_lower:
        v = F.when(j < i, 0.0).otherwise(v)
    if negate_lower:
        v = F.when(j < i, -v).otherwise(v)
    out = graph.select("i", "j", v.alias("value"))
    if normalize_rows:
        total = F.sum("value").over(row)
        out = out.select("i", "j", F.when(total != 0, F.col("value") / total).otherwise(F.col("value")).alias("value"))
    return out


def condensed_matrix(matrix: DataFrame, n: int, gone: DataFrame) -> DataFrame:
    """Drop the listed rows and columns (gone: id) and renumber what stays densely."""
    from .arrays import condensed_ids

    ids = condensed_ids(matrix.sparkSession, n, gone)
    r = ids.select(F.col("id").alias("i"), F.col("new_id").alias("ni"))
    c = ids.select(F.col("id").alias("j"), F.col("new_id").alias("nj"))
    return matrix.join(r, "i").join(c, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "value")


def incidence_counts(mesh: Mesh) -> DataFrame:
    """node_id, n: elements around each node."""
    return mesh.elements.select(F.explode("nodes").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))
