"""Transfer between nested levels: weights as a table, prolongation as a join, restriction as its transpose."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elem_types import EDGES, element_type, lattice_index, linear, proteus_quad
from ..mesh import Block, Mesh, unfolded
from . import graph, lattice


def p1_weights(mesh_p2: Mesh) -> DataFrame:
    """row (second-order node), col (corner), weight: one for corners, one half for both ends of mid-edges."""
    t = linear(mesh_p2.elem_type)
    n = element_type(t).n_nodes
    nodes = F.col("nodes")
    own = mesh_p2.elements.select(F.explode(F.slice(nodes, 1, n)).alias("row")).distinct().select("row", F.col("row").alias("col"), F.lit(1.0).alias("weight"))
    # Once for each mid-edge node with both ends, then its rows: half as many words in the distinct.
    mids = [F.struct(F.get(nodes, F.lit(n + m)).alias("row"), F.array_sort(F.array(F.get(nodes, F.lit(a)), F.get(nodes, F.lit(b)))).alias("ends")) for m, (a, b) in enumerate(EDGES[t])]
    rows = mesh_p2.elements.select(F.explode(F.array(*mids)).alias("s")).select("s.row", F.get("s.ends", F.lit(0)).alias("i"), F.get("s.ends", F.lit(1)).alias("j")).distinct()
    return own.unionByName(rows.select("row", F.explode(F.array_distinct(F.array("i", "j"))).alias("col"), F.lit(0.5).alias("weight")))


def tensor_weights(fine: int, coarse: int, dim: int) -> list[tuple[int, int, float]]:
    """(fine place, coarse place, weight) of tensor-product linear interpolation between nested lattices."""
    if fine % coarse:
        raise ValueError("levels have to be nested")
    step = fine // coarse

    def one(x: int) -> list[tuple[int, float]]:
        k = min(x // step, coarse - 1)
        t = (x - k * step) / step
        return [(k + d, w) for d, w in ((0, 1 - t), (1, t)) if w]

    out = []
    r = range(fine + 1)
    for z in r if dim == 3 else (0,):
        for y in r:
            for x in r:
                for cz, wz in one(z) if dim == 3 else [(0, 1.0)]:
                    for cy, wy in one(y):
                        for cx, wx in one(x):
                            out.append((lattice_index(fine, x, y, z), lattice_index(coarse, cx, cy, cz), wx * wy * wz))
    return out


def _weights(fine: Mesh, coarse: Mesh, local: list[tuple[int, int, float]]) -> DataFrame:
    """Local weights (a table of fixed size) spread inside the elements' rows, which meet whole; shared nodes get equal rows, kept
    once, and rows of nodes inside an element are not shuffled for that."""
    both = fine.elements.select("block_id", "elem_id", F.col("nodes").alias("f")).join(coarse.elements.select("block_id", "elem_id", F.col("nodes").alias("c")), ["block_id", "elem_id"])

    def spread(part: list[tuple[int, int, float]]) -> DataFrame:
        a, b, w = zip(*part)
        weights = F.split(F.lit(",".join(map(repr, map(float, w)))), ",").cast("array<double>")
        rows = both.select("f", "c", F.explode(F.arrays_zip(graph.ints(a).alias("a"), graph.ints(b).alias("b"), weights.alias("w"))).alias("s"))
        return rows.select(F.get("f", F.col("s.a")).alias("row"), F.get("c", F.col("s.b")).alias("col"), F.col("s.w").alias("weight"))

    own = inner_places(fine)
    shared = spread([x for x in local if x[0] not in own]).distinct()
    inside = [x for x in local if x[0] in own]
    return shared.unionByName(spread(inside)) if inside else shared


def inner_places(mesh: Mesh) -> set[int]:
    """Local places whose nodes no other element has: those inside a hexahedral lattice. Of quadrilaterals none, as both sides of
    an inner face may stand in a side set."""
    t = element_type(mesh.elem_type)
    r = range(1, t.level) if t.semistructured and t.dim == 3 else ()
    return {lattice_index(t.level, x, y, z) for z in r for y in r for x in r}


def level_weights(fine: Mesh, coarse: Mesh) -> DataFrame:
    """row, col, weight of the prolongation between two levels of one semistructured mesh."""
    f, c = element_type(fine.elem_type), element_type(coarse.elem_type)
    return _weights(fine, coarse, tensor_weights(f.level, c.level, f.dim))


def _summed(given: DataFrame, local: list[tuple[int, int, float]], n: int, m: int, to: int) -> DataFrame:
    """given (any columns and v, pairs of a place k < n and its value) with s for v: for each of m places the weighted sum of the
    values; null where none of them is there. A batch of elements is summed at once."""
    pairs = [(pair[1 - to], pair[to], pair[2]) for pair in local]
    rest = [c for c in given.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, k = b.num_rows, b.column("k")
            at = (k.flatten().to_numpy(), np.repeat(np.arange(rows), np.diff(k.offsets)))
            v, there = np.zeros((n, rows)), np.zeros((n, rows), bool)
            v[at] = b.column("value").flatten().to_numpy(zero_copy_only=False)
            there[at] = True
            s, some = np.zeros((m, rows)), np.zeros((m, rows), bool)
            for i, j, w in pairs:
                s[j] += w * v[i]
                some[j] |= there[i]
            flat = pa.array(np.ascontiguousarray(s.T).ravel(), mask=~np.ascontiguousarray(some.T).ravel())
            out = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * m, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), out], names=[*rest, "s"])

    schema = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in rest)
    return given.select(*rest, "v.k", "v.value").mapInArrow(run, f"{schema}, s array<double>")


def _by_element(long: DataFrame, field: DataFrame) -> DataFrame:
    """(block_id, elem_id, k, node) with a field on the nodes -> block_id, elem_id, comp, v (pairs of k and value)."""
    met = unfolded(long).join(field.select(F.col("id").alias("node"), "comp", "value"), "node").select("block_id", "elem_id", "comp", "k", "value")
    return met.groupBy("block_id", "elem_id", "comp").agg(F.collect_list(F.struct("k", "value")).alias("v"))


def prolongate_level(fine: Mesh, coarse: Mesh, field: DataFrame) -> DataFrame:
    """`prolongate` by `level_weights`, inside the elements' rows: each coarse value goes to its elements, each fine node comes from the
    first that has it. Only rows of values are shuffled, none of weights. For meshes that don't know which that is, by weights."""
    rows = fine.first_rows()
    if rows is None:
        return prolongate(level_weights(fine, coarse), field)
    f, c = element_type(fine.elem_type), element_type(coarse.elem_type)
    given = _by_element(coarse.elements.select("block_id", "elem_id", F.posexplode("nodes").alias("k", "node")), field)
    local = tensor_weights(f.level, c.level, f.dim)
    both = rows.select("block_id", "elem_id", "nodes", "firsts").join(unfolded(given), ["block_id", "elem_id"])
    both = _summed(both.select("nodes", "firsts", "comp", "v"), local, c.n_nodes, f.n_nodes, 0)
    entity = graph.ints(lattice.entity_of(f.level, f.dim))
    long = both.select("nodes", "firsts", "comp", F.posexplode("s").alias("k", "value"))
    return long.where(F.col("value").isNotNull() & lattice.owned(F.col("firsts"), F.get(entity, F.col("k")))).select(F.get("nodes", F.col("k")).alias("id"), "comp", "value")


def restrict_level(fine: Mesh, coarse: Mesh, field: DataFrame) -> DataFrame:
    """`restrict` by `level_weights`, inside the elements' rows: each fine value goes to the first element that has its node, and sums
    for the element's coarse nodes leave it. For meshes that don't know which that is, by weights."""
    rows = fine.first_rows()
    if rows is None:
        return restrict(level_weights(fine, coarse), field)
    f, c = element_type(fine.elem_type), element_type(coarse.elem_type)
    entity = graph.ints(lattice.entity_of(f.level, f.dim))
    long = rows.select("block_id", "elem_id", "firsts", F.posexplode("nodes").alias("k", "node")).where(lattice.owned(F.col("firsts"), F.get(entity, F.col("k"))))
    given = _by_element(long.select("block_id", "elem_id", "k", "node"), field)
    local = tensor_weights(f.level, c.level, f.dim)
    sums = _summed(given, local, f.n_nodes, c.n_nodes, 1)
    both = unfolded(sums).join(coarse.elements, ["block_id", "elem_id"]).select("comp", F.explode(F.arrays_zip("nodes", "s")).alias("x"))
    return both.where("x.s is not null").groupBy(F.col("x.nodes").alias("id"), "comp").agg(F.sum("x.s").alias("value"))


def prolongate(weights: DataFrame, field: DataFrame) -> DataFrame:
    """id, comp, value on the fine nodes."""
    return weights.join(field, F.col("col") == F.col("id")).groupBy(F.col("row").alias("id"), "comp").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def restrict(weights: DataFrame, field: DataFrame) -> DataFrame:
    """The transpose: id, comp, value on the coarse nodes. With weights that stand once for each pair of nodes, the
    division by a node's multiplicity and the sum over its elements cancel."""
    return weights.join(field, F.col("row") == F.col("id")).groupBy(F.col("col").alias("id"), "comp").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def multiplicity(mesh: Mesh) -> DataFrame:
    """node_id, n: elements around each lattice node."""
    return graph.incidence_counts(mesh)


def edge_map(mesh: Mesh, first: int) -> DataFrame:
    """i, j, node: mid-edge nodes in the order of the upper triangle."""
    from .convert import edge_numbers

    return edge_numbers(mesh, first)


def prolongate_edges(field: DataFrame, numbers: DataFrame) -> DataFrame:
    """Corner values copied, mid-edge values averaged from an edge map."""
    a = field.select(F.col("id").alias("i"), F.col("comp"), F.col("value").alias("va"))
    b = field.select(F.col("id").alias("j"), F.col("comp"), F.col("value").alias("vb"))
    mids = numbers.join(a, "i").join(b, ["j", "comp"]).select(F.col("node").alias("id"), "comp", ((F.col("va") + F.col("vb")) / 2).alias("value"))
    return field.unionByName(mids)


def restrict_edges(field: DataFrame, numbers: DataFrame, n_corners: int) -> DataFrame:
    """Each corner's own value, and half of every edge's to both ends."""
    own = field.where(F.col("id") < n_corners)
    mids = field.join(numbers, F.col("id") == F.col("node"))
    parts = mids.select(F.explode(F.array("i", "j")).alias("id"), "comp", (F.col("value") / 2).alias("value"))
    return own.select("id", "comp", "value").unionByName(parts).groupBy("id", "comp").agg(F.sum("value").alias("value"))


class Restrict:
    """A restriction kept as its weights, which apply() needs only where elements don't tell their first nodes; rows and columns of
    the operator, and apply()."""

    def __init__(self, fine: Mesh, coarse: Mesh):
        self.weights = level_weights(fine, coarse)
        self._sizes = (coarse, fine)

    def rows(self) -> int:
        return self._sizes[0].points.count()

    def cols(self) -> int:
        return self._sizes[1].points.count()

    def apply(self, field: DataFrame) -> DataFrame:
        return restrict_level(self._sizes[1], self._sizes[0], field)


class SurfaceRestrict(Restrict):
    """A restriction between the lattices of a side set; nodes keep the volume's ids."""

    def __init__(self, fine: Mesh, coarse: Mesh, sideset: DataFrame):
        f, c = side_lattices(fine, sideset), side_lattices(coarse, sideset)
        self.weights = level_weights(f, c)
        self._sizes = (c, f)


def side_lattices(mesh: Mesh, sideset: DataFrame) -> Mesh:
    """The sides of a semistructured mesh as quadrilateral lattices over the same points."""
    from .sets import sideset_sides

    t = element_type(mesh.elem_type)
    rows = sideset_sides(mesh, sideset).select(F.lit(0).alias("block_id"), (F.col("parent") * t.n_sides + F.col("lfi")).alias("elem_id"), "nodes")
    used = rows.select(F.explode("nodes").alias("node_id")).distinct()
    return Mesh(mesh.points.join(used, "node_id", "left_semi"), rows, (Block(0, "sides", proteus_quad(t.level, True)),), mesh.dim)


def prolongation_matrix(weights: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """The explicit matrix: row pointers (row, start) and entries (k, i, j, value) in the order of rows and columns."""
    from .numbering import dense_ids

    entries = weights.select(F.col("row").alias("i"), F.col("col").alias("j"), F.col("weight").alias("value"))
    return graph.row_pointers(entries, n_rows), dense_ids(entries, ["i", "j"], "k")


def apply_element_matrix(mesh: Mesh, matrix: list[list[float]], field: DataFrame) -> DataFrame:
    """id, comp, value: one 8 x 8 matrix applied in every micro cell of a semistructured mesh, summed over cells."""
    from .convert import micro_cells

    cells = graph.patterned(mesh.elements, micro_cells(mesh.elem_type)[1])
    spark: SparkSession = mesh.spark
    w = F.broadcast(spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(matrix) for c, v in enumerate(row)], "r int, c int, w double"))
    long = cells.select("nodes", F.posexplode("nodes").alias("c", "id")).join(field, "id").join(w, "c")
    return long.select(F.get("nodes", F.col("r")).alias("id"), "comp", (F.col("w") * F.col("value")).alias("value")).groupBy("id", "comp").agg(F.sum("value").alias("value"))
