"""Generated meshes and grids: pure functions of a cell index, so every row comes from spark.range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elem_types import LEVELS, element_type, proteus_hex
from ..mesh import Block, Mesh

Box = tuple[float, float, float, float, float, float]
UNIT: Box = (0.0, 0.0, 0.0, 1.0, 1.0, 1.0)
#: Corners of a cell in the order of a hexahedron's nodes.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
# A cell's faces as seen by the tetrahedra around its centre.
CELL_FACES = ((0, 1, 2, 3), (4, 7, 6, 5), (0, 4, 5, 1), (3, 2, 6, 7), (0, 3, 7, 4), (1, 5, 6, 2))


def _div(a: Column, b: int) -> Column:
    """Whole division: exact at any size, unlike a quotient of doubles."""
    return F.call_function("div", a, F.lit(b))


#: Cells (or points) of a partition, where that gives more partitions than the session's default: what a task holds of what its
#: cells unfold to doesn't grow with the mesh.
SLAB = 1 << 15


def _ids(spark: SparkSession, n: int, slabs: int | None) -> DataFrame:
    return spark.range(0, n, 1, slabs or max(spark.sparkContext.defaultParallelism, -(-n // SLAB)))


def _cells(spark: SparkSession, nx: int, ny: int, nz: int, slabs: int | None = None) -> DataFrame:
    if min(nx, ny, nz) < 1:
        raise ValueError("a mesh needs at least one cell along each axis")
    e = F.col("id")
    return _ids(spark, nx * ny * nz, slabs).select(e.alias("e"), (e % nx).alias("cx"), (_div(e, nx) % ny).alias("cy"), _div(e, nx * ny).alias("cz"))



def _lattice(spark: SparkSession, mx: int, my: int, mz: int, first: int = 0, slabs: int | None = None) -> DataFrame:
    """node_id and lattice place of mx * my * mz points, x fastest."""
    i = F.col("id")
    return _ids(spark, mx * my * mz, slabs).select((i + first).alias("node_id"), (i % mx).alias("ix"), (_div(i, mx) % my).alias("iy"), _div(i, mx * my).alias("iz"))


def _axis(place: Column, lo: float, hi: float, n: int) -> Column:
    """Double arithmetic, stored as float."""
    return (F.lit(float(lo)) + place * F.lit((float(hi) - float(lo)) / n)).cast("float")


def _box_points(spark: SparkSession, nx: int, ny: int, nz: int, box: Box, slabs: int | None = None) -> DataFrame:
    p = _lattice(spark, nx + 1, ny + 1, nz + 1, slabs=slabs)
    return p.select("node_id", _axis(F.col("ix"), box[0], box[3], nx).alias("x"), _axis(F.col("iy"), box[1], box[4], ny).alias("y"), _axis(F.col("iz"), box[2], box[5], nz).alias("z"))


def _vertex(nx: int, ny: int, at: tuple[int, int, int] = (0, 0, 0)) -> Column:
    return (F.col("cx") + at[0]) + (F.col("cy") + at[1]) * (nx + 1) + (F.col("cz") + at[2]) * ((nx + 1) * (ny + 1))


def _one(points: DataFrame, rows: DataFrame, elem_type: str, name: str = "default", dim: int = 3) -> Mesh:
    return Mesh(points, rows.select(F.lit(0).alias("block_id"), "elem_id", "nodes"), (Block(0, name, elem_type),), dim)


def hex8_reference_cube(spark: SparkSession) -> Mesh:
    return hex8_cube(spark, 1, 1, 1)


def hex8_cube(spark: SparkSession, nx: int, ny: int, nz: int, box: Box = UNIT, slabs: int | None = None) -> Mesh:
    """`slabs` sets the number of partitions, each a run of cells (or nodes) along z."""
    rows = _cells(spark, nx, ny, nz, slabs).select(F.col("e").alias("elem_id"), F.array(*[_vertex(nx, ny, c) for c in CORNERS]).alias("nodes"))
    return _one(_box_points(spark, nx, ny, nz, box, slabs), rows, "HEX8")


def tet4_cube(spark: SparkSession, nx: int, ny: int, nz: int, box: Box = UNIT) -> Mesh:
    """Twelve tetrahedra a cell, around a node in its centre."""
    n_vertices = (nx + 1) * (ny + 1) * (nz + 1)
    v = [_vertex(nx, ny, c) for c in CORNERS]
    centre = F.col("e") + n_vertices
    tets = [F.array(v[f[0]], v[f[a]], v[f[a + 1]], centre) for f in CELL_FACES for a in (1, 2)]
    rows = _cells(spark, nx, ny, nz).select("e", F.posexplode(F.array(*tets)).alias("s", "nodes")).select((F.col("e") * 12 + F.col("s")).alias("elem_id"), "nodes")
    c = _cells(spark, nx, ny, nz)
    mid = c.select((F.col("e") + n_vertices).alias("node_id"), _axis(F.col("cx") + 0.5, box[0], box[3], nx).alias("x"), _axis(F.col("cy") + 0.5, box[1], box[4], ny).alias("y"), _axis(F.col("cz") + 0.5, box[2], box[5], nz).alias("z"))
    return _one(_box_points(spark, nx, ny, nz, box).unionByName(mid), rows, "TET4")


def _square(spark: SparkSession, nx: int, ny: int, box: tuple[float, float, float, float]) -> DataFrame:
    p = _lattice(spark, nx + 1, ny + 1, 1)
    return p.select("node_id", _axis(F.col("ix"), box[0], box[2], nx).alias("x"), _axis(F.col("iy"), box[1], box[3], ny).alias("y"), F.lit(None).cast("float").alias("z"))


def tri3_square(spark: SparkSession, nx: int, ny: int, box: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> Mesh:
    v = [_vertex(nx, ny, c) for c in CORNERS[:4]]
    tris = F.array(F.array(v[0], v[1], v[3]), F.array(v[1], v[2], v[3]))
    rows = _cells(spark, nx, ny, 1).select("e", F.posexplode(tris).alias("s", "nodes")).select((F.col("e") * 2 + F.col("s")).alias("elem_id"), "nodes")
    return _one(_square(spark, nx, ny, box), rows, "TRI3", dim=2)


def quad4_square(spark: SparkSession, nx: int, ny: int, box: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> Mesh:
    rows = _cells(spark, nx, ny, 1).select(F.col("e").alias("elem_id"), F.array(*[_vertex(nx, ny, c) for c in CORNERS[:4]]).alias("nodes"))
    return _one(_square(spark, nx, ny, box), rows, "QUAD4", dim=2)


def square(spark: SparkSession, elem_type: str, nx: int, ny: int, box: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)) -> Mesh:
    makers = {"QUAD4": quad4_square, "TRI3": tri3_square}
    if elem_type not in makers:
        raise ValueError(f"no square of {elem_type}")
    return makers[elem_type](spark, nx, ny, box)


def quad4_ring(spark: SparkSession, inner: float, outer: float, layers: int, n: int) -> Mesh:
    """A ring of n cells around and `layers` outward."""
    angle = F.lit(2 * math.pi / n) * F.col("ix")
    radius = F.lit(float(inner)) + F.lit((outer - inner) / layers) * F.col("iy")
    points = _lattice(spark, n, layers + 1, 1).select("node_id", (F.cos(angle) * radius).cast("float").alias("x"), (F.sin(angle) * radius).cast("float").alias("y"), F.lit(None).cast("float").alias("z"))
    base, here = F.col("cy") * n, F.col("cx")
    nxt = (here + 1) % n
    rows = _cells(spark, n, layers, 1).select(F.col("e").alias("elem_id"), F.array(base + nxt, base + here, base + here + n, base + nxt + n).alias("nodes"))
    return _one(points, rows, "QUAD4", dim=2)


def _ball(x: Column, y: Column, z: Column, radius: float) -> list[Column]:
    """The cube [-1, 1]^2 x [0, 1] mapped onto the half ball: shells of the cube become spheres."""
    m = F.greatest(F.abs(x), F.abs(y), z)
    q = [x / m, y / m, z / m]
    sq = [c * c for c in q]

    def one(k: int) -> Column:
        a, b = (sq[i] for i in range(3) if i != k)
        out = F.lit(float(radius)) * m * q[k] * F.sqrt(F.lit(1.0) - (a + b) * 0.5 + a * b / 3.0)
        return F.when(m > 0, out).otherwise(0.0).cast("float")

    return [one(k).alias(n) for k, n in enumerate("xyz")]


def hex8_half_sphere(spark: SparkSession, radius: float, nx: int, ny: int, nz: int) -> Mesh:
    flat = hex8_cube(spark, nx, ny, nz)
    p = _lattice(spark, nx + 1, ny + 1, nz + 1)
    at = (F.col("ix") * 2.0 / nx - 1.0, F.col("iy") * 2.0 / ny - 1.0, F.col("iz") * 1.0 / nz)
    return _one(p.select("node_id", *_ball(*at, radius)), flat.elements, "HEX8")


def tet4_half_sphere(spark: SparkSession, radius: float, nx: int, ny: int, nz: int) -> Mesh:
    """24 tetrahedra a cell: each face's edges with the face's and the cell's centre."""
    counts = [(nx + 1) * (ny + 1) * (nz + 1), (nx + 1) * ny * nz, nx * (ny + 1) * nz, nx * ny * (nz + 1)]
    first = [sum(counts[:k]) for k in range(5)]
    shapes = [((nx + 1, ny + 1, nz + 1), (0, 0, 0)), ((nx + 1, ny, nz), (0, 0.5, 0.5)), ((nx, ny + 1, nz), (0.5, 0, 0.5)), ((nx, ny, nz + 1), (0.5, 0.5, 0)), ((nx, ny, nz), (0.5, 0.5, 0.5))]
    points = None
    for start, (shape, shift) in zip(first, shapes):
        p = _lattice(spark, *shape, first=start)
        at = ((F.col("ix") + shift[0]) * 2.0 / nx - 1.0, (F.col("iy") + shift[1]) * 2.0 / ny - 1.0, (F.col("iz") + shift[2]) * 1.0 / nz)
        p = p.select("node_id", *_ball(*at, radius))
        points = p if points is None else points.unionByName(p)
    v = [_vertex(nx, ny, c) for c in CORNERS]
    cx, cy, cz = F.col("cx"), F.col("cy"), F.col("cz")
    fx = lambda d: (cx + d) + cy * (nx + 1) + cz * ((nx + 1) * ny) + first[1]
    fy = lambda d: cx + (cy + d) * nx + cz * (nx * (ny + 1)) + first[2]
    fz = lambda d: cx + cy * nx + (cz + d) * (nx * ny) + first[3]
    centres = (fz(0), fz(1), fy(0), fy(1), fx(0), fx(1))
    cell = F.col("e") + first[4]
    tets = [F.array(v[f[k]], v[f[(k + 1) % 4]], c, cell) for f, c in zip(CELL_FACES, centres) for k in range(4)]
    rows = _cells(spark, nx, ny, nz).select("e", F.posexplode(F.array(*tets)).alias("s", "nodes")).select((F.col("e") * 24 + F.col("s")).alias("elem_id"), "nodes")
    return _one(points, rows, "TET4")


def half_sphere(spark: SparkSession, elem_type: str, radius: float, nx: int, ny: int, nz: int) -> Mesh:
    makers = {"HEX8": hex8_half_sphere, "TET4": tet4_half_sphere}
    if elem_type not in makers:
        raise ValueError(f"no half sphere of {elem_type}")
    return makers[elem_type](spark, radius, nx, ny, nz)


def hex8_bidomain_cube(spark: SparkSession, nx: int, ny: int, nz: int, axis: int, split: int, box: Box = UNIT) -> Mesh:
    """Two blocks, below and from the cell `split` along an axis; each block's ids in scan order."""
    m = hex8_cube(spark, nx, ny, nz, box)
    n = (nx, ny, nz)
    if not 0 < split < n[axis]:
        raise ValueError("the split has to leave cells on both sides")
    cells = _cells(spark, nx, ny, nz).withColumn("nodes", F.array(*[_vertex(nx, ny, c) for c in CORNERS]))
    c = [F.col("cx"), F.col("cy"), F.col("cz")]
    low = c[axis] < split
    # A block is a smaller box; its scan order is that box's own cell index.
    width = [F.lit(x) for x in n]
    at = list(c)
    width[axis] = F.when(low, split).otherwise(n[axis] - split)
    at[axis] = F.when(low, c[axis]).otherwise(c[axis] - split)
    own = at[0] + width[0] * (at[1] + width[1] * at[2])
    rows = cells.select(F.when(low, 0).otherwise(1).alias("block_id"), own.alias("elem_id"), "nodes")
    return Mesh(m.points, rows, (Block(0, "block_0", "HEX8"), Block(1, "block_1", "HEX8")))


def hex8_checkerboard_cube(spark: SparkSession, nx: int, ny: int, nz: int, box: Box = UNIT) -> Mesh:
    """Blocks `white` and `black` by the parity of a cell; even numbers of cells only."""
    if nx % 2 or ny % 2 or nz % 2:
        raise ValueError("a checkerboard needs even numbers of cells")
    m = hex8_cube(spark, nx, ny, nz, box)
    odd = (F.col("cx") + F.col("cy") + F.col("cz")) % 2
    # Every pair of neighbours along x has one cell of each colour.
    rows = _cells(spark, nx, ny, nz).select(odd.cast("int").alias("block_id"), _div(F.col("e"), 2).alias("elem_id"), F.array(*[_vertex(nx, ny, c) for c in CORNERS]).alias("nodes"))
    return Mesh(m.points, rows, (Block(0, "white", "HEX8"), Block(1, "black", "HEX8")))


def semistructured_hex_cube(spark: SparkSession, level: int, nx: int, ny: int, nz: int, box: Box = UNIT, hierarchical: bool = True) -> Mesh:
    """Macro hexahedra whose nodes are lattices of (level + 1)^3; nodes of coarser levels first where hierarchical."""
    from ..operators import lattice

    if level not in LEVELS:
        raise ValueError(f"no element type of level {level}")
    sx, sy = nx * level + 1, ny * level + 1
    at = [(x, y, z) for z in range(level + 1) for y in range(level + 1) for x in range(level + 1)]
    node = lambda x, y, z: (F.col("cx") * level + x) + (F.col("cy") * level + y) * sx + (F.col("cz") * level + z) * (sx * sy)
    steps = F.array(*[F.lit(x + y * sx + z * sx * sy).cast("long") for x, y, z in at])
    rows = _cells(spark, nx, ny, nz).select(F.col("e").alias("elem_id"), F.transform(steps, lambda d: d + node(0, 0, 0)).alias("nodes"))
    m = _one(_box_points(spark, nx * level, ny * level, nz * level, box), rows, proteus_hex(level))
    return lattice.hierarchical_renumbering(m) if hierarchical and level > 1 else m


# Lattice place of each node of the 27-node hexahedron.
HEX27_LATTICE = (0, 2, 8, 6, 18, 20, 26, 24, 1, 5, 7, 3, 19, 23, 25, 21, 9, 11, 17, 15, 10, 14, 16, 12, 4, 22, 13)


def cube(spark: SparkSession, elem_type: str, nx: int, ny: int, nz: int, box: Box = UNIT) -> Mesh:
    t = element_type(elem_type)
    if elem_type == "HEX8":
        return hex8_cube(spark, nx, ny, nz, box)
    if elem_type == "TET4":
        return tet4_cube(spark, nx, ny, nz, box)
    if elem_type == "TET10":
        from ..operators.convert import promote_to

        return promote_to(tet4_cube(spark, nx, ny, nz, box), "TET10")
    if elem_type == "HEX27":
        m = semistructured_hex_cube(spark, 2, nx, ny, nz, box)
        nodes = F.array(*[F.get("nodes", F.lit(k)) for k in HEX27_LATTICE])
        return Mesh(m.points, m.elements.withColumn("nodes", nodes), (Block(0, "default", "HEX27"),))
    if t.semistructured and t.dim == 3:
        return semistructured_hex_cube(spark, t.level, nx, ny, nz, box)
    raise ValueError(f"no cube of {elem_type}")


def wall_mounted_hump(spark: SparkSession, elem_type: str, nx: int, ny: int, nz: int, length: float, height: float, width: float, start: float, hump_length: float, hump_height: float) -> Mesh:
    """A channel whose floor has a squared-sine hump; points slide up by what the floor takes."""
    if min(length, height, width, hump_length) <= 0 or hump_height < 0:
        raise ValueError("the channel and its hump need positive sizes")
    m = cube(spark, elem_type, nx, ny, nz, (0.0, 0.0, 0.0, length, height, width))
    s = (F.col("x") - start) / hump_length
    wave = F.sin(F.lit(math.pi) * s)
    floor = F.when((F.col("x") >= start) & (F.col("x") <= start + hump_length), F.lit(float(hump_height)) * wave * wave).otherwise(0.0)
    points = m.points.withColumn("y", (floor + F.col("y") / height * (F.lit(float(height)) - floor)).cast("float"))
    return Mesh(points, m.elements, (Block(0, "fluid", m.elem_type),), m.dim)


def regular_grid(spark: SparkSession, n: tuple[int, int, int], box: Box = UNIT) -> DataFrame:
    """ix, iy, iz, x, y, z of a lattice of n points an axis; delta is the extent over n - 1."""
    p = _lattice(spark, *n)
    at = [(F.lit(float(box[d])) + F.col(f"i{c}") * ((box[d + 3] - box[d]) / max(1, n[d] - 1))).alias(c) for d, c in enumerate("xyz")]
    return p.select("ix", "iy", "iz", *at)


def grid_field(grid: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Evaluate a function of x, y and z on a lattice."""
    return grid.select("ix", "iy", "iz", F.lit(0).alias("comp"), value.cast("float").alias(name))


def mesh_of_labels(labels: DataFrame, nx: int, ny: int, wanted: int) -> Mesh:
    """Voxels (ix, iy, iz, label) that carry a label, as hexahedra; nodes numbered by first touch.

    Points are voxel corners in lattice units.
    """
    from ..operators.numbering import dense_ids, first_touch, renumbered

    cx = labels.where(F.col("label") == wanted).select(F.col("ix").cast("long").alias("cx"), F.col("iy").cast("long").alias("cy"), F.col("iz").cast("long").alias("cz"))
    rows = cx.withColumn("nodes", F.array(*[_vertex(nx, ny, c) for c in CORNERS]))
    rows = dense_ids(rows, ["cz", "cy", "cx"], "elem_id").select(F.lit(0).alias("block_id"), "elem_id", "nodes")
    touched = first_touch(rows.select("block_id", "elem_id", F.posexplode("nodes").alias("lnode", "node_id")))
    i, w, h = F.col("node_id"), nx + 1, ny + 1
    points = touched.select(F.col("new_id").alias("node_id"), (i % w).cast("float").alias("x"), (_div(i, w) % h).cast("float").alias("y"), _div(i, w * h).cast("float").alias("z"))
    return Mesh(points, renumbered(rows, touched), (Block(0, "default", "HEX8"),))


