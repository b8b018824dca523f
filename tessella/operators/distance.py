"""Exact distances from points to a surface, with sign, over a hierarchy of boxes.

The surface's triangles are numbered along a curve through their centres; every LEAF of them in a row are a leaf, every FAN
leaves or nodes in a row a node above, so parents are a shift away and no cell is ever too full. A node has the tight box of
its triangles and one of their corners. Points go down level by level: a node's box bounds the distance from below, its
corner from above, and only nodes that may still hold the nearest triangle are entered (an equality join on the parent,
broadcast for levels of bounded size). At the leaves the exact distance to the triangles is taken and the smallest kept,
map-side first. What is compared is what may be nearest: no table of all pairs is made.

The sign is that of the offset along the pseudo-normal at the closest point: the triangle's normal inside it, the sum of both
neighbours' on an edge, the sum weighted by angles at a corner. On a closed surface whose sides share their nodes and
look outward it is exact, negative inside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.elem_types import corners
from ..mesh import Mesh
from ..storage import materialize
from . import graph
from .numbering import dense_ids
from .order import curve_keys

LEAF_BITS, FAN_BITS = 4, 3
#: Nodes of a level that are broadcast: at about 100 bytes each, 20 MB.
BROADCAST_NODES = 200_000
_A, _B, _C = [[f"{v}{c}" for c in "xyz"] for v in "abc"]

Vector = list[Column]


def _cols(names: list[str]) -> Vector:
    return [F.col(n) for n in names]


def _minus(a: Vector, b: Vector) -> Vector:
    return [x - y for x, y in zip(a, b)]


def _dot(a: Vector, b: Vector) -> Column:
    return reduce(lambda s, t: s + t, [x * y for x, y in zip(a, b)])


def _cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _finite(c: str) -> Column:
    return F.coalesce(F.abs(F.coalesce(F.col(c), F.lit(0.0))) < float("inf"), F.lit(False))


def _placed(points: DataFrame) -> DataFrame:
    """Points with finite coordinates, as doubles; a missing axis is 0."""
    return points.where(_finite("x") & _finite("y") & _finite("z")).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in "xyz"})


def surface_triangles(surface: Mesh) -> DataFrame:
    """block_id, elem_id, sub, v0, v1, v2 and ax ... cz: the triangles of a surface; quadrilaterals are cut from their first corner."""

    def cut(elements: DataFrame, t: str) -> DataFrame:
        at = corners(t)
        if len(at) not in (3, 4):
            raise ValueError(f"{t} is no surface element")
        return graph.patterned(elements, tuple((at[0], at[k], at[k + 1]) for k in range(1, len(at) - 1)))

    rows = graph.by_type(surface, cut).select("block_id", "elem_id", "sub", F.posexplode("nodes").alias("k", "node_id"))
    long = rows.join(_placed(surface.points.select("node_id", "x", "y", "z")), "node_id")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    cols = [at(k, "node_id").alias(f"v{k}") for k in range(3)] + [at(k, c).alias(f"{v}{c}") for k, v in enumerate("abc") for c in "xyz"]
    return long.groupBy("block_id", "elem_id", "sub").agg(*cols, F.count("*").alias("n")).where("n = 3").drop("n")


def _numbered(triangles: DataFrame) -> DataFrame:
    """The triangles with pos, their place along the curve, and the unit normal (0 for one without area)."""
    n = _cross(_minus(_cols(_B), _cols(_A)), _minus(_cols(_C), _cols(_A)))
    raw = triangles.withColumns({f"m{c}": x for c, x in zip("xyz", n)})
    size = F.sqrt(_dot(_cols(["mx", "my", "mz"]), _cols(["mx", "my", "mz"])))
    rows = raw.withColumn("size", size).withColumns({f"n{c}": F.when(F.col("size") > 0, F.col(f"m{c}") / F.col("size")).otherwise(0.0) for c in "xyz"}).drop("mx", "my", "mz", "size")
    centred = rows.withColumns({c: (F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3 for c in "xyz"})
    keyed = curve_keys(centred, "hilbert3", ids=tuple(rows.columns))
    return materialize(dense_ids(keyed, ["key", "block_id", "elem_id", "sub"], "pos").drop("key"))


def _with_pseudo_normals(t: DataFrame) -> DataFrame:
    """px, py, pz: arrays of the pseudo-normals at the three corners, on the three edges (0-1, 1-2, 2-0) and inside."""
    own = _cols(["nx", "ny", "nz"])
    at = [_cols(_A), _cols(_B), _cols(_C)]
    features = []
    for k in range(3):
        u, v = _minus(at[(k + 1) % 3], at[k]), _minus(at[(k + 2) % 3], at[k])
        angle = F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(_dot(u, v), F.sqrt(_dot(u, u) * _dot(v, v)))))), F.lit(0.0))
        features.append((k, F.col(f"v{k}"), F.col(f"v{k}"), angle))
    for k in range(3):
        i, j = F.col(f"v{k}"), F.col(f"v{(k + 1) % 3}")
        features.append((3 + k, F.least(i, j), F.greatest(i, j), F.lit(1.0)))
    rows = F.array(*[F.struct(F.lit(s).alias("slot"), lo.alias("lo"), hi.alias("hi"), *[(w * x).alias(f"w{c}") for c, x in zip("xyz", own)]) for s, lo, hi, w in features])
    long = t.select("pos", F.explode(rows).alias("f")).select("pos", "f.*")
    shared = W.partitionBy("lo", "hi")
    long = long.select("pos", "slot", *[F.sum(f"w{c}").over(shared).alias(c) for c in "xyz"])
    by = long.groupBy("pos").agg(*[F.max(F.when(F.col("slot") == s, F.col(c))).alias(f"{c}{s}") for c in "xyz" for s in range(6)])
    out = t.join(by, "pos")
    return out.withColumns({f"p{c}": F.array(*[F.col(f"{c}{s}") for s in range(6)], F.col(f"n{c}")) for c in "xyz"}).drop(*[f"{c}{s}" for c in "xyz" for s in range(6)])


def _leaf_boxes(t: DataFrame) -> DataFrame:
    low = [F.min(F.least(*[F.col(f"{v}{c}") for v in "abc"])).alias(f"lo{c}") for c in "xyz"]
    high = [F.max(F.greatest(*[F.col(f"{v}{c}") for v in "abc"])).alias(f"hi{c}") for c in "xyz"]
    return materialize(t.groupBy(F.shiftright("pos", LEAF_BITS).alias("node")).agg(*low, *high, F.min(F.struct(*_A)).alias("some")))


def _level(boxes: DataFrame, up: int) -> DataFrame:
    if not up:
        return boxes
    return boxes.groupBy(F.shiftright("node", FAN_BITS * up).alias("node")).agg(*[F.min(f"lo{c}").alias(f"lo{c}") for c in "xyz"], *[F.max(f"hi{c}").alias(f"hi{c}") for c in "xyz"], F.min("some").alias("some"))


def _candidates(points: DataFrame, boxes: DataFrame, leaves: int) -> DataFrame:
    """pid, x, y, z, node: the leaves that may hold a point's nearest triangle."""
    depth = 0
    while leaves - 1 >> FAN_BITS * depth:
        depth += 1
    at = points.withColumns({"node": F.lit(0).cast("long"), "best": F.lit(float("inf"))})
    for up in range(depth, -1, -1):
        level = _level(boxes, up).withColumn("parent", F.shiftright("node", FAN_BITS) if up < depth else F.lit(0).cast("long"))
        if (leaves >> FAN_BITS * up) <= BROADCAST_NODES:
            level = F.broadcast(level)
        beyond = [F.greatest(F.col(f"lo{c}") - F.col(c), F.col(c) - F.col(f"hi{c}"), F.lit(0.0)) for c in "xyz"]
        some = _minus(_cols(list("xyz")), [F.col(f"some.{n}") for n in _A])
        met = at.withColumnRenamed("node", "parent").join(level, "parent").select("pid", "x", "y", "z", "node", "best", _dot(beyond, beyond).alias("least"), _dot(some, some).alias("most"))
        best = F.least("best", F.min("most").over(W.partitionBy("pid")))
        # What rounding may have taken from either bound is given back.
        at = met.withColumn("best", best).where(F.col("least") <= F.col("best") * (1 + 1e-12)).select("pid", "x", "y", "z", "node", "best")
    return at.drop("best")


def _closest() -> Column:
    """struct<d2, slot, along> of a point (x, y, z) and a triangle: the squared distance, where the closest point lies (0-2 a
    corner, 3-5 an edge, 6 inside) and the offset along the pseudo-normal there."""
    p, a, b, c, n = _cols(list("xyz")), _cols(_A), _cols(_B), _cols(_C), _cols(["nx", "ny", "nz"])
    along = lambda r, slot: _dot(r, [F.get(f"p{x}", slot) for x in "xyz"])
    found = []
    for k, (s, e) in enumerate(((a, b), (b, c), (c, a))):
        edge = _minus(e, s)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(_dot(_minus(p, s), edge), _dot(edge, edge)), F.lit(0.0))))
        slot = F.when(t <= 0, k).when(t >= 1, (k + 1) % 3).otherwise(3 + k)
        # At the end of an edge the offset is taken from the corner itself, so that all its triangles agree on the distance.
        r = [F.when(t >= 1, x - g).otherwise(x - (o + t * d)) for x, o, d, g in zip(p, s, edge, e)]
        found.append(F.struct(_dot(r, r).alias("d2"), slot.alias("slot"), along(r, slot).alias("along")))
    ab, ac, ap = _minus(b, a), _minus(c, a), _minus(p, a)
    d00, d01, d11, d20, d21 = _dot(ab, ab), _dot(ab, ac), _dot(ac, ac), _dot(ap, ab), _dot(ap, ac)
    den, v, w = d00 * d11 - d01 * d01, d11 * d20 - d01 * d21, d00 * d21 - d01 * d20
    off = _dot(ap, n)
    inside = (_dot(n, n) > 0) & (den > 0) & (v >= 0) & (w >= 0) & (v + w <= den)
    face = F.when(inside, F.struct((off * off).alias("d2"), F.lit(6).alias("slot"), off.alias("along")))
    return F.array_min(F.array(*found, face))


def _nearest(points: DataFrame, t: DataFrame, triangles: int) -> DataFrame:
    """points: pid, x, y, z -> pid, d2, along, block_id, elem_id of the nearest triangle, of equally near ones the first."""
    leaves = -(-triangles // (1 << LEAF_BITS))
    near = _candidates(points, _leaf_boxes(t), leaves)
    met = near.join(t.withColumn("node", F.shiftright("pos", LEAF_BITS)), "node").withColumn("c", _closest())
    best = met.groupBy("pid").agg(F.min(F.struct("c.d2", "block_id", "elem_id", "sub", "c.along")).alias("b"))
    return best.select("pid", "b.d2", "b.along", "b.block_id", "b.elem_id")


def distance_to_surface(points: DataFrame, surface: Mesh) -> DataFrame:
    """node_id, distance, block_id, elem_id of every point (node_id, x, y, z): the signed distance to the nearest triangle,
    negative inside, and the element it belongs to; null for a point without finite coordinates and for an empty surface.

    Points that repeat an identifier are measured each."""
    given = materialize(points.select("node_id", "x", "y", "z").withColumn("pid", F.monotonically_increasing_id()))
    t = _numbered(surface_triangles(surface))
    n = t.count()
    none = {"distance": F.lit(None).cast("double"), "block_id": F.lit(None).cast("int"), "elem_id": F.lit(None).cast("long")}
    if not n:
        return given.select("node_id").withColumns(none)
    found = _nearest(_placed(given).select("pid", "x", "y", "z"), materialize(_with_pseudo_normals(t)), n)
    signed = found.select("pid", (F.when(F.col("along") < 0, -1.0).otherwise(1.0) * F.sqrt("d2")).alias("distance"), "block_id", "elem_id")
    return given.join(signed, "pid", "left").select("node_id", "distance", "block_id", "elem_id")


def distance_to_points(points: DataFrame, others: DataFrame) -> DataFrame:
    """node_id, distance of every point to the nearest of some others (x, y, z): each is a triangle of one point."""
    given = materialize(points.select("node_id", "x", "y", "z").withColumn("pid", F.monotonically_increasing_id()))
    single = _placed(others.select("node_id", "x", "y", "z"))
    rows = single.select(F.lit(0).alias("block_id"), F.col("node_id").alias("elem_id"), F.lit(0).alias("sub"), *[F.col("node_id").alias(f"v{k}") for k in range(3)], *[F.col(c).alias(f"{v}{c}") for v in "abc" for c in "xyz"])
    t = _numbered(rows)
    n = t.count()
    if not n:
        return given.select("node_id", F.lit(None).cast("double").alias("distance"))
    flat = t.withColumns({f"p{c}": F.array(*[F.lit(0.0)] * 7) for c in "xyz"})
    found = _nearest(_placed(given).select("pid", "x", "y", "z"), flat, n)
    return given.join(found, "pid", "left").select("node_id", F.sqrt("d2").alias("distance"))
