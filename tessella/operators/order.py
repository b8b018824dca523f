"""Element and node orderings: space-filling curves, tags, bandwidth."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..storage import materialize
from .numbering import dense_ids
from .sets import centroids, renumber_nodes

BITS = 10
TOP = (1 << BITS) - 1


def quantized(v: Column, lo: Column, hi: Column) -> Column:
    """0..1023 by clamped share of the range, halves rounded up; 0 where the range is empty."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))
    return F.when(hi > lo, F.round(share * TOP)).otherwise(0).cast("long")


def _spread(v: Column) -> Column:
    """Bits of a 10-bit number two apart."""
    out = F.lit(0).cast("long")
    for b in range(BITS):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1)), 3 * b))
    return out


def morton(x: Column, y: Column, z: Column) -> Column:
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def cartesian(fast: Column, mid: Column, slow: Column) -> Column:
    return fast + (mid + slow * (TOP + 1)) * (TOP + 1)


def hilbert(x: Column, y: Column, z: Column) -> Column:
    """Skilling's transform as folds over the bit masks, so the expression stays small."""
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(BITS - 1, 0, -1)])
    zero = F.struct(x.alias("a"), y.alias("b"), z.alias("c"))
    on = lambda v, q: v.bitwiseAND(q) != 0

    def undo(s: Column, q: Column) -> Column:
        p = q - 1
        a, b, c = s["a"], s["b"], s["c"]
        a1 = F.when(on(a, q), a.bitwiseXOR(p)).otherwise(a)
        return F.struct(a1.alias("a"), b.alias("b"), c.alias("c"))

    def undo_other(name: str):
        def step(s: Column, q: Column) -> Column:
            p = q - 1
            t = s["a"].bitwiseXOR(s[name]).bitwiseAND(p)
            a = F.when(on(s[name], q), s["a"].bitwiseXOR(p)).otherwise(s["a"].bitwiseXOR(t))
            v = F.when(on(s[name], q), s[name]).otherwise(s[name].bitwiseXOR(t))
            return F.struct(a.alias("a"), (v if name == "b" else s["b"]).alias("b"), (v if name == "c" else s["c"]).alias("c"))

        return step

    # Each mask touches the axes in turn; as one fold over (mask, axis) every step reads the step before it.
    steps = F.flatten(F.transform(masks, lambda q: F.array(*[F.struct(q.alias("q"), F.lit(k).alias("k")) for k in range(3)])))
    b_, c_ = undo_other("b"), undo_other("c")
    folded = F.aggregate(steps, zero, lambda s, m: F.when(m["k"] == 0, undo(s, m["q"])).when(m["k"] == 1, b_(s, m["q"])).otherwise(c_(s, m["q"])))
    gray = F.transform(F.array(folded), lambda s: F.struct(s["a"].alias("a"), s["a"].bitwiseXOR(s["b"]).alias("b"), s["a"].bitwiseXOR(s["b"]).bitwiseXOR(s["c"]).alias("c")))

    def index(s: Column) -> Column:
        t = F.aggregate(masks, F.lit(0).cast("long"), lambda acc, q: F.when(on(s["c"], q), acc.bitwiseXOR(q - 1)).otherwise(acc))
        words = F.transform(F.array(t), lambda t: F.struct(s["a"].bitwiseXOR(t).alias("a"), s["b"].bitwiseXOR(t).alias("b"), s["c"].bitwiseXOR(t).alias("c")))
        bit = lambda v, b: F.shiftright(v, 1).bitwiseAND(F.lit(1)) if b is None else F.call_function("shiftright", v, b).bitwiseAND(F.lit(1))
        down = F.array(*map(F.lit, range(BITS - 1, -1, -1)))
        return F.get(F.transform(words, lambda w: F.aggregate(down, F.lit(0).cast("long"), lambda acc, b: acc * 8 + bit(w["a"], b) * 4 + bit(w["b"], b) * 2 + bit(w["c"], b))), F.lit(0))

    return F.get(F.transform(gray, index), F.lit(0))


def curve_keys(points: DataFrame, kind: str, axes: str = "xyz", seed: int = 0, ids: tuple[str, ...] = ("block_id", "elem_id")) -> DataFrame:
    """ids, key of points by Morton, Hilbert, Cartesian (fastest axis first) or random order."""
    if kind == "random3":  # a hash of the id: the same in every run
        return points.select(*ids, F.xxhash64(*ids, F.lit(seed)).alias("key"))
    box = points.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    q = points.crossJoin(F.broadcast(box))  # one row
    at = {c: quantized(F.coalesce(F.col(c), F.lit(0.0)), F.coalesce(F.col(f"lo{c}"), F.lit(0.0)), F.coalesce(F.col(f"hi{c}"), F.lit(0.0))) for c in "xyz"}
    q = q.select(*ids, *[at[c].alias(f"q{c}") for c in "xyz"])
    make = {"morton3": lambda: morton(F.col("qx"), F.col("qy"), F.col("qz")), "hilbert3": lambda: hilbert(F.col("qx"), F.col("qy"), F.col("qz")), "cartesian3": lambda: cartesian(*[F.col(f"q{c}") for c in axes])}
    if kind not in make:
        raise ValueError(f"unknown ordering {kind!r}")
    return q.select(*ids, make[kind]().alias("key"))


def element_keys(mesh: Mesh, kind: str = "hilbert3", axes: str = "xyz") -> DataFrame:
    return curve_keys(centroids(mesh), kind, axes)


def reorder(mesh: Mesh, kind: str = "hilbert3", axes: str = "xyz") -> Mesh:
    """Elements along a curve through their barycentres (ties by id), then nodes by first touch."""
    keys = element_keys(mesh, kind, axes)
    ids = dense_ids(keys, ["block_id", "key", "elem_id"], "at")
    low = ids.groupBy("block_id").agg(F.min("at").alias("low"))
    ids = ids.join(F.broadcast(low), "block_id").select("block_id", "elem_id", (F.col("at") - F.col("low")).alias("new_elem"))
    rows = mesh.elements.join(ids, ["block_id", "elem_id"]).select("block_id", F.col("new_elem").alias("elem_id"), "nodes")
    return renumber_nodes(replace(mesh, elements=materialize(rows)))


def permuted(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """rows rekeyed through ids (key, new_id)."""
    return rows.join(ids, key).drop(key).withColumnRenamed("new_id", key)


def cuthill_mckee(graph: DataFrame, n: int) -> DataFrame:
    """node, new_id by breadth-first numbering, level by level.

    The seed has the least degree (then id) and its component comes first; each further one, in the order of their lowest
    ids, starts at that id. Within a level, nodes follow their lowest-numbered neighbour before, then degree (row length),
    then id. All components advance together, so rounds follow the longest of them; a level is a join of its rim and a dense
    numbering, and one numbering by component, level and place ends it.
    """
    from .regions import linked_groups

    spark = graph.sparkSession
    edges = materialize(graph.select("i", "j"))
    degree = edges.groupBy("i").agg(F.count("*").alias("d"))
    groups = linked_groups(edges.select(F.col("i").alias("a"), F.col("j").alias("b"))).members.select(F.col("node").alias("g"), "group")
    nodes = spark.range(n).select(F.col("id").alias("node")).join(degree, F.col("node") == F.col("i"), "left").join(groups, F.col("node") == F.col("g"), "left")
    nodes = materialize(nodes.select("node", F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("group", "node").alias("group")))
    first = nodes.orderBy("d", "node").select("node", "group").first()
    if first is None:
        return nodes.select("node", F.col("node").alias("new_id"))
    # A component's lowest id names it; that of the seed starts elsewhere and goes before the others.
    seeds = nodes.where("node = group").select(F.when(F.col("group") == first["group"], F.lit(first["node"])).otherwise(F.col("node")).alias("node"), "group")
    order_ = F.when(F.col("group") == first["group"], F.lit(-1).cast("long")).otherwise(F.col("group"))
    rim = materialize(dense_ids(seeds.withColumn("o", order_), ["o"], "place").select("node", "place"))
    levels, before = [rim.withColumn("level", F.lit(0))], rim.limit(0)
    while True:
        reached = edges.join(rim.select(F.col("node").alias("i"), "place"), "i").groupBy("j").agg(F.min("place").alias("parent"))
        new = reached.join(rim.select(F.col("node").alias("j")), "j", "left_anti").join(before.select(F.col("node").alias("j")), "j", "left_anti")
        ranked = new.join(nodes, F.col("j") == F.col("node")).select("node", "parent", "d")
        level = materialize(dense_ids(ranked, ["parent", "d", "node"], "place").select("node", "place"))
        if not level.limit(1).count():
            break
        levels.append(level.withColumn("level", F.lit(len(levels))))
        before, rim = rim, level
    met = levels[0]
    for level in levels[1:]:
        met = met.unionByName(level)
    met = met.join(nodes, "node").withColumn("o", order_)
    return dense_ids(met.select("node", "o", "level", "place"), ["o", "level", "place"], "new_id").select("node", "new_id")
