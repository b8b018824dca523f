"""Command line over mesh folders: python -m tessella.cli <command> ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import convert, distance, graph, lattice, order, partition, regions, sets, transfer
from .operators.numbering import dense_ids
from .session import local_session
from .sources import generate as G
from .sources import raw, sinks
from .storage import materialize


INTEGERS = ("nx", "ny", "nz", "levels", "level", "layers", "parts", "max_nodes", "axis", "split", "block_size")
REALS = ("x", "y", "z", "threshold", "height", "radius", "inner", "outer")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Runs a command in a session of its own, which ends with it, or in the given one."""
    p = argparse.ArgumentParser(prog="tessella")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options: str):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a, type=int if a in INTEGERS else float if a in REALS else str)
        for k, v in options.items():
            c.add_argument(f"--{k}", default=v)

    command("cube", "type", "nx", "ny", "nz", "out", order="none")
    command("square", "type", "nx", "ny", "out")
    command("ring", "inner", "outer", "layers", "nx", "out")
    command("half-sphere", "type", "radius", "nx", "ny", "nz", "out")
    command("checkerboard", "nx", "ny", "nz", "out")
    for name in ("skin", "n2e", "n2n", "dual", "half-faces", "adjacency"):
        command(name, "mesh", "out")
    for name in ("convert", "promote"):
        command(name, "mesh", "type", "out")
    command("refine", "mesh", "levels", "out")
    command("extrude", "mesh", "height", "layers", "out")
    command("to-semistructured", "mesh", "level", "out")
    command("sfc", "mesh", "out", order="hilbert3")
    command("create-sideset", "mesh", "x", "y", "z", "threshold", "out")
    command("partition", "mesh", "parts", "out")
    command("pack", "mesh", "max_nodes", "out")
    command("to-blocks", "mesh", "block_size", "out")
    command("bidomain-cube", "nx", "ny", "nz", "axis", "split", "out")
    command("derefine", "mesh", "level", "out")
    command("surface-from-sideset", "mesh", "sideset", "out", level="1")
    command("sharp-features", "mesh", "out", threshold="0.15")
    command("cuthill-mckee", "mesh", "out")
    command("select-surface", "mesh", "x", "y", "z", "threshold", "out")
    command("extract-submesh", "mesh", "x", "y", "z", "max_nodes", "out", along="no")
    command("signed-distance", "mesh", "surface", "out")
    for name in ("prolong", "restrict"):
        command(name, "mesh", "type", "field", "out")
    a = p.parse_args(argv)
    own = spark is None
    spark = spark or local_session("*")
    mesh = raw.read_mesh(spark, a.mesh) if hasattr(a, "mesh") else None
    c = a.command
    made = None
    if c == "cube":
        made = G.cube(spark, a.type, a.nx, a.ny, a.nz)
        made = made if a.order == "none" else order.reorder(made, a.order)
    elif c == "square":
        made = G.square(spark, a.type, a.nx, a.ny)
    elif c == "ring":
        made = G.quad4_ring(spark, a.inner, a.outer, a.layers, a.nx)
    elif c == "half-sphere":
        made = G.half_sphere(spark, a.type, a.radius, a.nx, a.ny, a.nz)
    elif c == "checkerboard":
        made = G.hex8_checkerboard_cube(spark, a.nx, a.ny, a.nz)
    elif c == "skin":
        s = sets.skin_sideset(mesh)
        made = sets.surface_mesh(mesh, s)
        sinks.write_sideset(s, f"{a.out}/parent_sideset")
    elif c == "convert":
        made = convert.convert_to(mesh, a.type)
    elif c == "promote":
        made = convert.promote_to(mesh, a.type)
    elif c == "refine":
        made = convert.refine(mesh, a.levels)
    elif c == "extrude":
        made = convert.extrude(mesh, a.height, a.layers)
    elif c == "to-semistructured":
        made = lattice.to_semistructured(mesh, a.level)
    elif c == "sfc":
        made = order.reorder(mesh, a.order)
    elif c == "n2e":
        g = graph.node_to_element(mesh).select(F.col("node_id").alias("i"), F.col("elem_id").alias("j"))
        sinks.write_csr(g, mesh.n_nodes(), a.out)
    elif c == "n2n":
        sinks.write_csr(graph.node_to_node(mesh), mesh.n_nodes(), a.out)
    elif c == "adjacency":
        sinks.write_csr(graph.adjacency_matrix(graph.node_to_node(mesh)), mesh.n_nodes(), a.out)
    elif c == "create-sideset":
        sinks.write_sideset(sets.sideset_from_seed(mesh, (a.x, a.y, a.z), a.threshold), a.out)
    elif c == "dual":
        sinks.write_tables({"dual": graph.dual(mesh)}, a.out)
    elif c == "half-faces":
        sinks.write_tables({"half_faces": graph.half_faces(mesh)}, a.out)
    elif c == "partition":
        sinks.write_tables({"report": partition.partition_report(mesh, a.parts)}, a.out)
    elif c == "pack":
        sinks.write_packed(mesh, a.out, a.max_nodes)
    elif c == "to-blocks":
        sinks.write_blocks(mesh, a.out, a.block_size)
    elif c == "bidomain-cube":
        made = G.hex8_bidomain_cube(spark, a.nx, a.ny, a.nz, a.axis, a.split)
    elif c == "derefine":
        made = lattice.derefine(lattice.hierarchical_renumbering(mesh), a.level)
    elif c == "surface-from-sideset":
        level = int(a.level)
        fine = lattice.to_semistructured(mesh, level) if level > 1 else mesh
        made = sets.surface_mesh(fine, raw.read_sideset(spark, a.sideset))
    elif c == "sharp-features":
        edges = materialize(sets.sharp_edges(mesh, float(a.threshold)))
        nodes = materialize(sets.sharp_corners(edges))
        kept = dense_ids(sets.edges_without_corners(edges, nodes), ["e0", "e1"], "id")
        sinks.write_columns(kept, {f"{a.out}/i0.int32": "e0", f"{a.out}/i1.int32": "e1"})
        sinks.write_columns(dense_ids(nodes, ["node_id"], "id"), {f"{a.out}/corners/i0.int32": "node_id"})
        faces = sets.disconnected_faces(mesh, edges)
        sinks.write_columns(dense_ids(faces, ["elem_id"], "id"), {f"{a.out}/disconnected/elements.int32": "elem_id"})
    elif c == "cuthill-mckee":
        made = sets.renumber_nodes(mesh, materialize(order.cuthill_mckee(graph.node_to_node(mesh), mesh.n_nodes()).withColumnRenamed("node", "node_id")))
    elif c == "select-surface":
        sinks.write_columns(dense_ids(regions.select_surface(mesh, (a.x, a.y, a.z), a.threshold), ["elem_id"], "id"), {a.out: "elem_id"})
    elif c == "extract-submesh":
        made = regions.submesh_around(mesh, (a.x, a.y, a.z), a.max_nodes, along=a.along == "yes")
    elif c == "signed-distance":
        found = distance.distance_to_surface(mesh.points, raw.read_mesh(spark, a.surface))
        sinks.write_columns(found, {f"{a.out}/distance.float64": "distance"}, "node_id")
    elif c in ("prolong", "restrict"):
        weights = transfer.p1_weights(convert.promote_to(mesh, a.type))
        field = raw.read_array(spark, a.field, as_type="double").withColumn("comp", F.lit(0))
        out = (transfer.prolongate if c == "prolong" else transfer.restrict)(weights, field)
        sinks.write_columns(out, {a.out: "value"})
    if made is not None:
        sinks.write_mesh(made, a.out)
    if own:
        spark.stop()


if __name__ == "__main__":
    main()
