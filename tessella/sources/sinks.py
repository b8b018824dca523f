"""Writers: headerless ordered columns, mesh folders, side sets, grids and text templates.

A column file holds its numbers in the order of their ids. Rows are range-partitioned and sorted by id; each task writes
its own run at its place in a file beside the target (ids are dense), which takes the target's name on commit, so nothing is
collected and a failed write leaves what was there. Files are reached by path, as in the format: the folder has to be one
that all executors see.
"""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path
from xml.sax.saxutils import quoteattr

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.elem_types import element_type
from ..mesh import Mesh
from ..operators.numbering import dense_ids, running_total
from ..storage import materialize
from . import files, raw
from .raw import DTYPES, NOT_DENSE, RawColumns


def write_columns(df: DataFrame, columns: dict[str, str], id_col: str = "id", ordered: bool = False) -> int:
    """columns: file path -> column; the suffix gives the type. Returns the number of rows.

    Ids have to be 0..n-1, each once, or the call fails; files that were there before are replaced when all is written and
    stay as they were if anything fails. `ordered` says that every partition is a run of ids in their order already, as those
    of a range are: then nothing is shuffled.
    """
    paths = [files.local(p) for p in columns]
    for p in paths:
        if files.is_remote(p):
            raise ValueError(f"{p}: column files are written to a folder that all executors see as a path")
    df.sparkSession.dataSource.register(RawColumns)
    picked = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns.values())])
    rows = picked if ordered else picked.repartitionByRange("id").sortWithinPartitions("id")
    kinds = [p.rsplit(".", 1)[-1] for p in paths]
    try:
        rows.write.format("raw_columns").mode("append").option("paths", "\n".join(paths)).option("kinds", ",".join(kinds)).option("token", uuid.uuid4().hex).save()
    except Exception as e:
        if found := re.search(rf"{NOT_DENSE}; this fails near -?\d+", str(e)):
            raise ValueError(found[0]) from None
        raise
    return os.path.getsize(paths[0]) // np.dtype(DTYPES[kinds[0]]).itemsize


def write_array(df: DataFrame, path: str) -> int:
    """df: id, value."""
    return write_columns(df, {path: "value"})


def _block(rows: DataFrame, folder: str, width: int, index: str, ordered: bool = False) -> int:
    cols = [F.get("nodes", F.lit(k)).alias(f"n{k}") for k in range(width)]
    return write_columns(rows.select("elem_id", *cols), {f"{folder}/i{k}.{index}": f"n{k}" for k in range(width)}, "elem_id", ordered)


def write_mesh(mesh: Mesh, folder: str, index: str = "int32", real: str = "float32") -> None:
    """The folder form: i*, x, y, z, blocks/<name>/i* for several blocks, node_mapping where there is one, meta.yaml."""
    os.makedirs(folder, exist_ok=True)
    names = "xyz"[: mesh.dim]
    n_nodes = write_columns(mesh.points, {f"{folder}/{c}.{real}": c for c in names}, "node_id")
    single = len(mesh.blocks) == 1
    lines = [f"spatial_dimension: {mesh.dim}"]
    if single:
        t = element_type(mesh.elem_type)
        n = _block(mesh.elements, folder, t.n_nodes, index)
        lines += [f"elem_num_nodes: {t.n_nodes}", f"element_type: {t.name}", f"n_elements: {n}", f"n_nodes: {n_nodes}", "elements:"]
        lines += [f"- i{k}: i{k}.{index}" for k in range(t.n_nodes)]
    else:
        lines += [f"n_nodes: {n_nodes}", f"n_blocks: {len(mesh.blocks)}", "blocks:"]
        for b in mesh.blocks:
            t = element_type(b.elem_type)
            n = _block(mesh.elements.where(F.col("block_id") == b.block_id), f"{folder}/blocks/{b.name}", t.n_nodes, index)
            lines += [f"- name: {b.name}", f"  element_type: {t.name}", f"  elem_num_nodes: {t.n_nodes}", f"  n_elements: {n}"]
    lines += ["points:", *[f"- {c}: {c}.{real}" for c in names], "rpath: true"]
    write_meta(folder, lines)
    if mesh.node_mapping is not None:
        write_columns(mesh.node_mapping, {f"{folder}/node_mapping.{index}": "source_id"}, "node_id")


def write_sideset(sideset: DataFrame, folder: str, index: str = "int32") -> None:
    """parent, lfi in the order of (parent, lfi), and meta.yaml with the files' true names."""
    rows = dense_ids(sideset.select("parent", "lfi"), ["parent", "lfi"], "id")
    n = write_columns(rows, {f"{folder}/parent.{index}": "parent", f"{folder}/lfi.int16": "lfi"})
    Path(folder, "meta.yaml").write_text(f"parent: parent.{index}\nlfi: lfi.int16\nn_sides: {n}\nrpath: true\n")


def write_field(mesh: Mesh, folder: str, name: str, field: DataFrame, kind: str = "float64", block_size: int = 1) -> str:
    """A nodal or elemental field (id, comp, value) in global order; a mapped mesh's ids are led back first."""
    rows = field
    if mesh.node_mapping is not None:
        rows = field.join(mesh.node_mapping, F.col("id") == F.col("node_id")).select(F.col("source_id").alias("id"), "comp", "value")
    path = f"{folder}/{name}.{kind}"
    write_columns(rows.select((F.col("id") * block_size + F.col("comp")).alias("id"), "value"), {path: "value"})
    return path


def write_grid(field: DataFrame, folder: str, n: tuple[int, int, int], origin: tuple[float, ...], delta: tuple[float, ...], kind: str = "float32", block_size: int = 1) -> None:
    at = F.col("ix") + n[0] * (F.col("iy") + n[1] * F.col("iz"))
    write_columns(field.select((at * block_size + F.col("comp")).alias("id"), "value"), {f"{folder}/sdf.{kind}": "value"})
    lines = [f"path: sdf.{kind}", "spatial_dimension: 3"]
    for d, c in enumerate("xyz"):
        lines += [f"n{c}: {n[d]}", f"o{c}: {origin[d]}", f"d{c}: {delta[d]}"]
    Path(folder, "meta.yaml").write_text("\n".join([*lines, f"block_size: {block_size}"]) + "\n")
    Path(folder, "sdf.xdmf").write_text(xdmf_of_grid(n, origin, delta, f"sdf.{kind}", kind, block_size))


def xdmf_of_grid(n: tuple[int, int, int], origin: tuple[float, ...], delta: tuple[float, ...], path: str, kind: str = "float32", block_size: int = 1) -> str:
    dims = " ".join(map(str, reversed(n)))
    values = dims if block_size == 1 else f"{dims} {block_size}"
    size = np.dtype(DTYPES[kind]).itemsize
    rev = lambda v: " ".join(f"{x:g}" for x in reversed(v))
    return (
        '<?xml version="1.0" ?>\n<Xdmf Version="3.0">\n <Domain>\n  <Grid Name="grid" GridType="Uniform">\n'
        f'   <Topology TopologyType="3DCoRectMesh" Dimensions="{dims}"/>\n   <Geometry GeometryType="ORIGIN_DXDYDZ">\n'
        f'    <DataItem Dimensions="3" Format="XML">{rev(origin)}</DataItem>\n    <DataItem Dimensions="3" Format="XML">{rev(delta)}</DataItem>\n   </Geometry>\n'
        f'   <Attribute Name="field" AttributeType="{"Scalar" if block_size == 1 else "Vector"}" Center="Node">\n'
        f'    <DataItem Dimensions="{values}" NumberType="Float" Precision="{size}" Format="Binary" Endian="Little">{path}</DataItem>\n   </Attribute>\n  </Grid>\n </Domain>\n</Xdmf>\n'
    )


# XDMF's names of the types whose nodes have the same order there.
XDMF_TYPES = {"TRI3": "Triangle", "TRISHELL3": "Triangle", "TRI6": "Triangle_6", "QUAD4": "Quadrilateral", "QUADSHELL4": "Quadrilateral", "TET4": "Tetrahedron", "TET10": "Tetrahedron_10", "HEX8": "Hexahedron", "WEDGE6": "Wedge"}


def _number(path: str, default: str) -> np.dtype:
    """The type of a file's numbers, one that XDMF has."""
    d = np.dtype(DTYPES[raw.dtype_of(path, default)])
    if d == np.float16:
        raise ValueError(f"{path}: XDMF has no floats of 16 bits")
    return d


def _data_item(path: str, default: str, dims: str, seek: int = 0) -> str:
    d = _number(path, default)
    kind = {"f": "Float", "i": "Int", "u": "UInt"}[d.kind]
    return f'<DataItem Dimensions="{dims}" NumberType="{kind}" Precision="{d.itemsize}" Format="Binary" Endian="Little" Seek="{seek}">{path}</DataItem>'


def _joined(paths: list[str], default: str, n: int) -> str:
    """Columns side by side: an item whose rows have a number from each."""
    names = ", ".join(f"${k}" for k in range(len(paths)))
    return f'<DataItem ItemType="Function" Function="JOIN({names})" Dimensions="{n} {len(paths)}">' + "".join(_data_item(p, default, f"{n} 1") for p in paths) + "</DataItem>"


def write_mesh_xdmf(folder: str, fields: dict[str, tuple[str, str]] | None = None) -> str:
    """mesh.xdmf beside a folder's column files, which it refers to: a grid for each block, with nodal and elemental fields.

    fields: name -> (file in the folder, "node" or "element"); a file holds the numbers of all nodes, or of all blocks' elements
    one block after the other, and its length tells the numbers of each. Meshes have two or three dimensions, and types that
    XDMF numbers alike (`XDMF_TYPES`). Only lengths are read.
    """
    meta = raw.read_meta(folder)
    dim, n_nodes = int(meta["spatial_dimension"]), int(meta["n_nodes"])
    if dim not in (2, 3):
        raise ValueError(f"a mesh of {dim} dimensions has no XDMF geometry")
    points = [p.rsplit("/", 1)[-1] for p in raw.coordinate_files(folder)]
    parts = [(b["name"], b["element_type"], int(b["n_elements"]), f"blocks/{b['name']}/") for b in meta.get("blocks") or []] or [("default", meta["element_type"], int(meta["n_elements"]), "")]
    total, grids, before = sum(p[2] for p in parts), [], 0
    widths = {}
    for name, (path, center) in (fields or {}).items():
        count = {"node": n_nodes, "element": total}[center]
        size, item = files.size(f"{folder}/{path}"), _number(path, "float64").itemsize
        if not count or size % (count * item):
            raise ValueError(f"{path}: {size} bytes aren't the same number of numbers for each of {count} {center}s")
        widths[name] = size // (count * item)
    for name, kind, n, place in parts:
        if kind not in XDMF_TYPES:
            raise ValueError(f"XDMF numbers no {kind} as meshes do here")
        columns = [place + p.rsplit("/", 1)[-1] for p in raw.connectivity_files(f"{folder}/{place}".rstrip("/"))]
        lines = [f"<Grid Name={quoteattr(name)} GridType=\"Uniform\">", f'<Topology TopologyType="{XDMF_TYPES[kind]}" NumberOfElements="{n}">{_joined(columns, 'int32', n)}</Topology>']
        lines.append(f'<Geometry GeometryType="{"XYZ" if dim == 3 else "XY"}">{_joined(points, 'float32', n_nodes)}</Geometry>')
        for field, (path, center) in (fields or {}).items():
            w, rows = widths[field], n_nodes if center == "node" else n
            item = _number(path, "float64").itemsize
            shape = {1: "Scalar", 3: "Vector", 6: "Tensor6", 9: "Tensor"}.get(w, "Matrix")
            seek = 0 if center == "node" else before * w * item
            lines.append(f'<Attribute Name={quoteattr(field)} AttributeType="{shape}" Center="{"Node" if center == "node" else "Cell"}">{_data_item(path, "float64", f"{rows} {w}" if w > 1 else str(rows), seek)}</Attribute>')
        grids.append("\n".join([*lines, "</Grid>"]))
        before += n
    if len(grids) > 1:
        grids = ['<Grid Name="mesh" GridType="Collection" CollectionType="Spatial">', *grids, "</Grid>"]
    out = f"{folder}/mesh.xdmf"
    Path(out).write_text("\n".join(['<?xml version="1.0" ?>', '<Xdmf Version="3.0">', "<Domain>", *grids, "</Domain>", "</Xdmf>"]) + "\n")
    return out


def write_csr(graph: DataFrame, n: int, folder: str, values: bool = True, index: str = "int32", real: str = "float64") -> None:
    """rowptr (n + 1 entries), colidx and values of a graph or matrix (i, j[, value])."""
    from ..operators.graph import row_pointers

    write_columns(row_pointers(graph, n).select(F.col("row").alias("id"), "start"), {f"{folder}/rowptr.{index}": "start"})
    rows = dense_ids(graph, ["i", "j"], "id")
    write_columns(rows, {f"{folder}/colidx.{index}": "j"} | ({f"{folder}/values.{real}": "value"} if values and "value" in graph.columns else {}))


def write_hex8_cube(spark: SparkSession, folder: str, nx: int, ny: int, nz: int, box: tuple[float, ...] = (0.0, 0.0, 0.0, 1.0, 1.0, 1.0), z_chunk: int = 16, index: str = "int32", real: str = "float32") -> None:
    """A cube's folder, slab by slab: a task makes and writes z_chunk layers of cells or nodes. Nothing is shuffled or sorted,
    and a task holds a batch."""
    from . import generate as G

    mesh = G.hex8_cube(spark, nx, ny, nz, box, slabs=-(-nz // z_chunk))
    os.makedirs(folder, exist_ok=True)
    n_nodes = write_columns(mesh.points, {f"{folder}/{c}.{real}": c for c in "xyz"}, "node_id", ordered=True)
    n = _block(mesh.elements, folder, 8, index, ordered=True)
    write_meta(folder, [f"spatial_dimension: {mesh.dim}", "elem_num_nodes: 8", "element_type: HEX8", f"n_elements: {n}", f"n_nodes: {n_nodes}", "elements:", *[f"- i{k}: i{k}.{index}" for k in range(8)], "points:", *[f"- {c}: {c}.{real}" for c in "xyz"], "rpath: true"])


def write_meta(folder: str, lines: list[str]) -> None:
    """meta.yaml, in place of the old one at once."""
    beside = Path(folder, f".meta.yaml.{uuid.uuid4().hex}")
    beside.write_text("\n".join(lines) + "\n")
    os.replace(beside, Path(folder, "meta.yaml"))


def write_packed(mesh: Mesh, folder: str, max_nodes: int = 1 << 15, index: str = "int32", real: str = "float32") -> int:
    """A single-block mesh in packs: node_map and points by packed id, and in the block's folder the elements in local ids of
    16 bits, where each pack's owned nodes and ghosts begin, how many of the owned are shared, and the ghosts' packed ids.
    Returns the number of packs."""
    from ..operators import partition

    per = partition.elements_per_pack(mesh, max_nodes)
    nodes = materialize(partition.packed_nodes(mesh, per))
    own = nodes.where("class < 2").select(F.col("packed_id").alias("id"), "node_id")
    most = nodes.groupBy("pack").agg(F.max("local_id").alias("m")).agg(F.max("m")).first()[0]
    if most is not None and most >= 1 << 15:
        raise ValueError(f"a pack has {most + 1} nodes; local ids of 16 bits reach to {1 << 15}")
    os.makedirs(folder, exist_ok=True)
    write_columns(own, {f"{folder}/node_map.{index}": "node_id"})
    write_columns(own.join(mesh.points, "node_id"), {f"{folder}/x{k}.{real}": c for k, c in enumerate("xyz"[: mesh.dim])})
    block = mesh.blocks[0]
    at, width = f"{folder}/{block.name}", element_type(block.elem_type).n_nodes
    _block(partition.packed_elements(mesh, per), at, width, "int16")
    n_packs = -(-mesh.n_elements() // per)
    counts = nodes.groupBy("pack").agg(*[F.sum(F.col("class").isin(*k).cast("long")).alias(c) for c, k in (("owned", (0, 1)), ("shared", (1,)), ("ghosts", (2,)))])
    table = materialize(mesh.spark.range(n_packs).withColumnRenamed("id", "pack").join(counts, "pack", "left").fillna(0))
    for name, column in (("owned_nodes_ptr", "owned"), ("ghost_ptr", "ghosts")):
        write_columns(running_total(table, "pack", column), {f"{at}/{name}.int64": "start"})
    write_columns(table, {f"{at}/n_shared.int64": "shared"}, "pack")
    ghosts = dense_ids(nodes.where("class = 2").select("pack", "local_id", "packed_id"), ["pack", "local_id"], "id")
    write_columns(ghosts, {f"{at}/ghost_idx.{index}": "packed_id"})
    write_meta(folder, [f"spatial_dimension: {mesh.dim}", f"element_type: {block.elem_type}", f"n_packs: {n_packs}", f"elements_per_pack: {per}", f"block: {block.name}"])
    return n_packs


def write_blocks(mesh: Mesh, folder: str, size: int = 1 << 15, index: str = "int32") -> int:
    """A single-block mesh's elements in blocks of `size`, each with local ids of 16 bits by first touch; node_mapping leads a
    block's local ids back, node_offset says where each block's begin. Returns the number of blocks."""
    width = element_type(mesh.elem_type).n_nodes
    long = mesh.elements.select(F.call_function("div", F.col("elem_id"), F.lit(size)).alias("k"), "elem_id", F.posexplode("nodes").alias("lnode", "node_id"))
    seen = long.groupBy("k", "node_id").agg(F.min(F.struct("elem_id", "lnode")).alias("touch"))
    nodes = materialize(seen.withColumn("local", F.row_number().over(W.partitionBy("k").orderBy("touch")) - 1))
    sizes = materialize(nodes.groupBy("k").agg(F.count("*").alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most > 1 << 15:
        raise ValueError(f"a block has {most} nodes; local ids of 16 bits reach to {1 << 15}")
    local = long.join(nodes.select("k", "node_id", "local"), ["k", "node_id"]).groupBy("elem_id").agg(F.sort_array(F.collect_list(F.struct("lnode", "local"))).alias("x"))
    os.makedirs(folder, exist_ok=True)
    n = _block(local.select("elem_id", F.transform("x", lambda s: s["local"]).alias("nodes")), folder, width, "int16")
    starts = materialize(running_total(sizes, "k", "n"))
    write_columns(starts, {f"{folder}/node_offset.int64": "start"})
    at = nodes.join(starts.select(F.col("id").alias("k"), "start"), "k").select((F.col("start") + F.col("local")).alias("id"), "node_id")
    write_columns(at, {f"{folder}/node_mapping.{index}": "node_id"})
    write_meta(folder, [f"element_type: {mesh.elem_type}", f"n_elements: {n}", f"block_size: {size}", f"n_blocks: {-(-n // size)}"])
    return -(-n // size)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Parquet, one folder a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
