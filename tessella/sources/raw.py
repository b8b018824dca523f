"""Mesh folders: headerless column files, side sets and grids, read in byte ranges by a Python data source.

Paths are read by the executors themselves, with conditions on `id` taken down to the byte ranges where the session has
spark.sql.python.filterPushdown.enabled; elsewhere Spark applies them to all rows. URIs of a store that only Spark reads go
through its reader of fixed-length records.
"""

from __future__ import annotations

import os
import re
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.elem_types import NAMES, element_type, type_of_size
from ..mesh import Block, Mesh
from . import files

# What a file's suffix says about its numbers; "raw" is the default of its role.
DTYPES = {"float16": "<f2", "float32": "<f4", "float64": "<f8", "int16": "<i2", "int32": "<i4", "int64": "<i8", "uint8": "<u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8"}
SPARK = {"float16": "float", "float32": "float", "float64": "double", "int16": "short", "int32": "int", "int64": "long", "uint8": "short", "uint16": "int", "uint32": "long", "uint64": "decimal(20,0)"}
SPLIT_BYTES = 128 << 20


def dtype_of(path: str, raw: str = "int32") -> str:
    suffix = path.rsplit(".", 1)[-1]
    if suffix == "raw":
        return raw
    if suffix not in DTYPES:
        raise ValueError(f"{path}: no type is known for .{suffix}")
    return suffix


def _length(paths: list[str], kinds: list[str]) -> int:
    """Rows of equally long columns."""
    sizes = {files.size(p) // np.dtype(DTYPES[k]).itemsize for p, k in zip(paths, kinds)}
    if len(sizes) != 1:
        raise ValueError(f"columns differ in length: {sorted(sizes)}")
    return sizes.pop()


def _array(x: np.ndarray, kind: str) -> pa.Array:
    """Numbers as the type that Spark has for them."""
    wide = {"float16": np.float32, "uint8": np.int16, "uint16": np.int32, "uint32": np.int64}.get(kind)
    return pa.array(x.astype(wide) if wide else x)


class _Range(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class _Reader(DataSourceReader):
    """Equally long columns in one pass: every partition reads the same rows of each file."""

    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.kinds = options["kinds"].split(",")
        self.n = _length(self.paths, self.kinds)
        self.low, self.stop = 0, self.n
        width = max(np.dtype(DTYPES[k]).itemsize for k in self.kinds)
        self.rows = max(1, int(options.get("splitbytes", SPLIT_BYTES)) // width)

    def partitions(self):
        return [_Range(a, min(self.stop, a + self.rows)) for a in range(self.low, self.stop, self.rows)] or [_Range(0, 0)]

    def read(self, part):
        step = 1 << 20
        for a in range(part.first, part.stop, step):
            b = min(part.stop, a + step)
            cols = [pa.array(np.arange(a, b, dtype=np.int64))]
            for p, k in zip(self.paths, self.kinds):
                d = np.dtype(DTYPES[k])
                cols.append(_array(np.fromfile(files.local(p), d, b - a, offset=a * d.itemsize), k))
            yield pa.RecordBatch.from_arrays(cols, names=["id", *[f"c{i}" for i in range(len(self.paths))]])


class _BoundedReader(_Reader):
    """The same with conditions taken down: Spark refuses a reader with pushFilters where the session has that switched off."""

    def pushFilters(self, filters):
        """Bounds on id narrow the rows that are read; a list of ids does too, and is left to Spark as well."""
        for f in filters:
            if getattr(f, "attribute", None) != ("id",):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.stop = max(self.low, f.value), min(self.stop, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, f.value + 1)
            elif isinstance(f, LessThanOrEqual):
                self.stop = min(self.stop, f.value + 1)
            elif isinstance(f, LessThan):
                self.stop = min(self.stop, f.value)
            elif isinstance(f, In) and f.value and all(isinstance(v, int) for v in f.value):
                self.low, self.stop = max(self.low, min(f.value)), min(self.stop, max(f.value) + 1)
                yield f
            elif not isinstance(f, IsNotNull):
                yield f


class _Run(WriterCommitMessage):
    """What a task has written: its first and last id (0 and -1 if none), and whether they follow each other."""

    def __init__(self, first: int, last: int, dense: bool):
        self.first, self.last, self.dense = first, last, dense


class _Writer(DataSourceArrowWriter):
    """Every task puts its run of rows at its place in a file beside the target. Only when all are there, and their ids are
    0..n-1, each once, do these files take the targets' names; otherwise they go and the targets stay as they were. A task
    that runs again writes the same bytes at the same places."""

    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.kinds = options["kinds"].split(",")
        self.beside = [os.path.join(os.path.dirname(p), f".{os.path.basename(p)}.{options['token']}") for p in self.paths]

    def write(self, iterator):
        first, last, dense = None, None, True
        for b in iterator:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            dense = bool((np.diff(ids) == 1).all()) and last in (None, int(ids[0]) - 1) and int(ids[0]) >= 0
            first, last = int(ids[0]) if first is None else first, int(ids[-1])
            if not dense:
                break
            for c, (path, kind) in enumerate(zip(self.beside, self.kinds)):
                d = np.dtype(DTYPES[kind])
                x = b.column(c + 1).to_numpy(zero_copy_only=False).astype(d)
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                with open(os.open(path, os.O_RDWR | os.O_CREAT, 0o644), "r+b") as f:
                    f.seek(int(ids[0]) * d.itemsize)
                    f.write(x.tobytes())
        for _ in iterator:  # the rest is taken, so that Spark sees the task through
            pass
        return _Run(0, -1, True) if first is None else _Run(first, last, dense)

    def commit(self, messages):
        n = 0
        for r in sorted((m for m in messages if m is not None and m.first <= m.last), key=lambda r: (r.first, r.last)):
            if not r.dense or r.first != n:
                raise ValueError(f"{NOT_DENSE}; this fails near {r.first if r.first != n else r.last}")
            n = r.last + 1
        for target, path in zip(self.paths, self.beside):
            if not n:
                os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
                open(path, "wb").close()
            os.replace(path, target)

    def abort(self, messages):
        for path in self.beside:
            if os.path.exists(path):
                os.remove(path)


NOT_DENSE = "ids have to be 0..n-1, each once"


class RawColumns(DataSource):
    """format("raw_columns"): options paths (newline-separated), kinds (comma-separated), splitBytes, bounds (true: conditions on
    id are taken down, which the session has to allow); to write, a token of its own for each write, and rows (id, then a column a path) sorted by id within partitions."""

    @classmethod
    def name(cls) -> str:
        return "raw_columns"

    def schema(self) -> str:
        return "id long, " + ", ".join(f"c{i} {SPARK[k]}" for i, k in enumerate(self.options["kinds"].split(",")))

    def reader(self, schema):
        return (_BoundedReader if self.options.get("bounds") == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def read_columns(spark: SparkSession, paths: list[str], raw: str = "int32", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """id, c0, c1, ...: the files' numbers side by side; only the files asked for are opened."""
    return columns_of_kinds(spark, paths, [dtype_of(p, raw) for p in paths], split_bytes)


def columns_of_kinds(spark: SparkSession, paths: list[str], kinds: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same with each file's type given."""
    if any(map(files.is_remote, paths)):
        return _remote_columns(spark, paths, kinds)
    spark.dataSource.register(RawColumns)
    bounds = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("raw_columns").option("paths", "\n".join(paths)).option("kinds", ",".join(kinds)).option("splitBytes", str(split_bytes)).option("bounds", bounds).load()


def _remote_columns(spark: SparkSession, paths: list[str], kinds: list[str]) -> DataFrame:
    """Equal records of every file meet by their number; each pair of records is decoded at once."""
    n = _length(paths, kinds)
    schema = "id long, " + ", ".join(f"c{i} {SPARK[k]}" for i, k in enumerate(kinds))
    if not n:
        return spark.createDataFrame([], schema)
    rows = files.record_rows(n)
    met = None
    for i, (p, k) in enumerate(zip(paths, kinds)):
        own = files.records(spark, p, rows * np.dtype(DTYPES[k]).itemsize).withColumnRenamed("data", f"d{i}")
        met = own if met is None else met.join(own, "record")

    def decoded(batches):
        for b in batches:
            for at in range(b.num_rows):
                first = b.column("record")[at].as_py() * rows
                cols = [_array(np.frombuffer(b.column(f"d{i}")[at].as_buffer(), DTYPES[k]), k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + rows)), *cols], names=["id", *[f"c{i}" for i in range(len(kinds))]])

    return met.mapInArrow(decoded, schema)


def read_array(spark: SparkSession, path: str, raw: str = "float32", as_type: str | None = None) -> DataFrame:
    """id, value."""
    df = read_columns(spark, [path], raw).withColumnRenamed("c0", "value")
    return df.withColumn("value", F.col("value").cast(as_type)) if as_type else df


def find_files(folder: str, pattern: str) -> list[str]:
    return files.matching(folder, pattern)


def file_size(path: str) -> int:
    return files.size(path)


def connectivity_files(folder: str) -> list[str]:
    found = {int(m[1]): f"{folder.rstrip('/')}/{n}" for n in files.names(folder) if (m := re.fullmatch(r"i(\d+)\.(raw|int16|int32|int64)", n))}
    if sorted(found) != list(range(len(found))) or not found:
        raise FileNotFoundError(f"{folder}: connectivity columns are missing")
    return [found[k] for k in range(len(found))]


def coordinate_files(folder: str) -> list[str]:
    there = set(files.names(folder))
    for names in (("x", "y", "z"), ("x0", "x1", "x2")):
        found = []
        for n in names:
            got = [p for e in ("raw", "float16", "float32", "float64") if (p := f"{n}.{e}") in there]
            if not got:
                break
            found.append(f"{folder.rstrip('/')}/{got[0]}")
        if found:
            return found
    raise FileNotFoundError(f"{folder}: no coordinates")


def read_block(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """elem_id, nodes of a folder's i*.* files."""
    paths = connectivity_files(folder)
    rows = read_columns(spark, paths, split_bytes=split_bytes)
    return rows.select(F.col("id").alias("elem_id"), F.array(*[F.col(f"c{k}").cast("long") for k in range(len(paths))]).alias("nodes"))


def read_points(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, int]:
    """node_id, x, y, z and the number of dimensions."""
    paths = coordinate_files(folder)
    rows = read_columns(spark, paths, raw="float32", split_bytes=split_bytes)
    at = [(F.col(f"c{k}").cast("float") if k < len(paths) else F.lit(None).cast("float")).alias(c) for k, c in enumerate("xyz")]
    return rows.select(F.col("id").alias("node_id"), *at), len(paths)


def read_meta(folder: str) -> dict:
    import yaml

    return yaml.safe_load(files.text(f"{folder.rstrip('/')}/meta.yaml") or "") or {}


def read_mesh(spark: SparkSession, folder: str, use_macro: bool = False, split_bytes: int = SPLIT_BYTES) -> Mesh:
    """A single- or multi-block mesh folder; every partition reads about split_bytes of its widest column."""
    meta = read_meta(folder)
    points, dim = read_points(spark, folder, split_bytes)
    if meta.get("blocks"):
        rows, blocks = None, []
        for k, b in enumerate(meta["blocks"]):
            part = read_block(spark, os.path.join(folder, "blocks", b["name"]), split_bytes).select(F.lit(k).alias("block_id"), "elem_id", "nodes")
            rows = part if rows is None else rows.unionByName(part)
            blocks.append(Block(k, b["name"], b["element_type"]))
        mesh = Mesh(points, rows, tuple(blocks), dim)
    else:
        rows = read_block(spark, folder, split_bytes)
        kind = meta.get("element_type") or type_of_size(len(connectivity_files(folder)))
        kind = NAMES.get(kind, kind) if isinstance(kind, int) else kind
        element_type(kind)
        mesh = Mesh(points, rows.select(F.lit(0).alias("block_id"), "elem_id", "nodes"), (Block(0, "default", kind),), dim)
    if found := find_files(folder, "node_mapping.*"):
        ids = read_array(spark, found[0], raw="int64")
        mesh = replace(mesh, node_mapping=ids.select(F.col("id").alias("node_id"), F.col("value").cast("long").alias("source_id")))
    return mesh.to_macro() if use_macro else mesh


def _element_columns(spark: SparkSession, folder: str) -> DataFrame:
    """elem_id, lnode, local of a folder's i*.int16."""
    rows = read_block(spark, folder)
    return rows.select("elem_id", F.posexplode("nodes").alias("lnode", "local"))


def _led_back(long: DataFrame, block: Block) -> DataFrame:
    by = long.groupBy("elem_id").agg(F.sort_array(F.collect_list(F.struct("lnode", "node_id"))).alias("x"))
    return by.select(F.lit(block.block_id).alias("block_id"), "elem_id", F.transform("x", lambda s: s["node_id"].cast("long")).alias("nodes"))


def _starts(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    return read_array(spark, path).select(F.col("id").alias(key), F.col("value").cast("long").alias(value))


def read_packed(spark: SparkSession, folder: str) -> Mesh:
    """A folder of packs as a mesh whose nodes are numbered by packs; node_mapping leads back to the ids before."""
    meta = read_meta(folder)
    at = f"{folder}/{meta['block']}"
    coordinates = sorted(files.matching(folder, "x[0-9].*"))
    rows = read_columns(spark, coordinates, raw="float32")
    points = rows.select(F.col("id").alias("node_id"), *[(F.col(f"c{k}").cast("float") if k < len(coordinates) else F.lit(None).cast("float")).alias(c) for k, c in enumerate("xyz")])
    owned, ghost = _starts(spark, f"{at}/owned_nodes_ptr.int64", "pack", "first"), _starts(spark, f"{at}/ghost_ptr.int64", "pack", "ghosts")
    after = owned.select((F.col("pack") - 1).alias("pack"), F.col("first").alias("stop"))
    bounds = owned.join(after, "pack").join(ghost, "pack")
    long = _element_columns(spark, at).withColumn("pack", F.call_function("div", F.col("elem_id"), F.lit(int(meta["elements_per_pack"])))).join(bounds, "pack")
    beyond = F.col("local") - (F.col("stop") - F.col("first"))
    long = long.withColumn("ghost", F.when(beyond >= 0, F.col("ghosts") + beyond))
    far = _starts(spark, files.matching(at, "ghost_idx.*")[0], "ghost", "there")
    long = long.join(far, "ghost", "left").select("elem_id", "lnode", F.coalesce("there", F.col("first") + F.col("local")).alias("node_id"))
    block = Block(0, str(meta["block"]), meta["element_type"])
    back = _starts(spark, files.matching(folder, "node_map.*")[0], "node_id", "source_id")
    return Mesh(points, _led_back(long, block), (block,), int(meta["spatial_dimension"]), back)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """block_id, elem_id, nodes of a folder of fixed-size blocks, with the nodes' ids of the whole mesh."""
    meta = read_meta(folder)
    starts = _starts(spark, f"{folder}/node_offset.int64", "k", "start")
    long = _element_columns(spark, folder).withColumn("k", F.call_function("div", F.col("elem_id"), F.lit(int(meta["block_size"])))).join(starts, "k")
    back = _starts(spark, files.matching(folder, "node_mapping.*")[0], "at", "node_id")
    return _led_back(long.withColumn("at", F.col("start") + F.col("local")).join(back, "at"), Block(0, "default", meta["element_type"]))


def read_sideset(spark: SparkSession, folder: str, block_id: int = 0) -> DataFrame:
    parent, lfi = find_files(folder, "parent.*"), find_files(folder, "lfi.*")
    if not parent or not lfi:
        raise FileNotFoundError(f"{folder}: no side set")
    rows = columns_of_kinds(spark, [parent[0], lfi[0]], [dtype_of(parent[0], "int32"), dtype_of(lfi[0], "int16")])
    return rows.select(F.col("c0").cast("long").alias("parent"), F.col("c1").cast("short").alias("lfi"), F.lit(block_id).alias("block_id"))


def read_grid(spark: SparkSession, folder: str, shift: float = 0.0, scale: float = 1.0) -> tuple[DataFrame, dict]:
    """ix, iy, iz, comp, value (scale * (value + shift)) and the metadata."""
    meta = read_meta(folder)
    b = int(meta.get("block_size", 1))
    nx, ny = int(meta["nx"]), int(meta.get("ny", 1))
    rows = read_array(spark, os.path.join(folder, meta["path"]))
    at = F.call_function("div", F.col("id"), F.lit(b))
    row = F.call_function("div", at, F.lit(nx))
    return rows.select((at % nx).alias("ix"), (row % ny).alias("iy"), F.call_function("div", row, F.lit(ny)).alias("iz"), (F.col("id") % b).cast("int").alias("comp"), ((F.col("value") + shift) * scale).cast("float").alias("value")), meta


def read_mapped_field(spark: SparkSession, path: str, mapping: DataFrame, kind: str = "float64") -> DataFrame:
    """mapping: id, source -> id, value of the stored field at source."""
    field = read_array(spark, path, raw=kind)
    return mapping.join(field.withColumnRenamed("id", "source"), "source").select("id", "value")


def _counted(paths: list[str], n: int, default: str) -> list[str]:
    """The paths, once every file holds exactly n numbers of its type."""
    for p in paths:
        width = np.dtype(DTYPES[dtype_of(p, default)]).itemsize
        if files.size(p) != n * width:
            raise ValueError(f"{p}: {files.size(p)} bytes aren't {n} numbers of {width} bytes")
    return paths


def _described_columns(d: dict, part: dict, entries: str, names: list[str], count: str, default: str, base: str) -> list[str]:
    """The files that a list of {name: path} gives for the names, one entry each and in their order, with checked lengths."""
    listed = part.get(entries) or []
    for k, name in enumerate(names):
        if k >= len(listed) or name not in listed[k]:
            raise ValueError(f"entry {k} of {entries!r} has to name the file of {name!r}")
    if count not in part:
        raise ValueError(f"the description lacks {count!r}")
    return _counted([array_path(d, str(listed[k][name]), base) for k, name in enumerate(names)], int(part[count]), default)


def _described_mesh(spark: SparkSession, d: dict, base: str) -> Mesh:
    """points: a list of {x: file}, {y: file}, ... with spatial_dimension and n_nodes; elements: a list of {i0: file}, ... with
    element_type, elem_num_nodes and n_elements, for the whole mesh or within each entry of blocks beside its name."""
    dim = int(d["spatial_dimension"])
    at = read_columns(spark, _described_columns(d, d, "points", list("xyz"[:dim]), "n_nodes", "float32", base), raw="float32")
    points = at.select(F.col("id").alias("node_id"), *[(F.col(f"c{k}").cast("float") if k < dim else F.lit(None).cast("float")).alias(c) for k, c in enumerate("xyz")])
    rows, blocks = None, []
    for k, part in enumerate(d.get("blocks") or [{"name": "default"} | d]):
        if missing := [key for key in ("name", "element_type", "elem_num_nodes") if key not in part]:
            raise ValueError(f"block {k} of the description lacks {missing}")
        kind, width = element_type(str(part["element_type"])), int(part["elem_num_nodes"])
        if kind.n_nodes != width:
            raise ValueError(f"{kind.name} has {kind.n_nodes} nodes, not {width}")
        columns = read_columns(spark, _described_columns(d, part, "elements", [f"i{j}" for j in range(width)], "n_elements", "int32", base))
        own = columns.select(F.lit(k).alias("block_id"), F.col("id").alias("elem_id"), F.array(*[F.col(f"c{j}").cast("long") for j in range(width)]).alias("nodes"))
        rows = own if rows is None else rows.unionByName(own)
        blocks.append(Block(k, str(part["name"]), kind.name))
    return Mesh(points, rows, tuple(blocks), dim)


def mesh_from_description(spark: SparkSession, d: dict, base: str = ".") -> Mesh:
    """A mesh from a declaration: type cube, square (also spelt sqare), half_sphere or file. A file's declaration either names
    its arrays one by one (points, elements or blocks), whose lengths have to be those that it states, or a mesh folder."""
    from . import generate as G

    kind = d.get("type", "file")
    n = [int(d.get(k, 1)) for k in ("nx", "ny", "nz")]
    lo = [float(d.get(f"{c}min", 0)) for c in "xyz"]
    hi = [float(d.get(f"{c}max", 1)) for c in "xyz"]
    if kind == "cube":
        return G.cube(spark, d.get("element_type", "HEX8"), *n, (*lo, *hi))
    if kind in ("square", "sqare"):
        return G.square(spark, d.get("element_type", "QUAD4"), n[0], n[1], (*lo[:2], *hi[:2]))
    if kind == "half_sphere":
        return G.half_sphere(spark, d.get("element_type", "HEX8"), float(d.get("radius", 1)), *n)
    if kind == "file" and "points" in d:
        return _described_mesh(spark, d, base)
    if kind == "file":
        return read_mesh(spark, resolve_path(d, base))
    raise ValueError(f"unknown mesh type {kind!r}")


def _absolute(p: str) -> bool:
    return os.path.isabs(p) or "://" in p


def resolve_path(d: dict, base: str = ".") -> str:
    """An absolute path or URI, or one relative to where the description lies."""
    p = d.get("path") or d.get("folder")
    if not p:
        raise ValueError("the description names no path")
    return p if _absolute(p) else os.path.join(base, p)


def array_path(d: dict, p: str, base: str = ".") -> str:
    """Where an array that the description names lies: an absolute path or URI, or one in the description's folder, if it
    names one, or beside the description."""
    if _absolute(p):
        return p
    return os.path.join(resolve_path(d, base) if d.get("path") or d.get("folder") else base, p)
