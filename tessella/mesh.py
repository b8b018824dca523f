"""A mesh as tables: points, elements and its blocks' names and types."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from .functions.elem_types import element_type


def unfolded(long: DataFrame) -> DataFrame:
    """Rows made from arrays, never broadcast: Spark takes such a table to be as small as the (compressed) rows it comes from."""
    return long.hint("merge")


def at_points(long: DataFrame, points: DataFrame) -> DataFrame:
    """long (a row for each node of each element) with its nodes' coordinates. Hash tables are made of the points alone, of which
    every node has one, and long isn't sorted."""
    return long.join(points.hint("shuffle_hash"), "node_id")


def by_element(long: DataFrame, *parts: str) -> GroupedData:
    """Groups of an element's (or its parts') rows, dealt as they are: before that hardly two of them meet, and partial sums are
    wider than the rows."""
    return long.repartition("elem_id").groupBy("block_id", "elem_id", *parts)


@dataclass(frozen=True)
class Block:
    block_id: int
    name: str
    elem_type: str


@dataclass(frozen=True)
class Mesh:
    """points: node_id, x, y, z (y and z null where the space has fewer dimensions); elements: block_id, elem_id (within
    the block), nodes; node_mapping: node_id, source_id where the mesh was cut out of another."""

    points: DataFrame
    elements: DataFrame
    blocks: tuple[Block, ...]
    dim: int = 3
    node_mapping: DataFrame | None = None
    #: Of a lattice: its elements, and the same rows with `firsts` (see `lattice.entity_of`). They hold while the elements are those.
    told: tuple[DataFrame, DataFrame] | None = None

    def first_rows(self) -> DataFrame | None:
        """block_id, elem_id, nodes, firsts (which of its corners, edges and sides no element before has), where that is known."""
        return self.told[1] if self.told and self.told[0] is self.elements else None

    @property
    def spark(self) -> SparkSession:
        return self.elements.sparkSession

    @property
    def elem_type(self) -> str:
        if len(self.blocks) != 1:
            raise ValueError("the mesh has several blocks")
        return self.blocks[0].elem_type

    def block_table(self) -> DataFrame:
        return self.spark.createDataFrame([(b.block_id, b.name, b.elem_type, element_type(b.elem_type).n_nodes) for b in self.blocks], "block_id int, name string, elem_type string, n_nodes_per_elem int")

    def find_block(self, name: str) -> Block | None:
        return next((b for b in self.blocks if b.name == name), None)

    def ids_of(self, names: list[str] | None) -> list[int]:
        return [b.block_id for b in self.blocks if not names or b.name in names]

    def add_block(self, name: str, elem_type: str, elements: DataFrame) -> Mesh:
        """elements: elem_id, nodes."""
        k = max((b.block_id for b in self.blocks), default=-1) + 1
        rows = elements.select(F.lit(k).alias("block_id"), "elem_id", "nodes")
        return replace(self, elements=self.elements.unionByName(rows), blocks=(*self.blocks, Block(k, name, elem_type)))

    def remove_block(self, name: str) -> Mesh:
        gone = [b.block_id for b in self.blocks if b.name == name]
        return replace(self, elements=self.elements.where(~F.col("block_id").isin(gone)), blocks=tuple(b for b in self.blocks if b.name != name))

    def with_type(self, elem_type: str) -> Mesh:
        """Relabel a single block."""
        return replace(self, blocks=(replace(self.blocks[0], elem_type=elem_type),))

    def to_macro(self) -> Mesh:
        """TET10 and TRI6 blocks seen as macro elements."""
        return replace(self, blocks=tuple(replace(b, elem_type=element_type(b.elem_type).macro or b.elem_type) for b in self.blocks))

    def incidence(self) -> DataFrame:
        """block_id, elem_id, lnode, node_id."""
        return unfolded(self.elements.select("block_id", "elem_id", F.posexplode("nodes").alias("lnode", "node_id")))

    def n_nodes(self) -> int:
        return self.points.count()

    def n_elements(self) -> int:
        return self.elements.count()

    def bounding_box(self) -> DataFrame:
        cols = [f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))]
        return self.points.agg(*cols)

    def max_node_id(self) -> DataFrame:
        return self.elements.agg(F.max(F.array_max("nodes")).alias("max_node_id"))

    def describe(self) -> DataFrame:
        """One row a block: name, type, number of elements."""
        n = self.elements.groupBy("block_id").agg(F.count("*").alias("n_elements"))
        return self.block_table().join(n, "block_id", "left").fillna(0, ["n_elements"])
