"""Generators as table functions of SQL: after `register(spark)`,

    select c.* from range(4) layers, lateral hex8_layer(layers.id, 4, 4) c

is a cube of 4 * 4 * 4 cells. A layer is a call of its own, so layers spread over the tasks of the range and a call holds a row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Corners of a cell in steps along x, y and z: fixed values, as in the generators.
_CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))


@udtf(returnType="elem_id: bigint, nodes: array<bigint>")
class Hex8Layer:
    """The cells of layer z of a cube of nx * ny cells a layer."""

    def eval(self, z: int, nx: int, ny: int) -> Iterator[tuple[int, list[int]]]:
        w, h = nx + 1, (nx + 1) * (ny + 1)
        for y in range(ny):
            for x in range(nx):
                yield (z * ny + y) * nx + x, [x + a + (y + b) * w + (z + c) * h for a, b, c in _CORNERS]


@udtf(returnType="node_id: bigint, x: float, y: float, z: float")
class Hex8LayerPoints:
    """The points of layer k of such a cube between 0 and 1."""

    def eval(self, k: int, nx: int, ny: int, nz: int) -> Iterator[tuple[int, float, float, float]]:
        for j in range(ny + 1):
            for i in range(nx + 1):
                yield (k * (ny + 1) + j) * (nx + 1) + i, i * (1.0 / nx), j * (1.0 / ny), k * (1.0 / nz)


def register(spark: SparkSession) -> None:
    """hex8_layer(z, nx, ny) and hex8_layer_points(k, nx, ny, nz), for this session."""
    spark.udtf.register("hex8_layer", Hex8Layer)
    spark.udtf.register("hex8_layer_points", Hex8LayerPoints)
