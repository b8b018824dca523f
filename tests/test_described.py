import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.mesh import Block, Mesh
from tessella.operators import arrays, convert
from tessella.sources import generate as G
from tessella.sources import raw, sinks


def _key(elements):
    return sorted((r.block_id, r.elem_id, tuple(r.nodes)) for r in elements.collect())


def _two_blocks(spark):
    m = G.hex8_cube(spark, 3, 2, 1)
    tets = convert.convert_to(m, "TET4").elements.where("elem_id < 12").withColumn("block_id", F.lit(1))
    return Mesh(m.points, m.elements.unionByName(tets), (Block(0, "hexes", "HEX8"), Block(1, "tets", "TET4")))


def _description(mesh, folder):
    """The arrays of a written folder, one by one."""
    own = lambda t, n, at: {"element_type": t, "elem_num_nodes": n, "n_elements": mesh.elements.where(F.col("block_id") == at[0]).count(), "elements": [{f"i{k}": f"{at[1]}i{k}.int32"} for k in range(n)]}
    d = {"type": "file", "path": folder, "spatial_dimension": 3, "n_nodes": mesh.n_nodes(), "points": [{c: f"{c}.float32"} for c in "xyz"]}
    if len(mesh.blocks) == 1:
        return d | own("HEX8", 8, (0, ""))
    return d | {"blocks": [{"name": "hexes"} | own("HEX8", 8, (0, "blocks/hexes/")), {"name": "tets"} | own("TET4", 4, (1, "blocks/tets/"))]}


@pytest.mark.parametrize("blocks", [1, 2])
def test_arrays_that_a_description_names(spark, tmp_path, blocks):
    mesh = G.hex8_cube(spark, 3, 2, 1) if blocks == 1 else _two_blocks(spark)
    sinks.write_mesh(mesh, str(tmp_path / "m"))
    d = _description(mesh, str(tmp_path / "m"))
    for given, base in ((d, "."), (d | {"path": "m"}, str(tmp_path)), ({k: v for k, v in d.items() if k != "path"}, str(tmp_path / "m"))):
        back = raw.mesh_from_description(spark, given, base)
        assert _key(back.elements) == _key(mesh.elements) and sorted(map(tuple, back.points.collect())) == sorted(map(tuple, mesh.points.collect()))
        assert [b.elem_type for b in back.blocks] == [b.elem_type for b in mesh.blocks]


def test_descriptions_that_their_arrays_contradict(spark, tmp_path):
    mesh = G.hex8_cube(spark, 3, 2, 1)
    sinks.write_mesh(mesh, str(tmp_path))
    d = _description(mesh, str(tmp_path))
    for wrong, message in (
        ({"n_nodes": 23}, "bytes aren't 23 numbers"),
        ({"n_elements": 7}, "bytes aren't 7 numbers"),
        ({"elem_num_nodes": 4}, "8 nodes, not 4"),
        ({"points": d["points"][:2]}, "'z'"),
        ({"elements": d["elements"][::-1]}, "'i0'"),
        ({"element_type": "CUBE"}, "unknown element type"),
    ):
        with pytest.raises(ValueError, match=message):
            raw.mesh_from_description(spark, d | wrong)
    with pytest.raises(ValueError, match="lacks"):
        raw.mesh_from_description(spark, {k: v for k, v in d.items() if k != "n_elements"})


def _values(item, folder):
    """What an XDMF item refers to, read as its attributes say."""
    if item.get("ItemType") == "Function":
        n = len(item)
        assert item.get("Function") == "JOIN(" + ", ".join(f"${k}" for k in range(n)) + ")"
        return np.column_stack([_values(x, folder) for x in item])
    shape = [int(x) for x in item.get("Dimensions").split()]
    kind = {"Float": "f", "Int": "i", "UInt": "u"}[item.get("NumberType")]
    return np.fromfile(f"{folder}/{item.text}", f"<{kind}{item.get('Precision')}", int(np.prod(shape)), offset=int(item.get("Seek"))).reshape(shape)


@pytest.mark.parametrize("blocks", [1, 2])
def test_xdmf_of_a_mesh_with_fields(spark, tmp_path, blocks):
    mesh = G.hex8_cube(spark, 3, 2, 1) if blocks == 1 else _two_blocks(spark)
    at = str(tmp_path)
    sinks.write_mesh(mesh, at, index="int64", real="float64")
    n, total = mesh.n_nodes(), mesh.n_elements()
    sinks.write_array(spark.range(n * 3).select("id", (F.col("id") * 0.5).alias("value")), f"{at}/velocity.float64")
    sinks.write_array(spark.range(total).select("id", (F.col("id") * 7).alias("value")), f"{at}/mark.int32")
    path = sinks.write_mesh_xdmf(at, {"velocity": ("velocity.float64", "node"), 'a "mark" & more': ("mark.int32", "element")})
    root = ET.parse(path).getroot()
    grids = [g for g in root.iter("Grid") if g.get("GridType") == "Uniform"]
    assert [g.get("Name") for g in grids] == (["default"] if blocks == 1 else ["hexes", "tets"])
    points = [tuple(r) for r in mesh.points.orderBy("node_id").select("x", "y", "z").collect()]
    first = 0
    for block, grid in zip(mesh.blocks, grids):
        own = [r.nodes for r in mesh.elements.where(F.col("block_id") == block.block_id).orderBy("elem_id").collect()]
        assert grid.find("Topology").get("TopologyType") == {"HEX8": "Hexahedron", "TET4": "Tetrahedron"}[block.elem_type]
        assert _values(grid.find("Topology")[0], at).tolist() == own
        assert list(map(tuple, _values(grid.find("Geometry")[0], at).tolist())) == points
        velocity, mark = grid.findall("Attribute")
        assert velocity.get("AttributeType") == "Vector" and _values(velocity[0], at).tolist() == (np.arange(n * 3).reshape(n, 3) * 0.5).tolist()
        assert mark.get("Name") == 'a "mark" & more' and mark.get("Center") == "Cell"
        assert _values(mark[0], at).tolist() == [7 * k for k in range(first, first + len(own))]
        first += len(own)
    with pytest.raises(ValueError, match="same number"):
        sinks.write_mesh_xdmf(at, {"velocity": ("mark.int32", "node")})


def test_coarse_entries_keep_their_order(spark):
    rows = [(5, 3, 1.0), (0, 9, 2.0), (2, 4, 3.0), (7, None, 4.0), (9, 3, None)]
    got = arrays.coarse_entries(spark.createDataFrame(rows, "id long, index long, value double"), 4)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(0, 4, 3.0), (1, 3, 1.0), (2, 3, None)]
    assert arrays.coarse_entries(got.limit(0), 4).count() == 0
