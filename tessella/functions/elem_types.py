"""Element types: codes, sizes, sides and the fixed local tables of each type."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# Type codes that mesh folders and element counts rely on.
CODES = {
    "NODE1": 1, "EDGE2": 2, "EDGE3": 11, "EDGESHELL2": 101, "EDGESHELL3": 111, "BEAM2": 100002,
    "TRI3": 3, "TRI6": 6, "TRI10": 1010, "TRISHELL3": 103, "TRISHELL6": 106, "TRISHELL10": 110,
    "QUAD4": 40, "QUAD9": 9, "QUADSHELL4": 140, "QUADSHELL9": 149,
    "TET4": 4, "TET10": 10, "TET15": 15, "TET20": 20, "HEX8": 8, "HEX27": 27, "WEDGE6": 1006,
    "MACRO_TRI3": 203, "MACRO_TRISHELL3": 303, "MACRO_TET4": 204,
}
LEVELS = (1, 2, 3, 4, 5, 6, 7, 8, 16)


def proteus_hex(level: int) -> str:
    return f"PROTEUS_HEX{(level + 1) ** 3}"


def proteus_quad(level: int, shell: bool = False) -> str:
    return f"PROTEUS_QUAD{'SHELL' if shell else ''}{(level + 1) ** 2}"


for _l in LEVELS:
    CODES[proteus_hex(_l)] = 100008 if _l == 1 else (_l + 1) ** 3 * 10_000
    CODES[proteus_quad(_l)] = (_l + 1) ** 2 * 100_000
    CODES[proteus_quad(_l, True)] = (_l + 1) ** 2 * 100_000 + 1
NAMES = {c: n for n, c in CODES.items()}

# Nodes, sides and dimension by type; None where a type has no such number.
_SIZES = {
    "NODE1": (1, None, None), "EDGE2": (2, 2, 1), "EDGE3": (3, 2, 1), "EDGESHELL2": (2, 2, 1), "EDGESHELL3": (3, 2, 1), "BEAM2": (None, None, None),
    "TRI3": (3, 3, 2), "TRI6": (6, 3, 2), "TRI10": (None, None, None), "TRISHELL3": (3, 3, None), "TRISHELL6": (6, None, None), "TRISHELL10": (None, None, None),
    "QUAD4": (4, 4, 2), "QUAD9": (9, 4, 2), "QUADSHELL4": (4, 4, 2), "QUADSHELL9": (9, 4, 2),
    "TET4": (4, 4, 3), "TET10": (10, 4, 3), "TET15": (15, 4, 3), "TET20": (20, 4, 3), "HEX8": (8, 6, 3), "HEX27": (27, 6, 3), "WEDGE6": (6, 5, 3),
    "MACRO_TRI3": (6, 3, 2), "MACRO_TRISHELL3": (None, None, None), "MACRO_TET4": (10, 4, 3),
}
_SIDE = {"TRI3": "EDGE2", "QUAD4": "EDGE2", "QUAD9": "EDGE3", "QUADSHELL9": "EDGE3", "TRI6": "EDGE3", "TET4": "TRI3", "TET10": "TRI6", "TET20": "TRI10", "EDGE2": "NODE1", "EDGE3": "NODE1", "EDGESHELL2": "NODE1", "EDGESHELL3": "NODE1", "TRISHELL3": "BEAM2", "QUADSHELL4": "BEAM2", "MACRO_TET4": "MACRO_TRI3", "HEX8": "QUAD4", "HEX27": "QUAD9"}
_SHELL = {"TRI3": "TRISHELL3", "MACRO_TRI3": "MACRO_TRISHELL3", "TRI6": "TRISHELL6", "TRI10": "TRISHELL10", "TRISHELL3": "TRISHELL3", "TRISHELL6": "TRISHELL6", "TRISHELL10": "TRISHELL10", "EDGE2": "EDGESHELL2", "EDGE3": "EDGESHELL3", "EDGESHELL2": "EDGESHELL2", "EDGESHELL3": "EDGESHELL3", "BEAM2": "BEAM2", "QUAD4": "QUADSHELL4", "QUADSHELL4": "QUADSHELL4", "QUAD9": "QUADSHELL9", "QUADSHELL9": "QUADSHELL9"}
_LOWER = {"TRI6": "TRI3", "QUAD9": "QUAD4", "TET10": "TET4", "HEX27": "HEX8", "TET20": "TET10", "EDGE3": "EDGE2", "EDGESHELL3": "EDGESHELL2"}
_HIGHER = {"TRI3": "TRI6", "QUAD4": "QUAD9", "TET4": "TET10", "HEX8": "HEX27", "TET10": "TET20", "EDGE2": "EDGE3", "EDGESHELL2": "EDGESHELL3"}
_MACRO = {"TET10": "MACRO_TET4", "TRI6": "MACRO_TRI3"}
_MACRO_BASE = {"MACRO_TET4": "TET4", "MACRO_TRI3": "TRI3", "TET10": "TET4", "TRI6": "TRI3"}
SECOND_ORDER = frozenset(("TET10", "TRI6", "QUAD9", "EDGE3", "EDGESHELL3", "HEX27"))
#: Side names of the hexahedron, by local side.
HEX8_SIDES = ("FRONT", "RIGHT", "BACK", "LEFT", "BOTTOM", "TOP")


class ElementType(NamedTuple):
    name: str
    code: int
    n_nodes: int | None
    n_sides: int | None
    dim: int | None
    side_type: str | None
    shell_type: str | None
    lower: str | None
    higher: str | None
    macro: str | None
    macro_base: str | None
    second_order: bool
    semistructured: bool
    level: int | None


def _lattice(name: str, level: int) -> ElementType:
    """A semistructured type; levels without a code of their own follow the same rule."""
    n = level + 1
    h, q, qs = proteus_hex(level), proteus_quad(level), proteus_quad(level, True)
    if name == h:
        return ElementType(h, CODES.get(h, n**3 * 10_000), n**3, 6, 3, q, qs, None, None, None, "PROTEUS_HEX8", False, True, level)
    return ElementType(name, CODES.get(name, n**2 * 100_000 + (name == qs)), n**2, 4, 2, None, qs, None, None, None, None, False, True, level)


def _all() -> dict[str, ElementType]:
    out = {}
    for name, (n, s, d) in _SIZES.items():
        out[name] = ElementType(name, CODES[name], n, s, d, _SIDE.get(name), _SHELL.get(name), _LOWER.get(name), _HIGHER.get(name), _MACRO.get(name), _MACRO_BASE.get(name), name in SECOND_ORDER, False, None)
    for level in LEVELS:
        for name in (proteus_hex(level), proteus_quad(level), proteus_quad(level, True)):
            out[name] = _lattice(name, level)
    return out


TYPES = _all()


def element_type(name: str) -> ElementType:
    if name not in TYPES and (m := re.fullmatch(r"PROTEUS_(HEX|QUAD|QUADSHELL)(\d+)", name)):
        level = round(int(m[2]) ** (1 / 3 if m[1] == "HEX" else 1 / 2)) - 1
        if level > 0 and name in (proteus_hex(level), proteus_quad(level), proteus_quad(level, True)):
            return _lattice(name, level)
    if name not in TYPES:
        raise ValueError(f"unknown element type {name!r}")
    return TYPES[name]


def type_of_size(n_nodes: int) -> str:
    """The type of a folder without metadata: classic codes equal the number of columns."""
    if n_nodes not in NAMES:
        raise ValueError(f"no element type has {n_nodes} connectivity columns by default")
    return NAMES[n_nodes]


# Local nodes of each side. Corners come first, then mid-edge and mid-face nodes.
_TET = ((0, 1, 3), (1, 2, 3), (0, 3, 2), (0, 2, 1))
_TET_MIDS = ((4, 8, 7), (5, 9, 8), (7, 9, 6), (6, 5, 4))
_HEX = ((0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7), (3, 2, 1, 0), (4, 5, 6, 7))
_HEX_MIDS = ((8, 17, 12, 16, 20), (9, 18, 13, 17, 21), (10, 19, 14, 18, 22), (11, 16, 15, 19, 23), (10, 9, 8, 11, 24), (12, 13, 14, 15, 25))
SIDES: dict[str, tuple[tuple[int, ...], ...]] = {
    "EDGE2": ((0,), (1,)),
    "TRI3": ((0, 1), (1, 2), (2, 0)),
    "TRI6": ((0, 1, 3), (1, 2, 4), (2, 0, 5)),
    "QUAD4": ((0, 1), (1, 2), (2, 3), (3, 0)),
    "QUAD9": ((0, 1, 4), (1, 2, 5), (2, 3, 6), (3, 0, 7)),
    "TET4": _TET,
    "TET10": tuple(a + b for a, b in zip(_TET, _TET_MIDS)),
    "HEX8": _HEX,
    "HEX27": tuple(a + b for a, b in zip(_HEX, _HEX_MIDS)),
    "WEDGE6": ((0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5), (0, 2, 1), (3, 4, 5)),
}
for _shell, _base in (("TRISHELL3", "TRI3"), ("TRISHELL6", "TRI6"), ("QUADSHELL4", "QUAD4"), ("QUADSHELL9", "QUAD9"), ("MACRO_TET4", "TET10"), ("MACRO_TRI3", "TRI6"), ("TET15", "TET10")):
    SIDES[_shell] = SIDES[_base]
#: Geometric edges by pairs of local corners, in the order that mid-edge nodes have.
EDGES: dict[str, tuple[tuple[int, int], ...]] = {
    "TRI3": ((0, 1), (1, 2), (0, 2)),
    "TET4": ((0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3)),
    "QUAD4": ((0, 1), (1, 2), (2, 3), (3, 0)),
    "HEX8": ((0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 5), (2, 6), (3, 7), (4, 5), (5, 6), (6, 7), (7, 4)),
}
EDGES |= {"TRISHELL3": EDGES["TRI3"], "QUADSHELL4": EDGES["QUAD4"]}


def hex_corner(level: int, corner: int) -> int:
    """Lattice index of a hexahedron's corner in an element of this level."""
    x, y, z = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))[corner]
    return lattice_index(level, x * level, y * level, z * level)


def lattice_index(level: int, x: int, y: int, z: int = 0) -> int:
    return (z * (level + 1) + y) * (level + 1) + x


def corners(name: str) -> tuple[int, ...]:
    """Local nodes of the linear element inside any type, in the linear type's order."""
    t = element_type(name)
    if t.semistructured and t.dim == 3:
        return tuple(hex_corner(t.level, k) for k in range(8))
    if t.semistructured:
        n = t.level
        return (0, n, lattice_index(n, n, n), lattice_index(n, 0, n))
    base = linear(name)
    return tuple(range(element_type(base).n_nodes))


def linear(name: str) -> str:
    """The linear type with the same corners."""
    t = element_type(name)
    if t.semistructured:
        return "HEX8" if t.dim == 3 else "QUADSHELL4" if "SHELL" in name else "QUAD4"
    return {"TET10": "TET4", "TET15": "TET4", "TET20": "TET4", "MACRO_TET4": "TET4", "TRI6": "TRI3", "TRI10": "TRI3", "MACRO_TRI3": "TRI3", "TRISHELL6": "TRISHELL3", "QUAD9": "QUAD4", "QUADSHELL9": "QUADSHELL4", "HEX27": "HEX8", "EDGE3": "EDGE2"}.get(name, name)


def side_table(name: str) -> tuple[tuple[int, ...], ...]:
    """Local nodes of every side, whole lattices for semistructured types."""
    t = element_type(name)
    if t.semistructured and t.dim == 3:
        return tuple(lattice_side(t.level, s) for s in range(6))
    if t.semistructured:
        n = t.level
        walk = lambda f: tuple(lattice_index(n, *f(i)) for i in range(n + 1))
        return (walk(lambda i: (i, 0)), walk(lambda i: (n, i)), walk(lambda i: (n - i, n)), walk(lambda i: (0, n - i)))
    if name not in SIDES:
        raise ValueError(f"{name} has no side table")
    return SIDES[name]


def lattice_side(level: int, side: int) -> tuple[int, ...]:
    """The (level + 1)^2 lattice nodes of a hexahedron's side, first axis from its first corner to its second."""
    at = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
    o, u, _, v = (at[c] for c in _HEX[side])
    step = lambda a, b, i: (b - a) * i
    return tuple(lattice_index(level, *(o[d] * level + step(o[d], u[d], i) + step(o[d], v[d], j) for d in range(3))) for j in range(level + 1) for i in range(level + 1))


def elem_types(spark: SparkSession) -> DataFrame:
    """The dimension table of all types."""
    return spark.createDataFrame(list(TYPES.values()), "name string, code long, n_nodes int, n_sides int, dim int, side_type string, shell_type string, lower string, higher string, macro string, macro_base string, second_order boolean, semistructured boolean, level int")


def side_tables(spark: SparkSession) -> DataFrame:
    rows = [(n, s, k, v) for n, t in SIDES.items() for s, side in enumerate(t) for k, v in enumerate(side)]
    return spark.createDataFrame(rows, "elem_type string, lfi int, k int, lnode int")
