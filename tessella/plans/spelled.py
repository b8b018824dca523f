"""Fixed values that SQL uses, spelt out here so that no query shares the implementation's tables: a wrong table fails.

Local nodes of every side and edge, and of the parts that an element is cut into.
"""

from __future__ import annotations

SIDES = {
    "EDGE2": ((0,), (1,)),
    "TRI3": ((0, 1), (1, 2), (2, 0)),
    "TRISHELL3": ((0, 1), (1, 2), (2, 0)),
    "TRI6": ((0, 1, 3), (1, 2, 4), (2, 0, 5)),
    "TRISHELL6": ((0, 1, 3), (1, 2, 4), (2, 0, 5)),
    "MACRO_TRI3": ((0, 1, 3), (1, 2, 4), (2, 0, 5)),
    "QUAD4": ((0, 1), (1, 2), (2, 3), (3, 0)),
    "QUADSHELL4": ((0, 1), (1, 2), (2, 3), (3, 0)),
    "QUAD9": ((0, 1, 4), (1, 2, 5), (2, 3, 6), (3, 0, 7)),
    "QUADSHELL9": ((0, 1, 4), (1, 2, 5), (2, 3, 6), (3, 0, 7)),
    "TET4": ((0, 1, 3), (1, 2, 3), (0, 3, 2), (0, 2, 1)),
    "TET10": ((0, 1, 3, 4, 8, 7), (1, 2, 3, 5, 9, 8), (0, 3, 2, 7, 9, 6), (0, 2, 1, 6, 5, 4)),
    "TET15": ((0, 1, 3, 4, 8, 7), (1, 2, 3, 5, 9, 8), (0, 3, 2, 7, 9, 6), (0, 2, 1, 6, 5, 4)),
    "MACRO_TET4": ((0, 1, 3, 4, 8, 7), (1, 2, 3, 5, 9, 8), (0, 3, 2, 7, 9, 6), (0, 2, 1, 6, 5, 4)),
    "HEX8": ((0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7), (3, 2, 1, 0), (4, 5, 6, 7)),
    "HEX27": (
        (0, 1, 5, 4, 8, 17, 12, 16, 20), (1, 2, 6, 5, 9, 18, 13, 17, 21), (2, 3, 7, 6, 10, 19, 14, 18, 22),
        (3, 0, 4, 7, 11, 16, 15, 19, 23), (3, 2, 1, 0, 10, 9, 8, 11, 24), (4, 5, 6, 7, 12, 13, 14, 15, 25),
    ),
    "WEDGE6": ((0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5), (0, 2, 1), (3, 4, 5)),
}
EDGES = {
    "TRI3": ((0, 1), (1, 2), (0, 2)),
    "QUAD4": ((0, 1), (1, 2), (2, 3), (3, 0)),
    "TET4": ((0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3)),
    "HEX8": ((0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 5), (2, 6), (3, 7), (4, 5), (5, 6), (6, 7), (7, 4)),
}
HEX8_TO_TET4 = ((0, 1, 3, 7), (0, 1, 7, 5), (0, 4, 5, 7), (1, 2, 3, 6), (1, 3, 7, 6), (1, 5, 6, 7))
WEDGE6_TO_TET4 = ((0, 1, 2, 3), (1, 4, 5, 3), (2, 1, 5, 3))
QUAD4_TO_TRI3 = ((0, 1, 2), (0, 2, 3))
TET10_TO_TET4 = ((0, 4, 6, 7), (4, 1, 5, 8), (6, 5, 2, 9), (7, 8, 9, 3), (4, 5, 6, 8), (7, 4, 6, 8), (6, 5, 9, 8), (7, 6, 9, 8))
HEX8_SIDE_NAMES = ("FRONT", "RIGHT", "BACK", "LEFT", "BOTTOM", "TOP")
#: A cube's cell as twelve tetrahedra: its faces, each cut in two.
CELL_FACES = ((0, 1, 2, 3), (4, 7, 6, 5), (0, 4, 5, 1), (3, 2, 6, 7), (0, 3, 7, 4), (1, 5, 6, 2))
