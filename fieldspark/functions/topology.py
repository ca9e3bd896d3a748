"""Element shapes: how many nodes a superclass has, and their edges, faces and triangles."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Shape:
    """``nodes`` is how many a connectivity row names, ``corners`` how many of them span the element."""

    code: int
    nodes: int
    corners: int = -1
    edges: tuple[tuple[int, int], ...] = ()
    faces: tuple[tuple[int, ...], ...] = ()
    #: How the connectivity is stored: nodes, material and part.
    words: int = field(default=-1)

    def around(self) -> list[list[int]]:
        """For each corner, those that share an edge with it."""
        return [sorted({b for a, b in self.edges if a == k} | {a for a, b in self.edges if b == k}) for k in range(self.spanning)]

    @property
    def spanning(self) -> int:
        return self.nodes if self.corners < 0 else self.corners

    def triangles(self) -> list[tuple[int, int, int]]:
        """Each face as a fan around its first corner."""
        return [(f[0], f[k], f[k + 1]) for f in self.faces for k in range(1, len(f) - 1)]


def _ring(n: int) -> tuple[tuple[int, int], ...]:
    return tuple((k, (k + 1) % n) for k in range(n))


#: Codes, node counts, corners and the order of a hexahedron's six faces (fixed values). A hexahedron has 0-3 below and 4-7 above them.
SHAPES = {
    "UNIT": Shape(0, 0),
    "NODE": Shape(1, 0),
    "TRUSS": Shape(2, 2, edges=((0, 1),)),
    "BEAM": Shape(3, 3, corners=2, edges=((0, 1),)),
    "TRI": Shape(4, 3, edges=_ring(3), faces=((0, 1, 2),)),
    "QUAD": Shape(5, 4, edges=_ring(4), faces=((0, 1, 2, 3),)),
    "TET": Shape(6, 4, edges=(*_ring(3), (0, 3), (1, 3), (2, 3)), faces=((0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2))),
    "PYRAMID": Shape(7, 5, edges=(*_ring(4), (0, 4), (1, 4), (2, 4), (3, 4)), faces=((0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4))),
    "WEDGE": Shape(8, 6, edges=(*_ring(3), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)), faces=((0, 2, 1), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5))),
    "HEX": Shape(9, 8, edges=(*_ring(4), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)), faces=((1, 2, 6, 5), (2, 3, 7, 6), (0, 4, 7, 3), (1, 5, 4, 0), (4, 5, 6, 7), (0, 3, 2, 1))),
    "MAT": Shape(10, 0),
    "MESH": Shape(11, 0),
    "SURFACE": Shape(12, 0),
    "PARTICLE": Shape(13, 1),
    "TET10": Shape(14, 10),
    "INODE": Shape(15, 1),
}
CODES = {s.code: name for name, s in SHAPES.items()}


def shape(superclass: int | str) -> Shape:
    return SHAPES[CODES[superclass] if isinstance(superclass, int) else superclass]
