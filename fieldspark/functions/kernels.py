"""Kernels as Columns, all within code generation. Divisions by zero follow IEEE: NaN or an infinity, never an error."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

STRESS = ("sx", "sy", "sz", "sxy", "syz", "szx")
STRAIN = ("ex", "ey", "ez", "exy", "eyz", "ezx")


def divide(a: Column, b: Column) -> Column:
    inf = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    return F.when(b == 0, inf).otherwise(F.try_divide(a, b))


def pressure(x: Column, y: Column, z: Column) -> Column:
    return -(x + y + z) / 3.0


def j2(x: Column, y: Column, z: Column, xy: Column, yz: Column, zx: Column) -> Column:
    p = pressure(x, y, z)
    return 0.5 * ((x + p) ** 2 + (y + p) ** 2 + (z + p) ** 2) + xy * xy + yz * yz + zx * zx


def effective(*s: Column) -> Column:
    """Von Mises: the root of three times the second invariant of the deviator."""
    return F.sqrt(3.0 * j2(*s))


def triaxiality(*s: Column) -> Column:
    return divide(-pressure(*s[:3]), effective(*s))


def normalized_pressure(*s: Column) -> Column:
    return divide(pressure(*s[:3]), effective(*s))


def principal(*s: Column) -> list[Column]:
    """Eigenvalues of the symmetric tensor, largest first, in closed form; the acos argument is clamped."""
    x, y, z, xy, yz, zx = s
    q = (x + y + z) / 3.0
    a, b, c = x - q, y - q, z - q
    p = F.sqrt((a * a + b * b + c * c + 2.0 * (xy * xy + yz * yz + zx * zx)) / 6.0)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * zx) + zx * (xy * yz - b * zx)
    r = F.when(p == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det, 2.0 * p * p * p))))
    phi = F.acos(r) / 3.0
    first = q + 2.0 * p * F.cos(phi)
    third = q + 2.0 * p * F.cos(phi + 2.0 * math.pi / 3.0)
    return [first, 3.0 * q - first - third, third]


def principal_deviatoric(*s: Column) -> list[Column]:
    q = (s[0] + s[1] + s[2]) / 3.0
    return [e - q for e in principal(*s)]


def max_shear(*s: Column) -> Column:
    first, _, third = principal(*s)
    return 0.5 * (first - third)


def principal_alternate(*s: Column, deviatoric: bool = False) -> list[Column]:
    """Closed form over the invariants; 0 where the second one is under 1e-12, even with the mean added."""
    x, y, z, xy, yz, zx = s
    h = (x + y + z) / 3.0
    a, b, c = x - h, y - h, z - h
    two = j2(*s)
    three = a * (b * c - yz * yz) - xy * (xy * c - yz * zx) + zx * (xy * yz - b * zx)
    safe = F.when(two < 1e-12, F.lit(1.0)).otherwise(two)
    alpha = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * F.sqrt(27.0 / safe) * three / safe))
    theta = F.acos(alpha) / 3.0
    radius = 2.0 * F.sqrt(safe / 3.0)
    turned = [radius * F.cos(theta + t) for t in (0.0, -2.0 * math.pi / 3.0, 2.0 * math.pi / 3.0)]
    # a NaN ranks above all numbers here, and is no invariant to go by: it gives 0 as well
    return [F.when((two < 1e-12) | F.isnan(two), F.lit(0.0)).otherwise(e if deviatoric else e + h) for e in turned]


def magnitude(*c: Column) -> Column:
    return F.sqrt(sum((x * x for x in c[1:]), c[0] * c[0]))


# geometry: points are triples of Columns


def minus(a, b):
    return tuple(x - y for x, y in zip(a, b, strict=True))


def plus(a, b):
    return tuple(x + y for x, y in zip(a, b, strict=True))


def cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def tet_volume(n) -> Column:
    return dot(minus(n[3], n[0]), cross(minus(n[1], n[0]), minus(n[2], n[0]))) / 6.0


def hex_volume(n) -> Column:
    """Volume of a trilinear hexahedron by the divergence theorem: a flux through each of the six faces."""
    six = F.lit(0.0)
    for face in ((0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7), (4, 5, 6, 7), (0, 3, 2, 1)):
        a, b, c, d = (n[i] for i in face)
        six = six + dot(plus(plus(a, b), plus(c, d)), cross(minus(c, a), minus(d, b)))
    return six / 24.0


def quad_area(n) -> Column:
    """Half the root of e g - f f for the sums and differences along the two directions."""
    u = minus(plus(n[1], n[2]), plus(n[0], n[3]))
    v = minus(plus(n[2], n[3]), plus(n[0], n[1]))
    return F.sqrt((dot(u, u) * dot(v, v) - dot(u, v) ** 2) / 16.0)


def jacobian(n) -> Column:
    """Determinant of the trilinear map's gradient at the middle of a hexahedron."""

    def along(plus_nodes, minus_nodes):
        up, down = n[plus_nodes[0]], n[minus_nodes[0]]
        for i, j in zip(plus_nodes[1:], minus_nodes[1:], strict=True):
            up, down = plus(up, n[i]), plus(down, n[j])
        return tuple(x / 8.0 for x in minus(up, down))

    r = along((1, 2, 5, 6), (0, 3, 4, 7))
    s = along((2, 3, 6, 7), (0, 1, 4, 5))
    t = along((4, 5, 6, 7), (0, 1, 2, 3))
    return dot(r, cross(s, t))


def scaled(a, k):
    return tuple(x * k for x in a)


def unit(a):
    size = F.sqrt(dot(a, a))
    return tuple(divide(x, size) for x in a)


def surface_strain(df: DataFrame, now, then) -> tuple[DataFrame, dict[str, Column]]:
    """Global components of the strain in a four-cornered face, from the displacements of its corners, and ``df`` with the columns that they are of.

    The frame is of the deformed face: its normal, the first edge made orthogonal to that, and their product. In the
    plane, displacement gradients along the face's two directions are turned to the frame's by the inverse of the 2 x 2
    Jacobian; the symmetric part, without anything out of the plane, is turned to the axes. Each step is columns of its
    own, as later ones use them many times.
    """

    def held(name: str, vector):
        nonlocal df
        df = df.withColumns({f"__{name}{i}": c for i, c in enumerate(vector)})
        return tuple(F.col(f"__{name}{i}") for i in range(len(vector)))

    def along(p, positive, negative):
        a, b = (plus(p[i], p[j]) for i, j in (positive, negative))
        return scaled(minus(a, b), 0.25)

    xi, eta = ((1, 2), (0, 3)), ((3, 2), (0, 1))
    moved = [minus(a, b) for a, b in zip(now, then, strict=True)]
    one, two = held("one", along(now, *xi)), held("two", along(now, *eta))
    u_xi, u_eta = held("uxi", along(moved, *xi)), held("ueta", along(moved, *eta))
    normal = held("normal", unit(held("cross", cross(one, two))))
    edge = held("edge", minus(now[1], now[0]))
    first = held("first", unit(held("flat", minus(edge, scaled(normal, dot(edge, normal))))))
    second = held("second", cross(normal, first))
    a, b, c, d = held("jacobian", (dot(first, one), dot(first, two), dot(second, one), dot(second, two)))
    (det,) = held("det", (a * d - b * c,))
    fu, fv, su, sv = held("along", (dot(first, u_xi), dot(first, u_eta), dot(second, u_xi), dot(second, u_eta)))
    xx, shear, yy = held("strain", (divide(fu * d - fv * c, det), 0.5 * (divide(fv * a - fu * b, det) + divide(su * d - sv * c, det)), divide(sv * a - su * b, det)))

    def turned(i: int, j: int) -> Column:
        return first[i] * first[j] * xx + second[i] * second[j] * yy + (first[i] * second[j] + second[i] * first[j]) * shear

    return df, {"x": turned(0, 0), "y": turned(1, 1), "z": turned(2, 2), "xy": turned(0, 1), "yz": turned(1, 2), "zx": turned(2, 0)}


def colour(value: Column, lo: Column, hi: Column, stops: list[tuple[float, float, float]]) -> list[Column]:
    """Red, green and blue by linear interpolation between equally spaced stops; a range without width gives the middle."""
    t = F.when(hi == lo, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - lo, hi - lo))))
    place = t * (len(stops) - 1)
    i = F.least(F.floor(place), F.lit(len(stops) - 2)).cast("int")
    out = []
    for k in range(3):
        table = F.array(*[F.lit(s[k]) for s in stops])
        a, b = F.element_at(table, i + 1), F.element_at(table, i + 2)
        out.append(a + (b - a) * (place - i))
    return out


def levels(count: int, lo: Column, hi: Column) -> Column:
    """``count`` levels strictly between lo and hi."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: lo + (hi - lo) * i / (count + 1.0))
