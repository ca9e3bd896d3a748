"""Surfaces of elements: triangles, edges, hulls, normals, creases, picking and clipping by a plane.

``elements`` has (class, label, superclass, nodes, material), ``points`` (node, x, y, z). Tables of corners are fixed by
the shape and go into the plan; points meet corners once, by node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import kernels as K, topology


def _table(parts: dict[str, list[tuple[int, ...]]]) -> Column:
    """An array of corner lists by superclass."""
    out = None
    for name, rows in parts.items():
        if rows:
            own = F.array(*[F.array(*map(F.lit, r)) for r in rows])
            out = F.when(F.col("superclass") == name, own) if out is None else out.when(F.col("superclass") == name, own)
    return out


def _each(elements: DataFrame, parts: dict[str, list[tuple[int, ...]]], name: str) -> DataFrame:
    """One row for each corner list, its nodes in ``name`` and its number from 0 in ``part``."""
    out = elements.select("class", "label", "material", "nodes", F.posexplode(_table(parts)).alias("part", "corners"))
    return out.select("class", "label", "material", "part", F.transform("corners", lambda i: F.element_at("nodes", i + 1)).alias(name))


def triangles(elements: DataFrame) -> DataFrame:
    """(class, label, material, part, tri): each face as a fan."""
    return _each(elements, {n: s.triangles() for n, s in topology.SHAPES.items()}, "tri")


def element_edges(elements: DataFrame) -> DataFrame:
    """(class, label, material, part, edge): the edges of each element, shared ones once for each."""
    return _each(elements, {n: list(s.edges) for n, s in topology.SHAPES.items()}, "edge")


def neighbours(elements: DataFrame, nodes: list[int]) -> DataFrame:
    """Nodes that share an element's edge with any of ``nodes``, in elements of every class; not these themselves."""
    ends = element_edges(elements).select(F.col("edge")[0].alias("a"), F.col("edge")[1].alias("b"))
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where(F.col("a").isin(nodes) & ~F.col("b").isin(nodes)).select(F.col("b").alias("node")).distinct()


def faces(elements: DataFrame) -> DataFrame:
    return _each(elements, {n: list(s.faces) for n, s in topology.SHAPES.items()}, "face")


def shared_faces(elements: DataFrame) -> DataFrame:
    """(key, shared, class, label, part): a face by its sorted nodes, how many elements have it, and its first owner; one that two or more have is inside."""
    own = faces(elements).withColumn("key", F.array_sort("face"))
    return own.groupBy("key").agg(F.count("*").alias("shared"), F.min(F.struct("class", "label", "part")).alias("o")).select("key", "shared", "o.class", "o.label", "o.part")


def visible(elements: DataFrame, hidden: list[int]) -> DataFrame:
    """Elements of materials that are not hidden; a material that nobody names is visible."""
    return elements.where(~F.col("material").isin(hidden)) if hidden else elements


def placed(rows: DataFrame, points: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``at``: an array of (x, y, z) in the order of the nodes in ``column``; rows that lack a point go."""
    keys = [c for c in rows.columns if c != column]
    long = rows.select(*keys, F.size(column).alias("__n"), F.col(column).alias("__nodes"), F.posexplode(column).alias("__i", "node")).join(points, "node")
    out = long.groupBy(*keys, "__n", "__nodes").agg(F.array_sort(F.collect_list(F.struct("__i", "x", "y", "z"))).alias("at"))  # as many as the row has corners
    return out.where(F.size("at") == F.col("__n")).withColumnRenamed("__nodes", column).drop("__n")


def _xyz(p: Column) -> tuple[Column, Column, Column]:
    return p["x"], p["y"], p["z"]


def normal_of(at: Column) -> tuple[Column, Column, Column]:
    """The normal of a triangle, as long as twice its area."""
    a, b, c = (_xyz(at[i]) for i in range(3))
    return K.cross(K.minus(b, a), K.minus(c, a))


def vertex_normals(tris: DataFrame) -> DataFrame:
    """(node, nx, ny, nz): unit sums of the normals around each node, by area; upwards where they cancel. ``tris`` has tri and at."""
    n = normal_of(F.col("at"))
    own = tris.select(F.explode("tri").alias("node"), *[c.alias(f"n{a}") for a, c in zip("xyz", n, strict=True)])
    total = own.groupBy("node").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    size = K.magnitude(F.col("nx"), F.col("ny"), F.col("nz"))
    flat = size == 0
    return total.select("node", *[F.when(flat, F.lit(1.0 if a == "z" else 0.0)).otherwise(F.try_divide(F.col(f"n{a}"), size)).alias(f"n{a}") for a in "xyz"])


def feature_edges(tris: DataFrame, cosine: float) -> DataFrame:
    """(lo, hi) of edges that one triangle has, or three and more, or two whose normals are further apart than the angle."""
    raw = tris.withColumns({f"r{a}": c for a, c in zip("xyz", normal_of(F.col("at")), strict=True)})
    size = K.magnitude(F.col("rx"), F.col("ry"), F.col("rz"))
    unit = raw.withColumns({f"n{a}": F.when(size == 0, 0.0).otherwise(F.try_divide(F.col(f"r{a}"), size)) for a in "xyz"})
    pairs = F.array(*[F.struct(F.least(F.col("tri")[i], F.col("tri")[j]).alias("lo"), F.greatest(F.col("tri")[i], F.col("tri")[j]).alias("hi")) for i, j in ((0, 1), (1, 2), (2, 0))])
    own = unit.select("nx", "ny", "nz", F.explode(pairs).alias("e")).select("e.lo", "e.hi", "nx", "ny", "nz")
    # the dot product of two is half of what their sum's square has beyond the squares' sum, so nothing is collected
    sums = [F.sum(f"n{a}").alias(f"s{a}") for a in "xyz"]
    squares = F.sum(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2).alias("q")
    both = own.groupBy("lo", "hi").agg(F.count("*").alias("k"), squares, *sums)
    dot = (F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2 - F.col("q")) / 2
    return both.where((F.col("k") != 2) | (dot < cosine)).select("lo", "hi", F.col("k"))


def picked(tris: DataFrame, origin: tuple[float, float, float], direction: tuple[float, float, float], keys: list[str]) -> DataFrame:
    """The triangle that a ray meets first, how far, and its nearest corner; from either side, ahead of the origin only."""
    a, b, c = (_xyz(F.col("at")[i]) for i in range(3))
    d, o = tuple(map(F.lit, direction)), tuple(map(F.lit, origin))
    one, two = K.minus(b, a), K.minus(c, a)
    p = K.cross(d, two)
    det = K.dot(one, p)
    back = K.minus(o, a)
    q = K.cross(back, one)
    u, v, t = (F.try_divide(x, det) for x in (K.dot(back, p), K.dot(d, q), K.dot(two, q)))
    hits = tris.withColumns({"u": u, "v": v, "t": t}).where((F.abs(det) >= 1e-7) & F.col("u").between(0, 1) & (F.col("v") >= 0) & (F.col("u") + F.col("v") <= 1) & (F.col("t") > 1e-7))
    hit = tuple(x + F.col("t") * y for x, y in zip(o, d, strict=True))
    far = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(K.dot(K.minus(_xyz(F.get(F.col("at"), i)), hit), K.minus(_xyz(F.get(F.col("at"), i)), hit)).alias("d"), i.alias("i"))))
    return hits.select(*keys, F.col("t").alias("distance"), F.get("tri", far["i"]).alias("node")).orderBy("distance", *keys).limit(1)


def plane(origin: tuple[float, float, float], normal: tuple[float, float, float], reverse: bool = False):
    """(origin, unit normal), the other way round if so asked; None if the normal has no length."""
    size = sum(x * x for x in normal) ** 0.5
    return None if size < 1e-12 else (origin, tuple((-x if reverse else x) / size for x in normal))


def _signed(p: Column, cut) -> Column:
    return K.dot(K.minus(_xyz(p), tuple(map(F.lit, cut[0]))), tuple(map(F.lit, cut[1])))


def _between(a: Column, b: Column, da: Column, db: Column) -> Column:
    """Where the edge from a to b meets the plane."""
    t = da / (da - db)
    return F.struct(*[(a[c] + (b[c] - a[c]) * t).alias(c) for c in "xyz"])


def side_of(at: Column, cut, eps: float = 1e-9) -> Column:
    """``kept``, ``dropped`` or ``cut``."""
    d = F.transform(at, lambda p: _signed(p, cut))
    return F.when(F.forall(d, lambda x: x <= eps), "dropped").when(F.forall(d, lambda x: x >= -eps), "kept").otherwise("cut")


def clipped(at: Column, cut, eps: float = 1e-9) -> Column:
    """A face's polygon on the kept side, in order: corners that are kept, and where its edges cross."""
    n = F.size(at)

    def edge(i: Column) -> Column:
        a, b = F.get(at, i), F.get(at, (i + 1) % n)
        da, db = _signed(a, cut), _signed(b, cut)
        here, there = da >= -eps, db >= -eps
        point = F.struct(*[a[c].alias(c) for c in "xyz"])
        none = F.array().cast("array<struct<x:double,y:double,z:double>>")
        return F.concat(F.when(here, F.array(point)).otherwise(none), F.when(here != there, F.array(_between(a, b, da, db))).otherwise(none))

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), edge))


def crossings(at: Column, cut, eps: float = 1e-9) -> Column:
    """The points where a face's edges cross the plane: two for a face that it cuts."""
    n = F.size(at)

    def edge(i: Column) -> Column:
        a, b = F.get(at, i), F.get(at, (i + 1) % n)
        da, db = _signed(a, cut), _signed(b, cut)
        return F.when((da >= -eps) != (db >= -eps), _between(a, b, da, db))

    return F.filter(F.transform(F.sequence(F.lit(0), n - 1), edge), lambda p: p.isNotNull())


def capped(faces_at: DataFrame, cut) -> DataFrame:
    """(class, label, triangles, area, cx, cy, cz): the cap of each element that the plane cuts, a fan of one triangle for each face around the middle of the crossings."""
    own = faces_at.withColumn("c", crossings(F.col("at"), cut)).where(F.size("c") == 2)
    ends = own.select("class", "label", F.explode("c").alias("p")).groupBy("class", "label").agg(*[F.avg(f"p.{a}").alias(f"c{a}") for a in "xyz"])
    fan = own.join(ends, ["class", "label"])
    middle = tuple(F.col(f"c{a}") for a in "xyz")
    spread = K.cross(K.minus(_xyz(F.col("c")[0]), middle), K.minus(_xyz(F.col("c")[1]), middle))
    return fan.groupBy("class", "label", "cx", "cy", "cz").agg(F.count("*").alias("triangles"), F.sum(K.magnitude(*spread) / 2).alias("area"))


def packed_member(class_id: Column, row: Column) -> Column:
    """A class and a row in one number: 8 bits above 24."""
    return F.shiftleft(class_id.cast("long"), 24).bitwiseOR(row.cast("long"))


def appended(parts: list[DataFrame], index: str, size: str) -> DataFrame:
    """Parts one after another, their indices moved by the sizes of those before. ``size`` is the same in all rows of a part."""
    out, before = None, F.lit(0)
    spark = parts[0].sparkSession
    for p in parts:
        moved = p.crossJoin(F.broadcast(spark.range(1).select(before.alias("__base")))) if out is None else p.join(F.broadcast(out[1]))  # one row
        rows = moved.withColumn(index, F.col(index) + F.col("__base"))
        total = moved.agg((F.max("__base") + F.max(size)).alias("__base"))
        out = (rows.drop("__base") if out is None else out[0].unionByName(rows.drop("__base")), total)
    return out[0]


def bounds(points: DataFrame) -> DataFrame:
    """(cx, cy, cz, radius): the middle of the box around all points, and half its diagonal, 0.001 at least."""
    box = points.agg(*[f(a).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"])
    half = K.magnitude(*[F.col(f"hi{a}") - F.col(f"lo{a}") for a in "xyz"]) / 2
    return box.select(*[((F.col(f"lo{a}") + F.col(f"hi{a}")) / 2).alias(f"c{a}") for a in "xyz"], F.greatest(half, F.lit(1e-3)).alias("radius"))


def plain_centroid(elements: DataFrame, points: DataFrame) -> DataFrame:
    """(class, label, cx, cy, cz): each different node's position once, over the number of all nodes that the element names."""
    own = elements.select("class", "label", F.size("nodes").alias("k"), F.explode(F.array_distinct("nodes")).alias("node")).join(points, "node")
    return own.groupBy("class", "label", "k").agg(*[F.sum(a).alias(a) for a in "xyz"]).select("class", "label", *[(F.col(a) / F.col("k")).alias(f"c{a}") for a in "xyz"])


def face_scatter(faces_with: DataFrame) -> DataFrame:
    """(node, value): the mean over all corners of all faces that have a value; ``faces_with`` has (face, value)."""
    return faces_with.select(F.explode("face").alias("node"), "value").groupBy("node").agg(F.avg("value").alias("value"))
