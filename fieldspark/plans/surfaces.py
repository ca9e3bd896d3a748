"""Queries on surfaces of the mesh that the embeddings make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import topology
from ..operators import surface as G
from ..sources.binding import mesh
from .database import ELEMENTS, NODES
from .registry import query, r

_HEX = topology.SHAPES["HEX"]


def _mesh(spark, d, name: str | None = "brick"):
    db = mesh(spark, d)
    shape = F.when(F.col("class") == "brick", "HEX").otherwise("QUAD")
    elements = db.connectivity(name).withColumn("superclass", shape)
    points = db.nodes().select(F.col("label").alias("node"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    return elements, points


def _listed(table: list[tuple[int, ...]]) -> str:
    return "[" + ", ".join("[" + ", ".join(map(str, t)) + "]" for t in table) + "]"


P = "p AS (SELECT k + 1 AS node, CAST(x[1] AS DOUBLE) AS x, CAST(x[2] AS DOUBLE) AS y, CAST(x[3] AS DOUBLE) AS z FROM e)"
FACES = f"f AS (SELECT label, CAST(unnest(range(0, 6)) AS INTEGER) AS part, unnest({_listed(list(_HEX.faces))}) AS c FROM el WHERE class = 'brick')"
FLAT = "fx AS (SELECT f.label, f.part, i, (f.label - 1) * 8 + c[i + 1] + 1 AS node FROM f, (SELECT unnest(range(0, 4)) AS i)), fp AS (SELECT fx.*, x, y, z FROM fx JOIN p USING (node))"
_ALL = f"WITH {NODES}, {ELEMENTS}, {P}"
TRIS = f"""t AS (SELECT label, part, (label - 1) * 8 + c[1] + 1 AS a, (label - 1) * 8 + c[2] + 1 AS b, (label - 1) * 8 + c[3] + 1 AS c FROM (SELECT label, CAST(unnest(range(0, 12)) AS INTEGER) AS part, unnest({_listed(_HEX.triangles())}) AS c FROM el WHERE class = 'brick')),
tn AS (SELECT t.*, (q.y - o.y) * (s.z - o.z) - (q.z - o.z) * (s.y - o.y) AS nx, (q.z - o.z) * (s.x - o.x) - (q.x - o.x) * (s.z - o.z) AS ny, (q.x - o.x) * (s.y - o.y) - (q.y - o.y) * (s.x - o.x) AS nz FROM t JOIN p o ON o.node = a JOIN p q ON q.node = b JOIN p s ON s.node = c)"""


@query(f"{_ALL}, {TRIS} SELECT 'brick' AS class, label, part, a || ',' || b || ',' || c AS tri FROM t UNION ALL SELECT 'shell', label, CAST(part AS INTEGER), CASE part WHEN 0 THEN (label * 4 - 3) || ',' || (label * 4 - 2) || ',' || (label * 4 - 1) ELSE (label * 4 - 3) || ',' || (label * 4 - 1) || ',' || (label * 4) END FROM el, (SELECT unnest([0, 1]) AS part) WHERE class = 'shell'")
def mesh_triangles(spark, d):
    elements, _ = _mesh(spark, d, None)
    return G.triangles(elements).select("class", "label", "part", F.concat_ws(",", F.col("tri").cast("array<string>")).alias("tri"))


@query(f"{_ALL} SELECT label, ((label - 1) * 8 + c[1] + 1) || '-' || ((label - 1) * 8 + c[2] + 1) AS edge FROM (SELECT label, unnest({_listed(list(_HEX.edges))}) AS c FROM el WHERE class = 'brick')")
def element_edges(spark, d):
    """The twelve edges of each brick."""
    return G.element_edges(_mesh(spark, d)[0]).select("label", F.concat_ws("-", F.col("edge").cast("array<string>")).alias("edge"))


@query(f"""{_ALL}, g AS (SELECT (label - 1) * 8 + c[1] + 1 AS a, (label - 1) * 8 + c[2] + 1 AS b FROM (SELECT label, unnest({_listed(list(_HEX.edges))}) AS c FROM el WHERE class = 'brick') UNION ALL SELECT (label - 1) * 4 + k, (label - 1) * 4 + k % 4 + 1 FROM el, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE class = 'shell')
SELECT b AS node FROM g WHERE a IN (42, 17) AND b NOT IN (42, 17) UNION SELECT a FROM g WHERE b IN (42, 17) AND a NOT IN (42, 17)""")
def neighbor_nodes(spark, d):
    """Nodes at the other end of an element's edge, over bricks and shells."""
    return G.neighbours(_mesh(spark, d, None)[0], [42, 17])


@query(f"""{_ALL}, s AS (SELECT 'shell' AS class, label, 0 AS part, [label * 4 - 3, label * 4 - 2, label * 4 - 1, label * 4] AS nodes FROM el WHERE class = 'shell'
UNION ALL SELECT 'brick', label, part, [(label - 1) * 8 + k + 1 FOR k IN c] FROM (SELECT label, CAST(unnest(range(0, 6)) AS INTEGER) AS part, unnest({_listed(list(_HEX.faces))}) AS c FROM el WHERE class = 'brick')),
g AS (SELECT list_sort(nodes) AS key, count(*) AS shared, min(class || ':' || lpad(CAST(label AS VARCHAR), 9, '0') || ':' || part) AS owner FROM s GROUP BY 1)
SELECT array_to_string(key, ',') AS face, shared, owner FROM g""")
def volume_faces(spark, d):
    """Faces of bricks and shells together: a shell lies on a brick's face where both have the same nodes."""
    elements, _ = _mesh(spark, d, None)
    out = G.shared_faces(elements)
    return out.select(F.concat_ws(",", F.col("key").cast("array<string>")).alias("face"), "shared", F.concat_ws(":", "class", F.lpad(F.col("label").cast("string"), 9, "0"), F.col("part").cast("string")).alias("owner"))


@query(f"{_ALL} SELECT label, material FROM el WHERE class = 'brick' AND material NOT IN (2, 5)")
def visible_elements(spark, d):
    """Elements whose material is not hidden."""
    return G.visible(_mesh(spark, d)[0], [2, 5]).select("label", "material")


@query(f"""{_ALL}, {TRIS}, s AS (SELECT node, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT a AS node, nx, ny, nz FROM tn UNION ALL SELECT b, nx, ny, nz FROM tn UNION ALL SELECT c, nx, ny, nz FROM tn) GROUP BY node)
SELECT node, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 5) + 0.0 AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 5) + 0.0 AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 5) + 0.0 AS nz FROM s""")
def vertex_normals(spark, d):
    elements, points = _mesh(spark, d)
    out = G.vertex_normals(G.placed(G.triangles(elements), points, "tri"))
    return out.select("node", *[r(f"n{a}", 5).alias(f"n{a}") for a in "xyz"])


@query(f"""{_ALL}, {TRIS}, u AS (SELECT label, part, a, b, c, nx / l AS nx, ny / l AS ny, nz / l AS nz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM tn)),
g AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, * FROM u UNION ALL SELECT least(b, c), greatest(b, c), * FROM u UNION ALL SELECT least(c, a), greatest(c, a), * FROM u)
SELECT lo, hi, count(*) AS k FROM g GROUP BY lo, hi HAVING count(*) <> 2 OR (sum(nx) ** 2 + sum(ny) ** 2 + sum(nz) ** 2 - sum(nx * nx + ny * ny + nz * nz)) / 2 < 0.25""")
def feature_edges(spark, d):
    """Edges where the surface bends by more than the angle, ends or branches."""
    elements, points = _mesh(spark, d)
    return G.feature_edges(G.placed(G.triangles(elements), points, "tri"), 0.25)


_O, _D = (-0.02, 0.03, -3.0), (0.01, -0.02, 1.0)


@query(f"""{_ALL}, {TRIS}, m AS (SELECT t.label, t.part, o.x AS ax, o.y AS ay, o.z AS az, q.x - o.x AS ux, q.y - o.y AS uy, q.z - o.z AS uz, s.x - o.x AS vx, s.y - o.y AS vy, s.z - o.z AS vz, {_O[0]} - o.x AS bx, {_O[1]} - o.y AS bh, {_O[2]} - o.z AS bz
FROM t JOIN p o ON o.node = a JOIN p q ON q.node = b JOIN p s ON s.node = c), h AS (SELECT *, {_D[1]} * vz - {_D[2]} * vy AS px, {_D[2]} * vx - {_D[0]} * vz AS py, {_D[0]} * vy - {_D[1]} * vx AS pz, bh * uz - bz * uy AS qx, bz * ux - bx * uz AS qy, bx * uy - bh * ux AS qz FROM m),
i AS (SELECT label, part, ux * px + uy * py + uz * pz AS det, bx * px + bh * py + bz * pz AS un, {_D[0]} * qx + {_D[1]} * qy + {_D[2]} * qz AS vn, vx * qx + vy * qy + vz * qz AS tn FROM h)
SELECT label, part, round(tn / det, 5) + 0.0 AS distance FROM i WHERE abs(det) >= 1e-7 AND un / det BETWEEN 0 AND 1 AND vn / det >= 0 AND (un + vn) / det <= 1 AND tn / det > 1e-7 ORDER BY tn / det, label, part LIMIT 1""")
def ray_pick(spark, d):
    """The first triangle that a ray meets; the one row is what the operator gives."""
    elements, points = _mesh(spark, d)
    out = G.picked(G.placed(G.triangles(elements), points, "tri"), _O, _D, ["label", "part"])
    return out.select("label", "part", r("distance", 5).alias("distance"))


_CUT = ((0.01, 0.0, 0.0), (0.6, 0.0, 0.8))
_SD = f"(x - {_CUT[0][0]}) * {_CUT[1][0]} + z * {_CUT[1][2]}"
_EDGES = f"{_ALL}, {FACES}, {FLAT}, fd AS (SELECT *, {_SD} AS d FROM fp), fe AS (SELECT a.label, a.part, a.i, a.x, a.y, a.z, a.d, b.d AS bd, a.d / (a.d - b.d) AS t, b.x AS bx, b.y AS bh, b.z AS bz FROM fd a JOIN fd b ON b.label = a.label AND b.part = a.part AND b.i = (a.i + 1) % 4)"


@query(f"{_ALL}, d AS (SELECT el.label, {_SD} AS d FROM ex JOIN p ON p.node = ex.node JOIN el ON el.label = ex.label AND el.class = ex.class WHERE ex.class = 'brick') SELECT label, CASE WHEN max(d) <= 1e-9 THEN 'dropped' WHEN min(d) >= -1e-9 THEN 'kept' ELSE 'cut' END AS side FROM d GROUP BY label")
def cut_sides(spark, d):
    """On which side of a plane each brick is."""
    elements, points = _mesh(spark, d)
    at = G.placed(elements.select("label", "nodes"), points, "nodes")
    return at.select("label", G.side_of(F.col("at"), G.plane(*_CUT)).alias("side"))


@query(_EDGES + """, v AS (SELECT label, part, i * 2 AS o, x, y, z FROM fe WHERE d >= -1e-9 UNION ALL SELECT label, part, i * 2 + 1, x + (bx - x) * t, y + (bh - y) * t, z + (bz - z) * t FROM fe WHERE (d >= -1e-9) <> (bd >= -1e-9)),
s AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, first(x) OVER w AS x0, first(y) OVER w AS y0, first(z) OVER w AS z0 FROM v WINDOW w AS (PARTITION BY label, part ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT label, part, count(*) AS corners, round(avg(x), 5) + 0.0 AS cx, round(avg(y), 5) + 0.0 AS cy, round(avg(z), 5) + 0.0 AS cz,
round(sum(coalesce(sqrt(((y - y0) * (z1 - z0) - (z - z0) * (y1 - y0)) ** 2 + ((z - z0) * (x1 - x0) - (x - x0) * (z1 - z0)) ** 2 + ((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) ** 2) / 2, 0)), 4) + 0.0 AS area FROM s GROUP BY 1, 2""")
def clip_polygons(spark, d):
    """Each face's part on the kept side: its corners in order, their middle, and the area of its fan."""
    elements, points = _mesh(spark, d)
    own = G.placed(G.faces(elements).select("label", "part", "face"), points, "face").withColumn("poly", G.clipped(F.col("at"), G.plane(*_CUT))).where(F.size("poly") > 0)
    n = F.size("poly")

    def mean(axis: str):
        return F.aggregate("poly", F.lit(0.0), lambda s, q: s + q[axis]) / n

    from ..functions import kernels as K

    first = F.col("poly")[0]

    def tri(i):
        a, b = F.get(F.col("poly"), i), F.get(F.col("poly"), i + 1)
        return K.magnitude(*K.cross(tuple(a[c] - first[c] for c in "xyz"), tuple(b[c] - first[c] for c in "xyz"))) / 2

    area = F.aggregate(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: i >= 1), tri), F.lit(0.0), lambda s, x: s + x)
    return own.select("label", "part", n.cast("long").alias("corners"), *[r(mean(a), 5).alias(f"c{a}") for a in "xyz"], r(area, 4).alias("area"))


@query(_EDGES + """, c AS (SELECT label, part, x + (bx - x) * t AS x, y + (bh - y) * t AS y, z + (bz - z) * t AS z, i FROM fe WHERE (d >= -1e-9) <> (bd >= -1e-9)), k AS (SELECT label, part FROM c GROUP BY 1, 2 HAVING count(*) = 2), m AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM c JOIN k USING (label, part) GROUP BY label),
g AS (SELECT label, part, arg_min(x, i) - cx AS ax, arg_min(y, i) - cy AS ay, arg_min(z, i) - cz AS az, arg_max(x, i) - cx AS bx, arg_max(y, i) - cy AS bh, arg_max(z, i) - cz AS bz, cx, cy, cz FROM c JOIN k USING (label, part) JOIN m USING (label) GROUP BY label, part, cx, cy, cz)
SELECT label, count(*) AS triangles, round(sum(sqrt((ay * bz - az * bh) ** 2 + (az * bx - ax * bz) ** 2 + (ax * bh - ay * bx) ** 2) / 2), 4) + 0.0 AS area, round(any_value(cx), 5) + 0.0 AS cx, round(any_value(cz), 5) + 0.0 AS cz FROM g GROUP BY label""")
def clip_caps(spark, d):
    """The cap of each brick that the plane cuts."""
    elements, points = _mesh(spark, d)
    own = G.placed(G.faces(elements).select("class", "label", "part", "face"), points, "face")
    return G.capped(own, G.plane(*_CUT)).select("label", "triangles", r("area", 4).alias("area"), r("cx", 5).alias("cx"), r("cz", 5).alias("cz"))


@query(f"{_ALL} SELECT label, (CASE class WHEN 'brick' THEN 1 ELSE 2 END << 24) | label AS member FROM el")
def packed_members(spark, d):
    elements, _ = _mesh(spark, d, None)
    return elements.select("label", G.packed_member(F.when(F.col("class") == "brick", 1).otherwise(2), F.col("label")).alias("member"))


@query(f"{_ALL}, {TRIS}, n AS (SELECT max(label) AS n FROM el WHERE class = 'brick') SELECT 0 AS part, label AS i FROM el WHERE class = 'brick' UNION ALL SELECT 1, label + n FROM el, n WHERE class = 'shell'")
def appended_indices(spark, d):
    """Two parts one after another, the second's indices moved by the first's size."""
    elements, _ = _mesh(spark, d, None)
    from pyspark.sql import Window

    parts = [elements.where(F.col("class") == c).select(F.lit(k).alias("part"), F.col("label").alias("i"), F.max("label").over(Window.partitionBy("class")).alias("size")) for k, c in enumerate(("brick", "shell"))]
    return G.appended(parts, "i", "size").select("part", "i")




@query(f"""{_ALL}, s5 AS (SELECT k + 1 AS node, CAST(x[13] AS DOUBLE) AS x, CAST(x[14] AS DOUBLE) AS y, CAST(x[15] AS DOUBLE) AS z FROM e), b AS (SELECT el.label, """
       + ", ".join(f"n{m}.{a} AS {a}{m}, n{m}.{a} - o{m}.{a} AS d{a}{m}" for m in range(4) for a in "xyz") + " FROM el "
       + " ".join(f"JOIN s5 n{m} ON n{m}.node = (el.label - 1) * 8 + {c + 1} JOIN p o{m} ON o{m}.node = (el.label - 1) * 8 + {c + 1}" for m, c in enumerate(_HEX.faces[0])) + " WHERE el.class = 'brick'), "
       + "c AS (SELECT *, " + ", ".join(f"({p}1 + {p}2 - {p}0 - {p}3) / 4 AS u{p}, ({p}2 + {p}3 - {p}0 - {p}1) / 4 AS v{p}" for p in ("x", "y", "z", "dx", "dy", "dz")) + " FROM b), "
       + """n AS (SELECT *, uy * vz - uz * vy AS n0, uz * vx - ux * vz AS n1, ux * vy - uy * vx AS n2 FROM c), nn AS (SELECT *, n0 / l AS nx, n1 / l AS ny, n2 / l AS nz FROM (SELECT *, sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS l FROM n)),
f AS (SELECT *, (x1 - x0) - nx * dd AS f0, (y1 - y0) - ny * dd AS f1, (z1 - z0) - nz * dd AS f2 FROM (SELECT *, (x1 - x0) * nx + (y1 - y0) * ny + (z1 - z0) * nz AS dd FROM nn)),
g AS (SELECT *, f0 / m AS fx, f1 / m AS fy, f2 / m AS fz FROM (SELECT *, sqrt(f0 * f0 + f1 * f1 + f2 * f2) AS m FROM f)), h AS (SELECT *, ny * fz - nz * fy AS gx, nz * fx - nx * fz AS gy, nx * fy - ny * fx AS gz FROM g),
j AS (SELECT *, fx * ux + fy * uy + fz * uz AS a, fx * vx + fy * vy + fz * vz AS bb, gx * ux + gy * uy + gz * uz AS cc, gx * vx + gy * vy + gz * vz AS d4, fx * udx + fy * udy + fz * udz AS fu, fx * vdx + fy * vdy + fz * vdz AS fv, gx * udx + gy * udy + gz * udz AS gu, gx * vdx + gy * vdy + gz * vdz AS gv FROM h),
q AS (SELECT *, (fu * d4 - fv * cc) / det AS xx, (fv * a - fu * bb) / det AS xy, (gu * d4 - gv * cc) / det AS yx, (gv * a - gu * bb) / det AS yy FROM (SELECT *, a * d4 - bb * cc AS det FROM j))
SELECT label, round(fx * fx * xx + gx * gx * yy + 2 * fx * gx * 0.5 * (xy + yx), 3) + 0.0 AS ex, round(fx * fy * xx + gx * gy * yy + (fx * gy + gx * fy) * 0.5 * (xy + yx), 3) + 0.0 AS exy FROM q WHERE abs(det) > 0.001""")  # fmt: skip
def surface_strain(spark, d):
    """Strain in each brick's first face in the last state, along x and in the xy plane; faces without an area are left out on both sides."""
    from ..database import query as select
    from ..database.query import gathered
    from ..functions import kernels as K

    db = mesh(spark, d)
    got = select(db, ["surfstrainx", "surfstrainxy"], "brick", states=-1, face=1).groupBy("label").agg(F.max(F.when(F.col("svar") == "surfstrainx", F.col("value"))).alias("ex"), F.max(F.when(F.col("svar") == "surfstrainxy", F.col("value"))).alias("exy"))
    at = [tuple(F.col(f"{a}{k}") for a in "xyz") for k in _HEX.faces[0]]
    u = K.scaled(K.minus(K.plus(at[1], at[2]), K.plus(at[0], at[3])), 0.25)
    v = K.scaled(K.minus(K.plus(at[3], at[2]), K.plus(at[0], at[1])), 0.25)
    n = K.cross(u, v)
    # the determinant of the face's directions in its own frame is the length of their product
    solid = gathered(db, "brick", [5], lambda df: df).where(K.magnitude(*n) > 0.001).select("label")
    return got.join(solid, "label").select("label", r("ex", 3).alias("ex"), r("exy", 3).alias("exy"))


@query(f"{_ALL}, b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM p) SELECT round((lx + hx) / 2, 6) + 0.0 AS cx, round((ly + hy) / 2, 6) + 0.0 AS cy, round((lz + hz) / 2, 6) + 0.0 AS cz, round(greatest(sqrt((hx - lx) ** 2 + (hy - ly) ** 2 + (hz - lz) ** 2) / 2, 0.001), 6) AS radius FROM b")
def mesh_bounds(spark, d):
    """A sphere around all points."""
    return G.bounds(_mesh(spark, d)[1]).select(*[r(c, 6).alias(c) for c in ("cx", "cy", "cz", "radius")])


@query(f"{_ALL} SELECT ex.class, ex.label, round(sum(x) / any_value(size), 6) + 0.0 AS cx, round(sum(y) / any_value(size), 6) + 0.0 AS cy FROM ex JOIN p ON p.node = ex.node GROUP BY 1, 2")
def plain_centroids(spark, d):
    elements, points = _mesh(spark, d, None)
    return G.plain_centroid(elements, points).select("class", "label", r("cx", 6).alias("cx"), r("cy", 6).alias("cy"))


@query(f"""{_ALL}, s AS (SELECT label * 4 - 3 AS a FROM el WHERE class = 'shell'), f AS (SELECT list_sort([(label - 1) * 8 + i + 1 FOR i IN k]) AS nodes FROM (SELECT label, unnest({_listed(list(_HEX.faces))}) AS k FROM el WHERE class = 'brick')
UNION ALL SELECT [a, a + 1, a + 2, a + 3] FROM s) SELECT array_to_string(nodes, ',') AS face FROM f GROUP BY nodes HAVING count(*) >= 2""")
def interior_faces(spark, d):
    """Faces that two elements or more have: they are inside."""
    out = G.shared_faces(_mesh(spark, d, None)[0]).where("shared >= 2")
    return out.select(F.concat_ws(",", F.col("key").cast("array<string>")).alias("face"))


@query(f"{_ALL}, v AS (SELECT el.label, CAST(e.x[1] AS DOUBLE) AS v FROM el JOIN e ON e.k = (el.label - 1) * 8 WHERE class = 'brick'), f AS (SELECT label, unnest({_listed(list(_HEX.faces))}) AS k FROM el WHERE class = 'brick'), c AS (SELECT (label - 1) * 8 + unnest(k) + 1 AS node, label FROM f) SELECT node, round(avg(v), 6) + 0.0 AS value FROM c JOIN v USING (label) GROUP BY node")
def face_scatter(spark, d):
    """A value of each brick's faces, as a mean at their corners."""
    from ..database import query as select

    db = mesh(spark, d)
    values = select(db, "sx", "brick", states=1).select("label", "value")
    return G.face_scatter(G.faces(_mesh(spark, d)[0]).join(values, "label").select("face", "value")).select("node", r("value", 6).alias("value"))
