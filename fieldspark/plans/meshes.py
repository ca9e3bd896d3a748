"""Queries on connectivity and geometry: elements of consecutive embeddings, or orders as elements and parts as nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import mesh as G
from ..sources import incidence, table, vectors
from .registry import query, r, vector_sql

_P = vector_sql(("x", "y", "z"))


def _pivot_sql(n: int) -> str:
    cols = ", ".join(f"max(CASE WHEN k = {k} THEN {c} END) AS {c}{k}" for k in range(n) for c in "xyz")
    return f"e AS (SELECT element, {cols} FROM (SELECT vec_id // {n} AS element, vec_id % {n} AS k, x, y, z FROM ({_P})) GROUP BY element HAVING count(*) = {n})"


def _cells(spark, d, n):
    v = vectors(spark, d, ("x", "y", "z")).select(F.expr(f"vec_id div {n}").alias("element"), (F.col("vec_id") % n).alias("k"), "x", "y", "z")
    return G.corner_columns(v, "element", "k", n)


def _det(a, b, c) -> str:
    return f"(({a[0]}) * (({b[1]}) * ({c[2]}) - ({b[2]}) * ({c[1]})) - ({a[1]}) * (({b[0]}) * ({c[2]}) - ({b[2]}) * ({c[0]})) + ({a[2]}) * (({b[0]}) * ({c[1]}) - ({b[1]}) * ({c[0]})))"


def _v(text: str) -> list[str]:
    """``"+6-0"`` as the three sums x6 - x0 and so on."""
    return [" ".join(f"{text[i]} {c}{text[i + 1]}" for i in range(0, len(text), 2)) for c in "xyz"]


@query(f"WITH {_pivot_sql(4)} SELECT element, round({_det(_v('+1-0'), _v('+2-0'), _v('+3-0'))} / 6, 6) + 0.0 AS volume FROM e")
def tet_volume(spark, d):
    return _cells(spark, d, 4).select("element", r(K.tet_volume(G.corners(4)), 6).alias("volume"))


_HEX = f"({_det(_v('+6-1+7-0'), _v('+6-3'), _v('+2-0'))} + {_det(_v('+7-0'), _v('+6-3+5-0'), _v('+6-4'))} + {_det(_v('+6-1'), _v('+5-0'), _v('+6-4+2-0'))}) / 12"


@query(f"WITH {_pivot_sql(8)} SELECT element, round({_HEX}, 5) + 0.0 AS volume FROM e")
def hex_volume(spark, d):
    return _cells(spark, d, 8).select("element", r(K.hex_volume(G.corners(8)), 5).alias("volume"))


@query(f"""WITH {_pivot_sql(4)}, m AS (SELECT element, {", ".join(f"(-{c}0 + {c}1 + {c}2 - {c}3) AS s{c}, (-{c}0 - {c}1 + {c}2 + {c}3) AS t{c}" for c in "xyz")} FROM e)
SELECT element, round(sqrt(((sx * sx + sy * sy + sz * sz) * (tx * tx + ty * ty + tz * tz) - (sx * tx + sy * ty + sz * tz) ** 2) / 16), 6) + 0.0 AS area FROM m""")
def quad_area(spark, d):
    return _cells(spark, d, 4).select("element", r(K.quad_area(G.corners(4)), 6).alias("area"))


_JAC = _det(_v("-0+1+2-3-4+5+6-7"), _v("-0-1+2+3-4-5+6+7"), _v("-0-1-2-3+4+5+6+7")) + " / 512"


@query(f"WITH {_pivot_sql(8)}, j AS (SELECT element, {_JAC} AS j FROM e) SELECT a.element, round(CASE WHEN abs(b.j) < 1e-9 THEN 0 ELSE a.j / b.j END, 3) + 0.0 AS relative_volume FROM j a JOIN j b ON b.element = a.element - a.element % 3")
def relative_volume(spark, d):
    """Determinants of cells over those of their group's first, as its undeformed shape."""
    j = _cells(spark, d, 8).select("element", K.jacobian(G.corners(8)).alias("j"))
    ref = j.select(F.col("element").alias("first"), F.col("j").alias("j0"))
    out = j.join(ref, F.col("first") == F.col("element") - F.col("element") % 3)
    ratio = F.when(F.abs("j0") < 1e-9, F.lit(0.0)).otherwise(K.divide(F.col("j"), F.col("j0")))
    return out.select("element", r(ratio, 3).alias("relative_volume"))


@query(f"SELECT vec_id // 8 AS element, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM ({_P}) GROUP BY 1")
def centroid(spark, d):
    v = vectors(spark, d, ("x", "y", "z"))
    return v.groupBy(F.expr("vec_id div 8").alias("element")).agg(*[r(F.avg(c), 6).alias(c) for c in "xyz"])


@query("""WITH c AS (SELECT label, CAST(vec_id % 5 AS INTEGER) AS state, avg(CAST(embedding[1] AS DOUBLE)) AS x, avg(CAST(embedding[2] AS DOUBLE)) AS y, avg(CAST(embedding[3] AS DOUBLE)) AS z FROM embeddings GROUP BY ALL)
SELECT a.state, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) + 0.0 AS distance FROM c a JOIN c b ON a.state = b.state WHERE a.label = 1 AND b.label = 2""")
def measure(spark, d):
    """Distance of two materials' centres at each state."""
    c = vectors(spark, d, ("x", "y", "z")).groupBy("label", (F.col("vec_id") % 5).cast("int").alias("state")).agg(*[F.avg(x).alias(x) for x in "xyz"])
    a, b = c.where("label = 1"), c.where("label = 2").select("state", *[F.col(x).alias(f"{x}2") for x in "xyz"])
    return a.join(b, "state").select("state", r(K.magnitude(*[F.col(x) - F.col(f"{x}2") for x in "xyz"]), 6).alias("distance"))


@query("""SELECT o_orderkey AS element, round(o_totalprice * a.area, 2) + 0.0 AS force FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS area FROM lineitem GROUP BY 1) a ON a.l_orderkey = o_orderkey""")
def contact_force(spark, d):
    """A primal times its element's area."""
    area = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("element")).agg(F.sum("l_quantity").alias("area"))
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("element"), "o_totalprice")
    return p.join(area, "element").select("element", r(F.col("o_totalprice") * F.col("area"), 2).alias("force"))


_INC = "i AS (SELECT DISTINCT l_orderkey AS element, l_partkey AS node FROM lineitem)"


@query(f"WITH {_INC} SELECT node, round(avg(o_totalprice), 7) + 0.0 AS value FROM i JOIN orders ON o_orderkey = element GROUP BY node")
def project_adjacent(spark, d):
    values = table(spark, d, "orders").select(F.col("o_orderkey").alias("element"), F.col("o_totalprice").alias("value"))
    return G.projected(incidence(spark, d), values).select("node", r("value", 7).alias("value"))


@query(f"WITH {_INC}, w AS (SELECT l_orderkey AS element, sum(l_quantity) AS w FROM lineitem GROUP BY 1) SELECT node, round(sum(o_totalprice * w) / sum(w), 3) + 0.0 AS value FROM i JOIN orders ON o_orderkey = i.element JOIN w ON w.element = i.element GROUP BY node")
def project_volume_weighted(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("element")).agg(F.sum("l_quantity").alias("w"))
    values = table(spark, d, "orders").select(F.col("o_orderkey").alias("element"), F.col("o_totalprice").alias("value")).join(w, "element")
    return G.projected(incidence(spark, d), values, "w").select("node", r("value", 3).alias("value"))


@query(f"WITH {_INC}, v AS (SELECT node, avg(o_totalprice) AS value FROM i JOIN orders ON o_orderkey = element AND o_orderpriority = '1-URGENT' GROUP BY node) SELECT p_partkey AS node, coalesce(round(value, 7), -1.0) AS value FROM part LEFT JOIN v ON node = p_partkey")
def viz_scatter(spark, d):
    """Every node; -1 stands for the NaN of nodes without a value, which the two engines compare differently."""
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    values = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("element"), F.col("o_totalprice").alias("value"))
    out = G.scattered(nodes, incidence(spark, d), values)
    return out.select("node", F.when(F.isnan("value"), F.lit(-1.0)).otherwise(F.round("value", 7)).alias("value"))


@query(f"WITH {_INC} SELECT DISTINCT node FROM i WHERE element IN (1, 2, 3, 4, 5)")
def nodes_of_elems(spark, d):
    return G.nodes_of(incidence(spark, d), [1, 2, 3, 4, 5])


@query(f"WITH {_INC} SELECT DISTINCT element FROM i WHERE node IN (10, 20, 30)")
def elems_of_nodes(spark, d):
    return G.elements_of(incidence(spark, d), [10, 20, 30])


@query("SELECT DISTINCT l_partkey AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def nodes_of_material(spark, d):
    own = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("element"))
    return incidence(spark, d).join(own, "element", "left_semi").select("node").distinct()


@query("SELECT label AS material, count(*) AS n, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS labels FROM embeddings GROUP BY label")
def labels_by_material(spark, d):
    e = table(spark, d, "embeddings").groupBy(F.col("label").alias("material"))
    return e.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), ",").alias("labels"))


_D = "sqrt((x - 0.1) ** 2 + (y - 0.0) ** 2 + (z + 0.1) ** 2)"
_AT = (0.1, 0.0, -0.1)


@query(f"SELECT vec_id, round({_D}, 6) + 0.0 AS distance FROM ({_P}) ORDER BY {_D}, vec_id LIMIT 1")
def nearest_node(spark, d):
    return G.nearest(vectors(spark, d, ("x", "y", "z")), _AT, "vec_id").select("vec_id", r("distance", 6).alias("distance"))


@query(f"WITH c AS (SELECT vec_id // 8 AS element, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ({_P}) GROUP BY 1) SELECT element, round({_D}, 6) + 0.0 AS distance FROM c ORDER BY {_D}, element LIMIT 1")
def nearest_element(spark, d):
    c = vectors(spark, d, ("x", "y", "z")).groupBy(F.expr("vec_id div 8").alias("element")).agg(*[F.avg(x).alias(x) for x in "xyz"])
    return G.nearest(c, _AT, "element").select("element", r("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round({_D}, 6) + 0.0 AS distance FROM ({_P}) WHERE {_D} <= 0.25")
def radius_nodes(spark, d):
    return G.within(vectors(spark, d, ("x", "y", "z")), _AT, 0.25, "vec_id").select("vec_id", r("distance", 6).alias("distance"))


@query(f"SELECT 'element' AS kind, id FROM (SELECT DISTINCT vec_id // 8 AS id FROM ({_P}) WHERE {_D} <= 0.25) UNION ALL SELECT 'node', vec_id FROM ({_P}) WHERE {_D} <= 0.25")
def entities_near(spark, d):
    n = G.within(vectors(spark, d, ("x", "y", "z")), _AT, 0.25, "vec_id")
    elements = n.select(F.expr("vec_id div 8").alias("id")).distinct()
    return elements.select(F.lit("element").alias("kind"), "id").unionByName(n.select(F.lit("node").alias("kind"), F.col("vec_id").alias("id")))


@query(f"""WITH {_INC}, a AS (SELECT DISTINCT element FROM i WHERE node IN (SELECT node FROM i WHERE element = 7)),
b AS (SELECT DISTINCT element FROM i WHERE node IN (SELECT node FROM i WHERE element IN (SELECT element FROM a))) SELECT element FROM b WHERE element <> 7""")
def neighbor_elements_k2(spark, d):
    return G.ring(incidence(spark, d), [7], 2)


_QUADS = "q AS (SELECT vec_id AS cell, [vec_id, vec_id + 1, vec_id + 21, vec_id + 20] AS n FROM embeddings WHERE vec_id % 20 < 19)"


def _quads(spark, d):
    """A strip of quadrilaterals, 20 nodes a row."""
    e = table(spark, d, "embeddings").where("vec_id % 20 < 19")
    return e.select(F.col("vec_id").alias("cell"), F.col("vec_id").alias("n0"), (F.col("vec_id") + 1).alias("n1"), (F.col("vec_id") + 21).alias("n2"), (F.col("vec_id") + 20).alias("n3"))


@query(f"WITH {_QUADS}, s AS (SELECT n[k] AS a, n[k % 4 + 1] AS b FROM q, (SELECT unnest([1, 2, 3, 4]) AS k)) SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM s")
def unique_edges(spark, d):
    return G.edges(_quads(spark, d), 4)


@query(f"""WITH {_QUADS}, s AS (SELECT cell, n[k] AS a, n[k % 4 + 1] AS b FROM q, (SELECT unnest([1, 2, 3, 4]) AS k))
SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS shared, min(cell) AS owner, count(*) = 1 AS hull FROM s GROUP BY 1, 2""")
def hull_faces(spark, d):
    q = _quads(spark, d)
    sides = q.select("cell", F.explode(F.array(*[F.array(f"n{k}", f"n{(k + 1) % 4}") for k in range(4)])).alias("nodes"))
    return G.hull(sides).select(F.col("nodes")[0].alias("lo"), F.col("nodes")[1].alias("hi"), "shared", "owner", (F.col("shared") == 1).alias("hull"))


@query(f"SELECT label, {', '.join(f'round(min({c}), 6) + 0.0 AS min_{c}, round(max({c}), 6) + 0.0 AS max_{c}' for c in 'xyz')} FROM ({_P}) GROUP BY label")
def aabb(spark, d):
    v = vectors(spark, d, ("x", "y", "z")).groupBy("label")
    return v.agg(*[r(f(c), 6).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


@query("SELECT k AS level, round(lo + (hi - lo) * k / 6.0, 6) + 0.0 AS value FROM (SELECT min(CAST(embedding[1] AS DOUBLE)) AS lo, max(CAST(embedding[1] AS DOUBLE)) AS hi FROM embeddings), (SELECT unnest(range(1, 6)) AS k)")
def iso_levels(spark, d):
    v = vectors(spark, d, ("x",)).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    out = v.select(F.posexplode(K.levels(5, F.col("lo"), F.col("hi"))).alias("k", "value"))
    return out.select((F.col("k") + 1).cast("long").alias("level"), r("value", 6).alias("value"))


#: Five stops of a colour map, dark to bright.
STOPS = [(0.0, 0.0, 0.5), (0.0, 0.5, 1.0), (0.5, 1.0, 0.5), (1.0, 0.5, 0.0), (0.5, 0.0, 0.0)]


@query(f"""WITH t AS (SELECT vec_id, greatest(0.0, least(1.0, (x + 2.0) / 4.0)) * 4 AS p FROM ({_P})), i AS (SELECT vec_id, p, CAST(least(floor(p), 3) AS INTEGER) AS i FROM t)
SELECT vec_id, {", ".join(f"round([{', '.join(str(s[k]) for s in STOPS)}][i + 1] + ([{', '.join(str(s[k]) for s in STOPS)}][i + 2] - [{', '.join(str(s[k]) for s in STOPS)}][i + 1]) * (p - i), 6) + 0.0 AS {c}" for k, c in enumerate(("red", "green", "blue")))} FROM i""")
def colormap(spark, d):
    v = vectors(spark, d, ("x",))
    return v.select("vec_id", *[r(c, 6).alias(n) for n, c in zip(("red", "green", "blue"), K.colour(F.col("x"), F.lit(-2.0), F.lit(2.0), STOPS), strict=True)])


_SIDE = "((x - 0.1) * 0.6 + (y - 0.0) * 0.8)"


@query(f"SELECT vec_id, round({_SIDE}, 6) + 0.0 AS distance, CASE WHEN abs({_SIDE}) <= 1e-9 THEN 0 WHEN {_SIDE} > 0 THEN 1 ELSE -1 END AS side FROM ({_P})")
def plane_classify(spark, d):
    s = G.side((0.1, 0.0, 0.0), (0.6, 0.8, 0.0))
    return vectors(spark, d, ("x", "y", "z")).select("vec_id", r(s, 6).alias("distance"), F.when(F.abs(s) <= 1e-9, 0).when(s > 0, 1).otherwise(-1).alias("side"))


@query(f"""WITH s AS (SELECT vec_id, x, {_SIDE} AS d FROM ({_P})) SELECT a.vec_id AS lo, b.vec_id AS hi, round(a.d / (a.d - b.d), 5) + 0.0 AS t, round(a.x + (b.x - a.x) * (a.d / (a.d - b.d)), 5) + 0.0 AS x
FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 WHERE (a.d > 1e-9 AND b.d < -1e-9) OR (a.d < -1e-9 AND b.d > 1e-9)""")
def edge_intersections(spark, d):
    """Edges between consecutive nodes that cross the plane, and where."""
    s = vectors(spark, d, ("x", "y", "z")).select("vec_id", "x", G.side((0.1, 0.0, 0.0), (0.6, 0.8, 0.0)).alias("d"))
    b = s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("xb"), F.col("d").alias("db"))
    t = K.divide(F.col("d"), F.col("d") - F.col("db"))
    out = s.join(b, "vec_id").where("(d > 1e-9 and db < -1e-9) or (d < -1e-9 and db > 1e-9)")
    return out.select(F.col("vec_id").alias("lo"), (F.col("vec_id") + 1).alias("hi"), r(t, 5).alias("t"), r(F.col("x") + (F.col("xb") - F.col("x")) * t, 5).alias("x"))
