"""Queries on fields: selections, names, reductions, running extrema and stencils."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modifiers as M, select as S
from ..sources import field, raw_field, table, vectors
from .registry import DENSE, FIELD, STATES, TOTAL, query, r


def _out(df, *more):
    return df.select("state", "label", *more, r("value").alias("value"))


@query(f"WITH {FIELD} SELECT state, label, round(value, 4) + 0.0 AS value FROM f WHERE class = 'click'")
def primal_scan(spark, d):
    return _out(field(spark, d).where("class = 'click'"))


@query(f"WITH {TOTAL} SELECT state, label, round(value, 4) + 0.0 AS value FROM f WHERE label IN (3, 5, 8, 999999)")
def filter_labels(spark, d):
    return _out(S.by_labels(field(spark, d, False), [3, 5, 8, 999999]))


@query(f"WITH {TOTAL} SELECT state, label, round(value, 4) + 0.0 AS value FROM f WHERE state IN (1, 29, 30)")
def filter_states_negative(spark, d):
    return _out(S.by_states(field(spark, d, False), [-1, 1, -2, -1], STATES))


@query(f"WITH {TOTAL} SELECT state, label, round(value, 4) + 0.0 AS value FROM f WHERE label BETWEEN 1 AND 10 OR label = 15")
def filter_range_string(spark, d):
    return _out(S.by_range(field(spark, d, False), "1-10,15"))


@query("SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS value FROM embeddings WHERE label = 3")
def filter_material(spark, d):
    v = vectors(spark, d, ("value",))
    elements = v.select(F.col("vec_id").alias("label"), F.col("label").alias("material"))
    rows = S.by_material(v.select(F.col("vec_id").alias("label"), "value"), elements, 3)
    return rows.select(F.col("label").alias("vec_id"), F.lit(3).alias("label"), r("value", 6).alias("value"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS value FROM embeddings WHERE label = 3 AND (vec_id BETWEEN 0 AND 200)")
def filter_labels_and_material(spark, d):
    v = vectors(spark, d, ("value",))
    elements = v.select(F.col("vec_id").alias("label"), F.col("label").alias("material"))
    rows = S.by_range(S.by_material(v.select(F.col("vec_id").alias("label"), "value"), elements, 3), "0-200")
    return rows.select(F.col("label").alias("vec_id"), r("value", 6).alias("value"))


@query("SELECT DISTINCT p_type FROM part WHERE p_type LIKE 'A%' OR starts_with(p_type, 'S')")
def parameter_prefix(spark, d):
    return table(spark, d, "part").where(F.col("p_type").startswith("A") | F.col("p_type").startswith("S")).select("p_type").distinct()


@query("SELECT vec_id, round(CAST(embedding[2] AS DOUBLE), 6) + 0.0 AS sy FROM embeddings")
def vector_component(spark, d):
    return table(spark, d, "embeddings").select("vec_id", r(S.component("embedding", "stress[sy]", ("sx", "sy", "sz")).cast("double"), 6).alias("sy"))


@query("SELECT vec_id, round(CAST(embedding[19] AS DOUBLE), 6) + 0.0 AS value FROM embeddings")
def array_subscript(spark, d):
    """The array has 4 x 16 atoms: [2,3] is the nineteenth."""
    return table(spark, d, "embeddings").select("vec_id", r(S.component("embedding", "a[2,3]", dims=(4, 16)).cast("double"), 6).alias("value"))


@query("""SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS "sx ipt. 1", round(CAST(embedding[7] AS DOUBLE), 6) + 0.0 AS "sx ipt. 4",
round(CAST(embedding[2] AS DOUBLE), 6) + 0.0 AS "sy ipt. 1", round(CAST(embedding[8] AS DOUBLE), 6) + 0.0 AS "sy ipt. 4" FROM embeddings""")
def ip_filter(spark, d):
    atoms = S.integration_points("embedding", [4, 1, 9], [1, 2, 3, 4], ("sx", "sy"))
    return table(spark, d, "embeddings").select("vec_id", *[r(c.cast("double"), 6).alias(n) for n, c in atoms.items()])


@query("""SELECT vec_id, 'v[' || i || ']' AS component, round(CAST(embedding[i] AS DOUBLE), 6) + 0.0 AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def leaf_expand(spark, d):
    return S.leaves(table(spark, d, "embeddings"), "embedding", "v", ["vec_id"]).select("vec_id", "component", r("value", 6).alias("value"))


def _pick(order: str) -> str:
    return f"WITH {TOTAL} SELECT state, label, round(value, 4) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY value {order}, label) AS n FROM f) WHERE n = 1"


@query(_pick("ASC"))
def mod_min(spark, d):
    return _out(M.extreme(field(spark, d, False), False, ["state"]))


@query(_pick("DESC"))
def mod_max(spark, d):
    return _out(M.extreme(field(spark, d, False), True, ["state"]))


@query(f"WITH {FIELD} SELECT class, state, round(avg(value), 10) + 0.0 AS value FROM f GROUP BY class, state")
def mod_average(spark, d):
    return M.reduced(field(spark, d), "average", ["class", "state"]).select("class", "state", r("value", 10).alias("value"))


@query(f"WITH {FIELD} SELECT class, state, round(median(value), 4) + 0.0 AS value FROM f GROUP BY class, state")
def mod_median(spark, d):
    return M.reduced(field(spark, d), "median", ["class", "state"]).select("class", "state", r("value").alias("value"))


@query(f"WITH {FIELD} SELECT class, state, round(stddev_pop(value), 4) + 0.0 AS value FROM f GROUP BY class, state")
def mod_stddev(spark, d):
    return M.reduced(field(spark, d), "stddev", ["class", "state"]).select("class", "state", r("value").alias("value"))


@query(f"WITH {TOTAL} SELECT state, label, round(min(value) OVER (PARTITION BY label ORDER BY state), 4) + 0.0 AS value FROM f")
def cummin(spark, d):
    return _out(M.running(field(spark, d, False), False, ["label"]))


@query(f"WITH {TOTAL} SELECT state, label, round(max(value) OVER (PARTITION BY label ORDER BY state), 4) + 0.0 AS value FROM f")
def cummax(spark, d):
    return _out(M.running(field(spark, d, False), True, ["label"]))


def _dense(spark, d):
    return M.dense(field(spark, d, False), STATES, ["label"])


@query(f"WITH {DENSE} SELECT state, label, round(coalesce(value - lag(value) OVER w, 0.0), 4) + 0.0 AS velocity FROM g WINDOW w AS (PARTITION BY label ORDER BY state)")
def velocity(spark, d):
    return M.velocity(_dense(spark, d), ["label"]).select("state", "label", r("velocity").alias("velocity"))


@query(f"""WITH {DENSE} SELECT state, label, round(CASE WHEN state = 1 THEN lead(value, 2) OVER w - 2 * lead(value) OVER w + value
WHEN state = 30 THEN value - 2 * lag(value) OVER w + lag(value, 2) OVER w ELSE lead(value) OVER w - 2 * value + lag(value) OVER w END, 4) + 0.0 AS acceleration
FROM g WINDOW w AS (PARTITION BY label ORDER BY state)""")
def acceleration(spark, d):
    return M.acceleration(_dense(spark, d), STATES, ["label"]).select("state", "label", r("acceleration").alias("acceleration"))


@query(f"""WITH {DENSE} SELECT state, label, round(CASE WHEN state = 1 THEN 0.0 WHEN state = 30 THEN value - lag(value) OVER w
ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END, 3) + 0.0 AS rate FROM g WINDOW w AS (PARTITION BY label ORDER BY state)""")
def rate_eps(spark, d):
    return M.rate(_dense(spark, d), STATES, ["label"]).select("state", "label", r("rate", 3).alias("rate"))


_MOVING = "p AS (SELECT vec_id // 5 AS label, CAST(vec_id % 5 AS INTEGER) AS state, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def _moving(spark, d):
    v = vectors(spark, d, ("x", "y", "z"))
    return v.select(F.expr("vec_id div 5").alias("label"), (F.col("vec_id") % 5).cast("int").alias("state"), "x", "y", "z")


@query(f"WITH {_MOVING} SELECT p.label, p.state, round(p.x - q.x, 6) + 0.0 AS disp_x, round(p.y - q.y, 6) + 0.0 AS disp_y, round(p.z - q.z, 6) + 0.0 AS disp_z FROM p JOIN p q ON p.label = q.label AND q.state = 0")
def disp_component(spark, d):
    u = M.from_reference(_moving(spark, d), 0, ["label"], ["x", "y", "z"])
    return u.select("label", "state", *[r(c, 6).alias(f"disp_{c}") for c in ("x", "y", "z")])


@query(f"""WITH {_MOVING} SELECT p.label, p.state, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 6) + 0.0 AS disp_mag,
round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 6) + 0.0 AS disp_rad_mag_xy FROM p JOIN p q ON p.label = q.label AND q.state = 0""")
def disp_magnitude(spark, d):
    from ..functions.kernels import magnitude

    u = M.from_reference(_moving(spark, d), 0, ["label"], ["x", "y", "z"])
    return u.select("label", "state", r(magnitude(F.col("x"), F.col("y"), F.col("z")), 6).alias("disp_mag"), r(magnitude(F.col("x"), F.col("y")), 6).alias("disp_rad_mag_xy"))


@query("""WITH c AS (SELECT label, CAST(vec_id % 5 AS INTEGER) AS state, avg(CAST(embedding[1] AS DOUBLE)) AS x FROM embeddings GROUP BY ALL)
SELECT c.label, c.state, round(c.x - q.x, 6) + 0.0 AS mat_cog_disp_x FROM c JOIN c q ON c.label = q.label AND q.state = 0""")
def cog_disp(spark, d):
    v = vectors(spark, d, ("x",)).withColumn("state", (F.col("vec_id") % 5).cast("int"))
    c = v.groupBy("label", "state").agg(F.avg("x").alias("x"))
    return M.from_reference(c, 0, ["label"], ["x"]).select("label", "state", r("x", 6).alias("mat_cog_disp_x"))


@query("WITH f AS (SELECT CAST(event_id % 4 AS INTEGER) AS frag, sum(value) AS v FROM events GROUP BY ALL) SELECT frag, round(v, 3) + 0.0 AS value FROM f")
def per_fragment(spark, d):
    return raw_field(spark, d).groupBy("frag").agg(r(F.sum("value"), 3).alias("value"))
