"""Queries on what merges the fragments' answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as U
from ..sources import table
from ..sources.binding import mesh
from .database import ELEMENTS, NODES, S, _node
from .registry import query, r

_ROWS = "d AS (SELECT CAST(event_id % 4 AS INTEGER) AS frag, event_id // 4 AS place, event_type AS key, user_id AS value FROM events)"


def _rows(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("event_id") % 4).cast("int").alias("frag"), F.expr("event_id div 4").alias("place"), F.col("event_type").alias("key"), F.col("user_id").alias("value"))


@query(f"WITH {_ROWS} SELECT key, row_number() OVER (PARTITION BY key ORDER BY frag, place, value) - 1 AS place, value FROM d")
def merge_concat(spark, d):
    """Values by key, fragment after fragment."""
    return U.concatenated(_rows(spark, d)).select("key", F.col("place").cast("long").alias("place"), "value")


@query(f"""WITH {_ROWS}, f AS (SELECT key, value, frag, place, row_number() OVER (PARTITION BY key, value ORDER BY frag, place) AS k FROM d)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY frag, place, value) - 1 AS place, value FROM f WHERE k = 1""")
def merge_concat_unique(spark, d):
    """Each value once by key, in the order of its first appearance."""
    return U.concatenated(_rows(spark, d), unique=True).select("key", F.col("place").cast("long").alias("place"), "value")


@query(f"WITH {_ROWS}, z AS (SELECT key, min(frag) AS frag FROM d GROUP BY key) SELECT d.key, d.frag, d.place, d.value FROM d JOIN z ON z.key = d.key AND z.frag = d.frag")
def merge_zeroth(spark, d):
    return U.zeroth(_rows(spark, d)).select("key", "frag", "place", "value")


@query(f"WITH {_ROWS}, g AS (SELECT key, frag, max(CASE WHEN value > 10 THEN 'INVALID' ELSE key || frag END) AS value FROM d GROUP BY 1, 2) SELECT key, coalesce(arg_min(value, frag) FILTER (WHERE value <> 'INVALID'), 'INVALID') AS value FROM g GROUP BY key")
def merge_first_valid(spark, d):
    """The first fragment's valid answer."""
    g = _rows(spark, d).groupBy("key", "frag").agg(F.max(F.when(F.col("value") > 10, "INVALID").otherwise(F.concat("key", F.col("frag").cast("string")))).alias("value"))
    return U.first_valid(g, "INVALID")


@query(f"WITH {NODES} SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_pos FROM (SELECT DISTINCT k + 1 AS label FROM pn)")
def merge_label_order(spark, d):
    """Ghosts repeat labels, so the merged order is by label."""
    rows = mesh(spark, d).nodes_table.select("frag", F.col("ordinal").alias("place"), "label")
    return U.rows_of_all(rows).select("label", F.col("label_pos").cast("long").alias("label_pos"))


@query(f"WITH {NODES}, {ELEMENTS} SELECT label, row_number() OVER (ORDER BY frag, label) - 1 AS label_pos FROM el WHERE class = 'brick'")
def merge_rank_order(spark, d):
    """No brick repeats, so the fragments' order stays."""
    rows = mesh(spark, d).elements.where("class = 'brick'").select("frag", F.col("ordinal").alias("place"), "label")
    return U.rows_of_all(rows).select("label", F.col("label_pos").cast("long").alias("label_pos"))


@query("""WITH c AS (SELECT user_id AS call, CASE event_id % 7 WHEN 0 THEN CASE WHEN user_id % 3 = 0 THEN 'CRITICAL' ELSE 'ERROR' END WHEN 1 THEN 'ERROR' ELSE CASE WHEN user_id % 5 = 0 THEN 'ERROR' ELSE 'OK' END END AS code FROM events)
SELECT call, bool_or(code = 'CRITICAL') OR bool_and(code = 'ERROR') AS failed FROM c GROUP BY call""")
def return_codes(spark, d):
    """Calls that fail as a whole: by one critical code, or by errors in every fragment."""
    k, u = F.col("event_id") % 7, F.col("user_id")
    code = F.when(k == 0, F.when(u % 3 == 0, "CRITICAL").otherwise("ERROR")).when(k == 1, "ERROR").otherwise(F.when(u % 5 == 0, "ERROR").otherwise("OK"))
    return U.outcome(table(spark, d, "events").select(u.alias("call"), code.alias("code")))


@query(f"""WITH {NODES}, {S}, {_node()}, c AS (SELECT e.k + 1 AS label, n.state, coalesce(n.x, CAST(e.x[1] AS DOUBLE)) AS x FROM e LEFT JOIN n ON n.label = e.k + 1 AND n.state = 3 AND n.label % 2 = 0) SELECT label, round(x, 6) + 0.0 AS x FROM c""")
def deformed_nodes(spark, d):
    """Coordinates in a state, and the first ones of nodes that it does not have."""
    db = mesh(spark, d)
    now = db.variable_values("nodpos", "node", 3).where("label % 2 = 0").dropDuplicates(["label"]).select("label", F.col("values")[0].alias("now"))
    return db.nodes().join(now, "label", "left").select("label", r(F.coalesce("now", F.col("x").cast("double")), 6).alias("x"))


@query(f"""WITH {NODES}, {ELEMENTS}, v AS (SELECT el.label, CAST(e.x[3] AS DOUBLE) AS v FROM el JOIN e ON e.k = (el.label - 1) * 8 WHERE class = 'brick'), a AS (SELECT node, avg(v) AS v FROM v JOIN ex ON ex.class = 'brick' AND ex.label = v.label GROUP BY node)
SELECT e.k + 1 AS node, round(a.v, 6) + 0.0 AS value, round(min(a.v) OVER (), 6) + 0.0 AS lo, round(max(a.v) OVER (), 6) + 0.0 AS hi FROM e LEFT JOIN a ON a.node = e.k + 1""")
def vertex_scalars(spark, d):
    """A result scattered to the nodes, none where no element has it, with the finite range."""
    from ..database import query as select
    from ..operators import mesh as G

    db = mesh(spark, d)
    values = select(db, "sx", "brick", states=3).select(F.col("label").alias("element"), "value")
    inc = db.connectivity("brick").select(F.col("label").alias("element"), F.explode("nodes").alias("node"))
    out = G.scattered(db.nodes().select(F.col("label").alias("node")), inc, values)
    finite = F.when(~F.isnan("value"), F.col("value"))
    span = out.agg(r(F.min(finite), 6).alias("lo"), r(F.max(finite), 6).alias("hi"))
    return out.crossJoin(F.broadcast(span)).select("node", r(finite, 6).alias("value"), "lo", "hi")  # one row
