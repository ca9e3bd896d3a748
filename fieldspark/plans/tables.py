"""Queries on merging, writing and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as U
from ..sources import field, raw_field, table
from .registry import FIELD, STATES, TOTAL, query, r


@query("""SELECT state, label, frag, round(value, 4) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY state, label ORDER BY frag, event_id) AS n FROM
(SELECT CAST(event_id % 4 AS INTEGER) AS frag, event_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) + 1 AS state, user_id AS label, value FROM events)) WHERE n = 1""")
def fragment_merge_dedup(spark, d):
    return U.first_by(raw_field(spark, d), ["state", "label"], ["frag", "event_id"]).select("state", "label", "frag", r("value").alias("value"))


@query("SELECT user_id AS label, min(event_id) AS first_seen FROM events GROUP BY user_id")
def labels_union_unique(spark, d):
    """Labels of all fragments, each once, with the place of its first appearance."""
    return raw_field(spark, d).groupBy("label").agg(F.min("event_id").alias("first_seen"))


@query("SELECT user_id AS label, round(arg_max(value, event_id), 4) + 0.0 AS value FROM events GROUP BY user_id")
def last_wins_merge(spark, d):
    return U.last_wins(raw_field(spark, d), "label", "value", "event_id").select("label", r("value").alias("value"))


@query("SELECT user_id AS label FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def intersect_labels(spark, d):
    e = raw_field(spark, d)
    return e.where("class = 'purchase'").select("label").intersect(e.where("class = 'error'").select("label"))


@query("SELECT DISTINCT user_id AS label FROM events WHERE value > 50 EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90")
def setdiff_labels(spark, d):
    e = raw_field(spark, d)
    return e.where("value > 50").select("label").subtract(e.where("class = 'error' and value > 90").select("label"))


@query(f"WITH {TOTAL} SELECT state, label, round(CASE WHEN state = 3 AND label % 2 = 0 THEN label * 1.5 ELSE value END, 4) + 0.0 AS value FROM f")
def update_values(spark, d):
    f = field(spark, d, False)
    new = f.where("state = 3 and label % 2 = 0").select("state", "label", (F.col("label") * 1.5).alias("value"))
    return U.updated(f, new, ["state", "label"]).select("state", "label", r("value").alias("value"))


@query(f"WITH {TOTAL} SELECT state, label, round(value, 4) + 0.0 AS value FROM f UNION ALL SELECT 31, label, 0.0 FROM f WHERE state = 30")
def append_state(spark, d):
    """A new state after the last, zeroed, for the labels of the last."""
    f = field(spark, d, False)
    new = f.where(F.col("state") == STATES).select(F.lit(STATES + 1).alias("state"), "label", F.lit(0.0).alias("value"))
    return f.select("state", "label", r("value").alias("value")).unionByName(new)


@query("SELECT event_type AS class, count(DISTINCT user_id) AS labels, count(DISTINCT CAST(ts AS DATE)) AS states FROM events GROUP BY 1")
def copy_metadata(spark, d):
    """What a copy without states keeps: classes and how many labels they have; and the states that it leaves."""
    return raw_field(spark, d).groupBy("class").agg(F.countDistinct("label").alias("labels"), F.countDistinct("state").alias("states"))


@query(f"WITH {TOTAL} SELECT state, " + ", ".join(f'round(sum(CASE WHEN label = {k} THEN value END), 4) + 0.0 AS "{k}"' for k in (1, 2, 3)) + " FROM f WHERE label IN (1, 2, 3) GROUP BY state")
def pivot_states_labels(spark, d):
    p = U.pivoted(field(spark, d, False).where("label in (1, 2, 3)"), "state", "label", [1, 2, 3])
    return p.select("state", *[r(F.col(f"`{k}`")).alias(str(k)) for k in (1, 2, 3)])


@query("SELECT l_orderkey, l_linenumber, l_partkey, component, round(value, 4) + 0.0 AS value FROM (SELECT l_orderkey, l_linenumber, l_partkey, unnest(['l_quantity', 'l_discount', 'l_tax']) AS component, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem)")
def unpivot(spark, d):
    li = table(spark, d, "lineitem")
    out = U.unpivoted(li, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "component", r("value").alias("value"))


@query(f"WITH {FIELD} SELECT class, round(min(value), 4) + 0.0 AS lo, round(max(value), 4) + 0.0 AS hi FROM f WHERE isfinite(value) GROUP BY class")
def finite_range(spark, d):
    f = field(spark, d).where(~F.isnan("value") & (F.abs("value") < float("inf")))
    return f.groupBy("class").agg(r(F.min("value")).alias("lo"), r(F.max("value")).alias("hi"))
