"""Queries on session logs, bound to the events: each event is a command of its user's session."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import table
from ..streaming import session as Z
from .registry import query, r

#: The command of an event by its number's rest, in SQL; ``m`` stands for the number.
_TEXT = {
    0: "'select brick ' || (m % 7 + 1) || '-9'", 1: "'select node 1-' || (m % 50)", 2: "'clrsel brick'", 3: "'show sx'", 4: "'show bad'", 5: "'show stress sy k=v'", 6: "'cutpln 0 1 2 0 3 ' || CASE WHEN m % 5 = 0 THEN '0' ELSE '4' END",
    7: "'disable brick ' || (m % 4)", 8: "'enable * ' || (m % 4)", 9: "'rot ' || (m % 30) || ' -5 0'", 10: "'zoom 2'", 11: "CASE WHEN m % 28 = 11 THEN 'clrsel *' ELSE 'view reset' END", 12: "'iso on sx count=' || (m % 3) || ' min=1 max=4'",
    13: "CASE WHEN m % 98 = 13 THEN 'close' ELSE 'iso off sx' END", 14: "'cutrpln 1 1 1 0 0 2 slice'", 15: "'translate 1 2 ' || (m % 3)", 16: "'load run' || (m % 9)", 17: "CASE WHEN m % 2 = 0 THEN 'state' ELSE 'frobnicate 1' END",
}
_CASE = "CASE event_id % 18 " + " ".join(f"WHEN {k} THEN {t}" for k, t in _TEXT.items()) + " END"
LOG = f"l AS (SELECT user_id AS session, event_id AS seq, event_id AS m, string_split({_CASE.replace('m %', 'event_id %')}, ' ') AS w FROM events), z AS (SELECT session, max(seq) AS z FROM l WHERE w[1] = 'close' GROUP BY 1), o AS (SELECT l.* FROM l LEFT JOIN z USING (session) WHERE z IS NULL OR seq > z)"


def log(spark, d):
    """(session, seq, verb, rest, words, options, kind, error)."""
    text = F.expr(_CASE.replace("m %", "event_id %").replace("||", "||"))
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), text.alias("line"))
    own = e.select("session", "seq", F.regexp_extract("line", r"^(\S+)", 1).alias("verb"), F.trim(F.regexp_replace("line", r"^\S+", "")).alias("rest"))
    return Z.checked(own)


@query(f"""WITH {LOG}, c AS (SELECT session, seq, w[1] AS verb, len(list_filter(w[2:], lambda x: NOT contains(x, '='))) AS n FROM l)
SELECT seq, verb, CASE WHEN verb = 'frobnicate' THEN 'unknown command verb frobnicate' WHEN verb = 'state' THEN 'state: missing arguments' END AS error, CAST(n AS INTEGER) AS words FROM c""")
def session_checked(spark, d):
    """Commands with their words and errors: unknown verbs, lost arguments."""
    return log(spark, d).select("seq", "verb", "error", F.size("words").alias("words"))


@query(f"WITH {LOG} SELECT session, arg_max(w[2], seq) AS root FROM o WHERE w[1] = 'load' GROUP BY session")
def session_loaded(spark, d):
    return Z.loaded(log(spark, d), "session", "seq")


@query(f"""WITH {LOG}, a AS (SELECT session, max(seq) AS a FROM o WHERE w[1] = 'clrsel' AND w[2] = '*' GROUP BY 1),
x AS (SELECT session, w[2] AS class, max(seq) AS seq, arg_max(CASE WHEN w[1] = 'select' THEN w[3] ELSE '' END, seq) AS range FROM o WHERE w[1] IN ('select', 'clrsel') AND w[2] <> '*' GROUP BY 1, 2)
SELECT x.session, class, range FROM x LEFT JOIN a USING (session) WHERE (a IS NULL OR seq > a) AND range <> ''""")
def session_selection(spark, d):
    """Ranges by class, after clearings of a class, of all, and closes."""
    return Z.selection(log(spark, d), "session", "seq")


@query(f"""WITH {LOG}, s AS (SELECT session, seq, w[2] AS result, CASE WHEN len(w) > 2 THEN w[3] ELSE '' END AS component FROM o WHERE w[1] = 'show' AND w[2] <> 'bad')
SELECT session, arg_max(result, seq) AS result, arg_max(component, seq) AS component FROM s GROUP BY session""")
def session_result(spark, d):
    """The last result that could be shown; one that nobody knows keeps what was there."""
    return Z.result(log(spark, d), "session", "seq", F.col("name").isin("sx", "sy"))


@query(f"""WITH {LOG}, p AS (SELECT session, CASE WHEN len(w) = 8 THEN 'slice' ELSE 'cut' END AS bucket, arg_max(w, seq) AS w FROM o WHERE w[1] IN ('cutpln', 'cutrpln') GROUP BY 1, 2)
SELECT session, bucket, round(CAST(w[6] AS DOUBLE) / n * s, 6) + 0.0 AS ny, round(CAST(w[7] AS DOUBLE) / n * s, 6) + 0.0 AS nz, CAST(w[2] AS DOUBLE) AS ox FROM
(SELECT *, sqrt(CAST(w[5] AS DOUBLE) ** 2 + CAST(w[6] AS DOUBLE) ** 2 + CAST(w[7] AS DOUBLE) ** 2) AS n, CASE w[1] WHEN 'cutrpln' THEN -1 ELSE 1 END AS s FROM p) WHERE n > 0""")
def session_planes(spark, d):
    """The cutting and the slicing plane of each session."""
    return Z.planes(log(spark, d), "session", "seq").select("session", "bucket", r(F.col("normal")[1], 6).alias("ny"), r(F.col("normal")[2], 6).alias("nz"), F.col("origin")[0].alias("ox"))


@query(f"WITH {LOG} SELECT session, CAST(w[3] AS INTEGER) AS material, arg_max(w[1], seq) = 'enable' AS visible FROM o WHERE w[1] IN ('enable', 'disable') GROUP BY 1, 2")
def session_materials(spark, d):
    return Z.hidden(log(spark, d), "session", "seq")


@query(f"""WITH {LOG}, i AS (SELECT session, arg_max(w, seq) AS w FROM o WHERE w[1] = 'iso' GROUP BY session), k AS (SELECT session, w[3] AS result, CAST(replace(w[4], 'count=', '') AS INTEGER) AS n FROM i WHERE w[2] = 'on')
SELECT session, result, array_to_string([round(1 + 3.0 * i / (n + 1), 4) FOR i IN range(1, n + 1)], ',') AS levels FROM k""")
def session_isosurface(spark, d):
    out = Z.isosurface(log(spark, d), "session", "seq")
    return out.select("session", "result", F.concat_ws(",", F.transform("levels", lambda x: F.round(x, 4).cast("string"))).alias("levels"))


@query(f"""WITH {LOG}, v AS (SELECT session, max(seq) AS v FROM o WHERE w[1] = 'view' GROUP BY 1), c AS (SELECT o.* FROM o LEFT JOIN v USING (session) WHERE (v IS NULL OR seq > v)),
s AS (SELECT DISTINCT session FROM o WHERE w[1] IN ('rot', 'translate', 'zoom', 'view')), t AS (SELECT session, sum(CASE WHEN w[1] = 'rot' THEN CAST(w[2] AS DOUBLE) ELSE 0 END) AS az, sum(CASE WHEN w[1] = 'rot' THEN -5 ELSE 0 END) AS el,
count(*) FILTER (WHERE w[1] = 'zoom') AS zooms, sum(CASE WHEN w[1] = 'translate' THEN CAST(w[4] AS DOUBLE) ELSE 0 END) AS fz FROM c GROUP BY session)
SELECT s.session, coalesce(az, 0) + 0.0 AS azimuth, CAST(coalesce(el, 0) AS DOUBLE) + 0.0 AS elevation, round(1.0 / (2.0 ** coalesce(zooms, 0)), 9) AS distance, coalesce(fz, 0) + 0.0 AS fz FROM s LEFT JOIN t USING (session)""")
def session_camera(spark, d):
    """Turns and moves add up and zooms divide since the last reset."""
    return Z.camera(log(spark, d), "session", "seq").select("session", "azimuth", "elevation", F.round("distance", 9).alias("distance"), "fz")


@query("WITH " + LOG + """, s AS (SELECT session, CASE w[1] WHEN 'load' THEN 'LOADED' WHEN 'zoom' THEN 'CAMERA' END AS kind, w[2] AS value, seq FROM l WHERE w[1] IN ('load', 'zoom'))
SELECT session, 0 AS seq, 'LOADED' AS kind, arg_max(w[2], seq) AS value FROM o WHERE w[1] = 'load' GROUP BY session UNION ALL SELECT session, seq, kind, value FROM s""")
def session_subscription(spark, d):
    """A snapshot first, then the changes of the kinds asked for."""
    own = log(spark, d)
    snapshot = Z.loaded(own, "session", "seq").select("session", F.lit("LOADED").alias("kind"), F.col("root").alias("value"))
    changes = own.where("verb in ('load', 'zoom')").select("session", "seq", "kind", F.col("words")[0].alias("value"))
    return Z.subscribed(changes, snapshot, ["LOADED", "CAMERA"])


@query("SELECT user_id AS session, CAST(event_id % 30 + 1 AS INTEGER) AS state, round(arg_max(value, event_id), 4) + 0.0 AS value FROM events GROUP BY 1, 2")
def state_history(spark, d):
    """The latest sample of each state."""
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 30 + 1).cast("int").alias("state"), "value")
    return Z.history(e, ["session"], "state", "seq", "value").select("session", "state", r("value").alias("value"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events")
def command_numbers(spark, d):
    return Z.numbered(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id").select("event_id", F.col("seq").cast("long").alias("seq"))
