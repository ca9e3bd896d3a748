"""Queries on corpora of conversations, sessions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..sources import table
from ..streaming import session as Z, windows as W
from .registry import query, r

_NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS normal FROM documents")
def norm_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(C.normal(F.col("text"))).alias("normal"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORM.format('text')}")
def dedup_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(C.normal(F.col("text")), 256).alias("key"))
    return C.first_of(docs, ["key"], "doc_id").select("doc_id")


@query("""SELECT lang, source, n FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c, row_number() OVER (PARTITION BY lang ORDER BY n, source) AS k
FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE c > 1 AND k = 1""")
def split_cells(spark, d):
    return C.held_out(table(spark, d, "documents"), "lang", "source")


@query("""SELECT doc_id, lang, CASE WHEN k <= greatest(0, least(n - 1, round_even(n * 0.1, 0))) THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents)""")
def stratified_val(spark, d):
    return C.stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.1, 42)


@query("""SELECT source, min(CASE WHEN quality = 1 THEN doc_id END) AS chosen, min(CASE WHEN quality = 0 THEN doc_id END) AS rejected
FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING chosen IS NOT NULL AND rejected IS NOT NULL""")
def pref_pairs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return C.pairs(rows, "source", F.col("quality") == 1, "doc_id")


@query(rf"""WITH w AS (SELECT 'd' AS side, doc_id AS id, list_filter(string_split({_NORM.format('text')}, ' '), lambda x: x <> '') AS ws FROM documents
UNION ALL SELECT 'b', item_id, list_filter(string_split({_NORM.format('text')}, ' '), lambda x: x <> '') FROM benchmark),
g AS (SELECT DISTINCT side, id, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8))
SELECT a.id AS doc_id, b.id AS item_id, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.side = 'd' AND b.side = 'b' GROUP BY 1, 2""")
def contamination(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return C.shared_ngrams(docs, table(spark, d, "benchmark"), 8)


@query("""WITH t AS (SELECT lang, n_chars AS tokens, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, count(*) AS n, min(tokens) AS least, CAST(floor(median(tokens)) AS BIGINT) AS p50, max(CASE WHEN k = round_even(0.95 * (n - 1), 0) THEN tokens END) AS p95, max(tokens) AS most,
CAST(sum(CASE WHEN tokens > 4096 THEN 1 ELSE 0 END) AS BIGINT) AS over FROM t GROUP BY lang""")
def token_budget(spark, d):
    return C.budget(table(spark, d, "documents"), "lang", "n_chars", 4096)


@query("SELECT tier, count(doc_id) AS n FROM (SELECT unnest([0, 1, 2, 3]) AS tier) LEFT JOIN (SELECT doc_id, quality + toxic AS t FROM labels) ON t = tier GROUP BY tier")
def tier_histogram(spark, d):
    rows = table(spark, d, "labels").select((F.col("quality") + F.col("toxic")).alias("tier"))
    return C.histogram(rows, "tier", [0, 1, 2, 3], spark)


@query("SELECT lang, round(avg(CAST(any_good AS INTEGER)), 6) + 0.0 AS retained FROM (SELECT lang, source, bool_or(quality = 1) AS any_good FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) GROUP BY lang")
def retention_any(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    cells = rows.groupBy("lang", "source").agg(F.bool_or(F.col("quality") == 1).alias("good"))
    return cells.groupBy("lang").agg(r(F.avg(F.col("good").cast("int")), 6).alias("retained"))


#: Price of a thousand characters by role; a role without one costs nothing (fixed values).
PRICES = {"user": 0.003, "assistant": 0.015}


@query("SELECT conv_id, round(sum(length(text) / 1000.0 * CASE role WHEN 'user' THEN 0.003 WHEN 'assistant' THEN 0.015 ELSE 0 END), 6) + 0.0 AS cost FROM conversations GROUP BY conv_id")
def cost_estimate(spark, d):
    price = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRICES.items() for x in kv]), F.col("role")), F.lit(0.0))
    return table(spark, d, "conversations").groupBy("conv_id").agg(r(F.sum(F.length("text") / 1000.0 * price), 6).alias("cost"))


@query("""SELECT conv_id, turn, (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant' AND b.turn > a.turn) AS answer FROM conversations a WHERE role = 'user'""")
def tool_response_join(spark, d):
    return C.answered(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")


@query("""SELECT conv_id, CASE WHEN l = 'assistant' THEN t ELSE t || ',assistant' END AS turns, l <> 'assistant' AS appended FROM
(SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS t, arg_max(role, turn) AS l FROM conversations GROUP BY conv_id)""")
def terminate_append(spark, d):
    return C.terminated(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query("SELECT conv_id, turn, substr(sha256(text), 1, 16) AS hash FROM conversations")
def prompt_hash(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))


_SCRIPT = "'load run' || user_id || chr(10) || 'state ' || (event_id % 30) || '; next # go on' || chr(10) || event_type || ' ' || CAST(event_id AS VARCHAR) || ';;'"


@query(rf"""WITH s AS (SELECT event_id, {_SCRIPT} AS script FROM events), l AS (SELECT event_id, unnest(string_split_regex(script, '[;\n]')) AS line, generate_subscripts(string_split_regex(script, '[;\n]'), 1) - 1 AS place FROM s),
c AS (SELECT event_id, place, trim(regexp_replace(line, '#.*$', '')) AS line FROM l)
SELECT event_id, CAST(place AS INTEGER) AS place, lower(regexp_extract(line, '^(\S+)', 1)) AS verb, trim(regexp_replace(line, '^\S+', '')) AS rest FROM c WHERE line <> ''""")
def raw_parse(spark, d):
    script = F.concat(F.lit("load run"), F.col("user_id"), F.lit("\nstate "), F.col("event_id") % 30, F.lit("; next # go on\n"), F.col("event_type"), F.lit(" "), F.col("event_id"), F.lit(";;"))
    return Z.parsed(table(spark, d, "events").select("event_id", script.alias("script")), "event_id", "script")


@query("SELECT user_id AS session, event_type AS kind, round(arg_max(value, event_id), 4) + 0.0 AS value FROM events GROUP BY 1, 2")
def state_fold(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), "value")
    return Z.folded(log, "session", "seq", "kind", "value").select("session", "kind", r("value").alias("value"))


_VERBS = ["load", "next", "select", "show", "iso", "enable", "rot", "hello"]


@query(f"""WITH l AS (SELECT event_id AS seq, [{', '.join(f"'{v}'" for v in _VERBS)}][event_id % 8 + 1] AS verb FROM events)
SELECT seq, verb, CASE verb WHEN 'next' THEN 'STATE' ELSE 'SELECTION' END AS kind FROM l WHERE verb IN ('next', 'select')""")
def delta_filter(spark, d):
    """A subscription to two kinds of change."""
    verbs = F.array(*map(F.lit, _VERBS))
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.element_at(verbs, (F.col("event_id") % 8 + 1).cast("int")).alias("verb"))
    return log.withColumn("kind", Z.delta(F.col("verb"))).where(F.col("kind").isin("STATE", "SELECTION"))


@query("""WITH RECURSIVE l AS (SELECT user_id AS session, event_type AS verb, event_id % 30 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
w AS (SELECT session, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS pos FROM (SELECT DISTINCT session FROM l)
UNION ALL SELECT w.session, l.k, greatest(1, least(30, CASE l.verb WHEN 'click' THEN pos + 1 WHEN 'view' THEN pos - 1 WHEN 'signup' THEN 1 WHEN 'error' THEN 30 ELSE l.n END)) FROM w JOIN l ON l.session = w.session AND l.k = w.k + 1)
SELECT session, arg_max(pos, k) AS cursor FROM w GROUP BY session""")
def cursor_clamp(spark, d):
    verb = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "next", "view", "prev", "signup", "first", "error", "last", "purchase", "state")]), F.col("event_type"))
    log = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), verb.alias("verb"), (F.col("event_id") % 30).alias("n"))
    return Z.cursor(log, 30)


@query("SELECT CAST(epoch(time_bucket(INTERVAL '6 hours', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 3) + 0.0 AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    out = W.tumbling(table(spark, d, "events"), "6 hours", ["event_type"], "value")
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", r("total", 3).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    return W.sessions(table(spark, d, "events"), "12 hours", "user_id").select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_dedup_watermark(spark, d):
    return W.deduplicated(table(spark, d, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type")
