"""Queries on rollouts, bound to the conversations: each assistant turn is a call, answered or not by a tool message."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollouts as R
from ..sources import table
from .registry import query, r

TOOLS = ("load", "set_state", "show", "nosuch", "select")
SCHEMAS = {"load": {"root": ("string", True)}, "set_state": {"state": ("integer", True)}, "show": {"result": ("string", True), "fine": ("boolean", False)}, "select": {"class_name": ("string", True), "range": ("string", True), "missing": ("string", True)}}


def recorded(spark, d):
    """(conv_id, intent, kind, expect, messages): one call for each assistant turn; every ninth conversation is stopped by the driver, two of three end in text."""
    t = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn")
    k = F.col("conv_id") + F.col("turn")
    name = F.element_at(F.array(*map(F.lit, TOOLS)), (k % 5 + 1).cast("int"))
    args = F.when((F.col("conv_id") * 7 + F.col("turn")) % 6 == 0, F.lit("{bad")).otherwise(F.concat(F.lit('{"state": "'), k.cast("string"), F.lit('", "root": "r", "result": "sx", "class_name": "brick", "range": "1-3"}')))
    answer = F.when(k % 4 == 0, F.concat(F.lit('{"ok": false, "error_kind": "'), F.when(F.col("turn") % 3 == 0, "state_out_of_range").otherwise("odd"), F.lit('"}'))).otherwise(
        F.concat(F.lit('{"ok": true, "result": "'), F.when(k % 2 == 0, "sx").otherwise("sy"), F.lit('", "state": '), k.cast("string"), F.lit("}")))
    call_id = F.concat(F.lit("c"), F.col("turn").cast("string"))
    none = F.lit(None).cast("string")
    no_calls = F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")
    asked = F.struct(F.lit("assistant").alias("role"), none.alias("content"), none.alias("tool_call_id"), F.array(F.struct(call_id.alias("id"), name.alias("name"), args.alias("arguments"))).alias("tool_calls"))
    told = F.struct(F.lit("tool").alias("role"), answer.alias("content"), call_id.alias("tool_call_id"), no_calls.alias("tool_calls"))
    pair = t.select("conv_id", "turn", F.when(k % 7 == 0, F.array(asked)).otherwise(F.array(asked, told)).alias("m"))
    # a conversation has few turns
    own = pair.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"])).alias("messages"))

    def text(role: str, content: str):
        return F.array(F.struct(F.lit(role).alias("role"), F.lit(content).alias("content"), none.alias("tool_call_id"), no_calls.alias("tool_calls")))

    own = own.withColumn("messages", F.when(F.col("conv_id") % 3 != 0, F.concat("messages", text("assistant", "Here it is."))).otherwise(F.col("messages")))
    own = own.withColumn("messages", F.when(F.col("conv_id") % 9 == 0, F.concat("messages", text("system", "stop:step_cap_hit"))).otherwise(F.col("messages")))
    by_state = F.col("conv_id") % 2 == 0
    last = F.when(by_state, F.concat(F.lit('{"state": '), (F.col("conv_id") + F.col("conv_id") % 8).cast("string"), F.lit("}"))).otherwise(F.lit('{"result": "sx"}'))
    return own.select("conv_id", F.concat(F.lit("i"), (F.col("conv_id") % 5).cast("string")).alias("intent"), F.when(by_state, "state_index").otherwise("active_result").alias("kind"), last.alias("expect"), "messages")


#: The calls in SQL, with each one's tier and label.
CALLS = """c AS (SELECT conv_id, turn, conv_id + turn AS k, ['load', 'set_state', 'show', 'nosuch', 'select'][(conv_id + turn) % 5 + 1] AS name, (conv_id * 7 + turn) % 6 = 0 AS bad, (conv_id + turn) % 7 <> 0 AS told, (conv_id + turn) % 4 <> 0 AS ok
FROM conversations WHERE role = 'assistant'), g AS (SELECT *, CASE WHEN bad THEN 'parse_error' WHEN name = 'nosuch' THEN 'unknown_tool' WHEN name = 'select' THEN 'schema_mismatch' WHEN NOT told THEN 'dispatch_error'
WHEN NOT ok THEN CASE WHEN turn % 3 = 0 THEN 'state_out_of_range' ELSE 'dispatch_error' END END AS label FROM c),
h AS (SELECT *, CASE WHEN label IS NULL THEN 2 WHEN label IN ('parse_error', 'unknown_tool', 'schema_mismatch') THEN 0 ELSE 1 END AS tier FROM g),
v AS (SELECT conv_id, max(tier) AS best, arg_max(CASE WHEN name = 'load' THEN 1 ELSE k END, turn) FILTER (WHERE told AND ok AND name IN ('load', 'set_state')) AS state,
arg_max(CASE WHEN k % 2 = 0 THEN 'sx' ELSE 'sy' END, turn) FILTER (WHERE told AND ok AND name = 'show') AS shown, bool_or(label = 'state_out_of_range') AS out1, bool_or(label = 'unknown_tool') AS un, bool_or(label = 'schema_mismatch') AS sm FROM h GROUP BY conv_id),
w AS (SELECT *, best >= 2 AND coalesce(CASE WHEN conv_id % 2 = 0 THEN state = conv_id + conv_id % 8 ELSE shown = 'sx' END, false) AS holds, conv_id % 9 = 0 AS stopped, conv_id % 3 <> 0 AS clean FROM v),
z AS (SELECT conv_id, CASE WHEN holds AND NOT stopped AND clean THEN 3 ELSE least(best, 2) END AS max_tier, CASE WHEN holds AND NOT stopped AND clean THEN NULL WHEN holds AND NOT stopped THEN 'wrong_termination' WHEN stopped THEN 'step_cap_hit'
WHEN best = 2 THEN CASE WHEN conv_id % 2 = 0 THEN 'wrong_final_state' ELSE 'wrong_result' END WHEN best = 1 THEN CASE WHEN out1 THEN 'state_out_of_range' ELSE 'dispatch_error' END
WHEN un THEN 'unknown_tool' WHEN sm THEN 'schema_mismatch' ELSE 'parse_error' END AS failure_mode FROM w)"""


def _graded(spark, d):
    return R.verified(recorded(spark, d), SCHEMAS)


@query(f"WITH {CALLS} SELECT conv_id, CAST(max_tier AS INTEGER) AS max_tier, round(max_tier / 3.0, 6) AS reward, failure_mode FROM z")
def verify_tiers(spark, d):
    """Each rollout's tier, reward and failure."""
    return _graded(spark, d).select("conv_id", "max_tier", r("reward", 6).alias("reward"), "failure_mode")


@query(f"""WITH {CALLS}, s AS (SELECT 'tier' AS measure, CAST(unnest(range(0, 4)) AS VARCHAR) AS key UNION ALL SELECT 'failure', unnest([{', '.join(f"'{x}'" for x in R.FAILURES)}])),
n AS (SELECT 'tier' AS measure, CAST(max_tier AS VARCHAR) AS key FROM z UNION ALL SELECT 'failure', failure_mode FROM z)
SELECT s.measure, s.key, CAST(count(n.key) AS DOUBLE) AS value FROM s LEFT JOIN n ON n.measure = s.measure AND n.key = s.key GROUP BY 1, 2
UNION ALL SELECT 'whole', 'rows', CAST(count(*) AS DOUBLE) FROM z UNION ALL SELECT 'whole', 'pass_rate', round(avg(CASE WHEN max_tier = 3 THEN 1.0 ELSE 0.0 END), 6) FROM z UNION ALL SELECT 'whole', 'score', round(avg(max_tier) / 3, 6) FROM z""")
def rollout_summary(spark, d):
    """Histograms over the closed sets, with zeros, and the pass rate and score."""
    return R.summary(_graded(spark, d)).select("measure", "key", r("value", 6).alias("value"))


@query(f"WITH {CALLS} SELECT 'i' || (conv_id % 5) AS intent, count(*) AS n, CAST(sum(CASE WHEN max_tier = 3 THEN 1 ELSE 0 END) AS BIGINT) AS passed, round(avg(CASE WHEN max_tier = 3 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM z GROUP BY 1")
def intent_breakdown(spark, d):
    return R.by_intent(_graded(spark, d), "intent").select("intent", "n", "passed", r("rate", 6).alias("rate"))


@query(f"WITH {CALLS} SELECT failure_mode, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, failure_mode) AS place FROM z WHERE failure_mode IS NOT NULL GROUP BY 1")
def failure_order(spark, d):
    return R.failures_by_count(_graded(spark, d))


@query(f"WITH {CALLS} SELECT conv_id, string_agg(name || CASE WHEN bad THEN '' ELSE ':' || k END, ',' ORDER BY turn) AS calls FROM c GROUP BY conv_id")
def flat_calls(spark, d):
    """Names of calls with their state argument; arguments that are no object are empty."""
    own = R.flat_calls(F.col("messages"))
    text = F.transform(own, lambda c: F.concat(c["name"], F.coalesce(F.concat(F.lit(":"), F.try_element_at(c["arguments"], F.lit("state"))), F.lit(""))))
    return recorded(spark, d).select("conv_id", F.concat_ws(",", text).alias("calls"))


@query(f"""WITH {CALLS}, m AS (SELECT conv_id, count(*) AS asked, count(*) FILTER (WHERE told) AS answered, arg_max(told, turn) AS last_told FROM c GROUP BY conv_id)
SELECT conv_id, CAST(asked + answered + CASE WHEN conv_id % 3 <> 0 THEN 1 WHEN last_told THEN 1 ELSE 0 END AS INTEGER) AS messages, CASE WHEN conv_id % 3 <> 0 THEN 'Here it is.' WHEN last_told THEN 'Done.' END AS last FROM m""")
def sft_project(spark, d):
    """Training records: markers of the driver stripped, a closing text after a tool's answer."""
    own = R.sft_record(recorded(spark, d))
    return own.select("conv_id", F.size("messages").alias("messages"), F.element_at("messages", -1)["content"].alias("last"))


@query(f"""WITH {CALLS}, q AS (SELECT conv_id, string_agg(name || ':' || CASE WHEN bad THEN '' ELSE CAST(k AS VARCHAR) END, ',' ORDER BY turn) AS key FROM c GROUP BY conv_id) SELECT count(*) AS records, count(DISTINCT key) AS kinds FROM q""")
def calls_distinct(spark, d):
    """Records, and how many different call sequences they have by canonical text."""
    return R.sft_record(recorded(spark, d)).agg(F.count("*").alias("records"), F.countDistinct("calls_key").alias("kinds"))


@query(f"WITH {CALLS} SELECT name AS tool, count(DISTINCT conv_id) AS rollouts FROM c GROUP BY 1")
def tool_use(spark, d):
    """Rollouts that use each tool at all."""
    own = recorded(spark, d)
    used = F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), R.uses(F.col("messages"), t).alias("u")) for t in TOOLS]))
    return own.select(used.alias("x")).where("x.u").groupBy("x.tool").agg(F.count("*").alias("rollouts"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) < (SELECT count(*) / 4 FROM documents)")
def under_floor(spark, d):
    docs = table(spark, d, "documents")
    return R.under_floor(docs, "lang", -(-docs.count() // 4))


@query("SELECT round(avg(CASE WHEN starts_with(source, 's') THEN 1.0 ELSE 0.0 END), 6) AS share FROM documents")
def compound_ratio(spark, d):
    return R.compound_share(table(spark, d, "documents"), "source", "s").select(r("share", 6).alias("share"))


_PRICES = {"large": {"input": 3.0, "output": 15.0}, "small": {"input": 1.0}}


@query("SELECT conv_id, round(CASE conv_id % 3 WHEN 0 THEN (sum(length(text)) * 3.0 + count(*) * 15.0) / 1e6 WHEN 1 THEN sum(length(text)) / 1e6 ELSE 0 END, 9) AS dollars FROM conversations GROUP BY conv_id")
def usage_cost(spark, d):
    """Tokens by kind times the model's price; an unknown model and an unpriced kind cost nothing."""
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("i"), F.count("*").alias("o"))
    usage = F.create_map(F.lit("input"), F.col("i"), F.lit("output"), F.col("o"))
    model = F.element_at(F.array(F.lit("large"), F.lit("small"), F.lit("none")), (F.col("conv_id") % 3 + 1).cast("int"))
    return own.select("conv_id", F.round(R.cost(usage, model, _PRICES), 9).alias("dollars"))


@query("""SELECT event_id, 'show' AS name, event_type AS result, CAST(user_id AS VARCHAR) AS state FROM events WHERE event_id % 2 = 0""")
def envelope_calls(spark, d):
    """Calls written in the envelope, read from text; a broken envelope gives none."""
    e = table(spark, d, "events")
    body = F.concat(F.lit("call:show{result:<escape>"), "event_type", F.lit("<escape>,state:<escape>"), F.col("user_id").cast("string"), F.lit("<escape>}"))
    text = F.concat(F.lit("ok <start_function_call>"), body, F.when(F.col("event_id") % 2 == 0, "<end_function_call> done").otherwise("<end"))
    out = e.select("event_id", F.explode(R.enveloped(text)).alias("c"))
    return out.select("event_id", "c.name", F.col("c.arguments")["result"].alias("result"), F.col("c.arguments")["state"].alias("state"))


@query("SELECT user_id, event_id, 'show ' || event_type || ' of ' || user_id || ' at ' || event_type AS text FROM events")
def slot_fill(spark, d):
    e = table(spark, d, "events")
    text = R.filled_slots(F.lit("show <param:kind> of {user} at {kind}"), {"kind": F.col("event_type"), "user": F.col("user_id")})
    return e.select("user_id", "event_id", text.alias("text"))


@query("""WITH p AS (SELECT DISTINCT lang, source FROM documents), q AS (SELECT lang, source, seed FROM p, (SELECT unnest([1, 2, 3]) AS seed)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(lang || '|' || source || '|' || seed), lang, source, seed) AS place FROM q) SELECT lang, source, seed, place FROM k WHERE place <= 5""")
def synth_tuples(spark, d):
    """Five of each language's sources and seeds, in seeded hash order."""
    return R.synthesized(table(spark, d, "documents").select("lang", "source").distinct(), [1, 2, 3], ["lang"], 5).select("lang", "source", "seed", "place")


@query("""SELECT o_orderkey, string_agg(CAST(CASE WHEN i BETWEEN 2 AND 4 + o_orderkey % 2 THEN t[i + 1] ELSE -100 END AS VARCHAR), ',' ORDER BY i) AS labels FROM
(SELECT o_orderkey, unnest(range(0, 8)) AS i, CASE WHEN o_orderkey % 2 = 0 THEN [1, 2, o_orderkey + 10, 11, 3, 5, 6, 7] ELSE [1, 2, o_orderkey + 10, 11, 12, 3, 6, 7] END AS t FROM orders) GROUP BY o_orderkey""")
def assistant_labels(spark, d):
    """Token ids with all but the assistant's span ignored; its closing token counts."""
    o = table(spark, d, "orders").select("o_orderkey")
    n = (F.col("o_orderkey") + 10).cast("int")
    ids = F.when(F.col("o_orderkey") % 2 == 0, F.array(*[F.lit(1), F.lit(2), n, *map(F.lit, (11, 3, 5, 6, 7))])).otherwise(F.array(*[F.lit(1), F.lit(2), n, *map(F.lit, (11, 12, 3, 6, 7))]))
    return o.select("o_orderkey", F.concat_ws(",", R.assistant_mask(ids, [1, 2], [3]).cast("array<string>")).alias("labels"))


@query("""SELECT user_id, len(l) = 4 AND len(list_distinct(l)) = 1 AS loops FROM (SELECT user_id, list(event_type ORDER BY event_id DESC)[1:4] AS l FROM events GROUP BY user_id)""")
def loop_detection(spark, d):
    """Whether a session's last four turns call the same."""
    own = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.array(x["event_type"])).alias("turns"))
    return own.select("user_id", R.loops(F.col("turns")).alias("loops"))


@query("""SELECT conv_id, turn, name, error FROM (SELECT conv_id, turn, ['load', 'set_state', 'show', 'nosuch', 'select'][(conv_id + turn) % 5 + 1] AS name, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'none' WHEN (conv_id + turn) % 4 = 0 THEN 'false' ELSE 'true' END AS error FROM conversations WHERE role = 'assistant')""")
def call_answers(spark, d):
    """Each call with what its answer says of success, met by the call's id."""
    own = recorded(spark, d).select("conv_id", "messages", F.explode(R.calls(F.col("messages"))).alias("c"))
    turns = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn")
    from pyspark.sql import Window

    placed = turns.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    out = own.select("conv_id", F.col("c.place").alias("place"), F.col("c.name").alias("name"), F.coalesce(F.get_json_object("c.answer", "$.ok"), F.lit("none")).alias("error"))
    return out.join(placed, ["conv_id", "place"]).select("conv_id", "turn", "name", "error")


@query("SELECT doc_id, lang AS intent FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang <> 'de'")
def retained_rows(spark, d):
    """Retained rows, without those of one intent."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    rows = rows.select("doc_id", F.when(F.col("lang") == "de", "query").otherwise(F.col("lang")).alias("intent"), (F.col("quality") == 1).alias("retained"))
    return R.retained(rows, "actions").select("doc_id", "intent")


@query("""SELECT p_partkey, p_type, CASE WHEN p_size > 25 THEN 'alias-' || p_size ELSE '' END AS aliases, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS description FROM part""")
def alias_join(spark, d):
    p = table(spark, d, "part")
    aliases = p.where("p_size > 25").select("p_partkey", F.array(F.concat(F.lit("alias-"), F.col("p_size").cast("string"))).alias("aliases"), F.col("p_brand").alias("description"))
    return R.aliased(p.select("p_partkey", "p_type"), aliases, "p_partkey").select("p_partkey", "p_type", F.concat_ws(",", "aliases").alias("aliases"), "description")


@query("""SELECT event_id, '{"b":"' || event_type || '"}' AS json FROM events""")
def stripped_keys(spark, d):
    """Objects without what must not be seen."""
    text = F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit(', "b": "'), "event_type", F.lit('", "secret": [1, 2]}'))
    return table(spark, d, "events").select("event_id", R.without_keys(text, ["k", "secret"]).alias("json"))


@query("SELECT user_id, event_id, 'function' AS type, event_type AS name, 'object' AS kind FROM events")
def openai_tools(spark, d):
    """Tools in the shape that models take."""
    e = table(spark, d, "events")
    tool = R.openai_tool(F.col("event_type"), F.lit("does it"), F.struct(F.lit("object").alias("type")))
    return e.select("user_id", "event_id", tool.alias("t")).select("user_id", "event_id", "t.type", "t.function.name", F.col("t.function.parameters.type").alias("kind"))
