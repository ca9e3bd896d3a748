"""Recorded rollouts: calls and answers, grades, summaries, and the records that training takes.

A rollout is a row with ``messages``: array of (role, content, tool_call_id, tool_calls: array of (id, name, arguments)),
arguments and answers as JSON text. All rules are Columns over the row's own messages, so grading shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The closed set of failures, and which of them an answer may name (fixed values).
FAILURES = (
    "parse_error", "unknown_tool", "schema_mismatch", "dispatch_error", "nonexistent_material", "nonexistent_class", "nonexistent_result", "state_out_of_range", "wrong_final_state", "wrong_selection", "wrong_result", "wrong_range", "wrong_materials",
    "wrong_termination", "step_cap_hit", "token_cap_hit", "timeout",
)
STOPS = ("step_cap_hit", "token_cap_hit", "timeout")
ANSWERED = ("nonexistent_material", "nonexistent_class", "nonexistent_result", "state_out_of_range", "dispatch_error")
UNREAD = ("unknown_tool", "schema_mismatch", "parse_error")
#: What a postcondition that fails is called, by its kind (fixed values).
MISSES = {"state_index": "wrong_final_state", "selection_set": "wrong_selection", "active_result": "wrong_result", "result_range": "wrong_range", "materials_visible": "wrong_materials", "camera_named_view": "wrong_final_state", "query_value": "wrong_final_state"}
CLOSING = "Done."
MESSAGES = "array<struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>>"

#: Argument types of each tool: {tool: {argument: (type, whether it must be there)}}.
Schemas = dict[str, dict[str, tuple[str, bool]]]


def is_stop(m: Column) -> Column:
    """Whether a message is a marker of the driver."""
    return (m["role"] == "system") & F.coalesce(m["content"], F.lit("")).startswith("stop:")


def says_something(m: Column) -> Column:
    """Whether a message is an assistant's text without a call."""
    return (m["role"] == "assistant") & (F.length(F.trim(F.coalesce(m["content"], F.lit("")))) > 0) & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) <= 0)


def without_stops(messages: Column) -> Column:
    return F.filter(messages, lambda m: ~is_stop(m))


def closed(messages: Column, text: str = CLOSING) -> Column:
    """With a closing text where the last message is a tool's; all others stay as they are."""
    last = F.element_at(messages, -1)
    more = F.array(F.struct(F.lit("assistant").alias("role"), F.lit(text).alias("content"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>").alias("tool_calls")))
    return F.when((F.size(messages) > 0) & (last["role"] == "tool"), F.concat(messages, more.cast(MESSAGES))).otherwise(messages)


def calls(messages: Column) -> Column:
    """(name, arguments, args, answer, place) of every call in order: ``args`` null unless the arguments are an object, ``answer`` the last tool message with the call's id, null unless it is one."""
    tools = F.filter(messages, lambda m: m["role"] == "tool")

    def answer(call: Column) -> Column:
        own = F.filter(tools, lambda t: t["tool_call_id"].eqNullSafe(call["id"]))
        return F.when(F.size(own) > 0, F.element_at(own, -1)["content"])

    own = F.flatten(F.transform(F.filter(messages, lambda m: (m["role"] == "assistant") & m["tool_calls"].isNotNull()), lambda m: m["tool_calls"]))
    return F.transform(own, lambda c, i: F.struct(
        F.coalesce(c["name"], F.lit("")).alias("name"), c["arguments"].alias("arguments"), F.from_json(c["arguments"], "map<string,string>").alias("args"),
        F.when(F.from_json(answer(c), "map<string,string>").isNotNull(), answer(c)).alias("answer"), i.alias("place"),
    ))


def flat_calls(messages: Column) -> Column:
    """(name, arguments) of every call, arguments as a map; an empty one where they are no object."""
    return F.transform(calls(messages), lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["args"], F.create_map().cast("map<string,string>")).alias("arguments")))


def sorted_map(m: Column) -> Column:
    """A map's entries by key: equal maps are equal arrays."""
    return F.array_sort(F.map_entries(m))


def calls_key(flat: Column) -> Column:
    """A canonical text of flat calls: calls in order, arguments by key."""
    return F.to_json(F.transform(flat, lambda c: F.struct(c["name"].alias("name"), sorted_map(c["arguments"]).alias("arguments"))))


def coerced(value: Column, kind: str) -> Column:
    """A text as an argument of the type, null if it is none: true, 1, yes and false, 0, no are booleans."""
    if kind == "integer":
        return F.when(value.rlike(r"^\s*[+-]?\d+(\.0+)?\s*$"), F.trim(value))
    if kind == "number":
        return F.when(value.try_cast("double").isNotNull(), F.trim(value))
    if kind == "boolean":
        low = F.lower(value)
        return F.when(low.isin("true", "1", "yes"), F.lit("true")).when(low.isin("false", "0", "no"), F.lit("false"))
    return value


def fits(args: Column, schema: dict[str, tuple[str, bool]]) -> Column:
    """Whether all arguments that must be there are, and each that is there is of its type."""
    out = F.lit(True)
    for name, (kind, must) in schema.items():
        right = F.coalesce(coerced(F.try_element_at(args, F.lit(name)), kind).isNotNull(), F.lit(False))
        out = out & F.when(F.map_contains_key(args, name), right).otherwise(F.lit(not must))
    return out


def _ok(answer: Column) -> Column:
    return F.coalesce(F.get_json_object(answer, "$.ok") == "true", F.lit(False))


def graded(own: Column, schemas: Schemas) -> Column:
    """(tier, label) of each call: 0 not read, 1 read, 2 answered well."""

    def one(c: Column) -> Column:
        known, right = F.lit(False), F.lit(False)
        for tool, schema in schemas.items():
            known = known | (c["name"] == tool)
            right = F.when(c["name"] == tool, fits(c["args"], schema)).otherwise(right)
        kind = F.get_json_object(c["answer"], "$.error_kind")
        label = (
            F.when(c["args"].isNull(), "parse_error").when(~known, "unknown_tool").when(~F.coalesce(right, F.lit(False)), "schema_mismatch").when(c["answer"].isNull(), "dispatch_error")
            .when(~_ok(c["answer"]), F.when(kind.isin(*ANSWERED), kind).otherwise("dispatch_error"))
        )
        tier = F.when(label.isNull(), 2).when(label.isin(*UNREAD), 0).otherwise(1)
        return F.struct(tier.alias("tier"), label.alias("label"))

    return F.transform(own, one)


def _last(own: Column, test) -> Column:
    """The last call that was answered well and passes the test; null if none does."""
    found = F.filter(own, lambda c: _ok(c["answer"]) & test(c))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def _some(own: Column, test) -> Column:
    return F.exists(own, lambda c: _ok(c["answer"]) & F.coalesce(test(c), F.lit(False)))


def _json_map(text: Column, path: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(text, path), "map<string,string>"), F.create_map().cast("map<string,string>"))


def holds(own: Column, kind: Column, expect: Column) -> Column:
    """Whether the postcondition holds after the calls; ``expect`` is JSON text."""
    whole = F.get_json_object
    moved = _last(own, lambda c: (c["name"] == "load") | c["name"].isin("set_state", "step") & F.coalesce(whole(c["answer"], "$.state").rlike(r"^-?\d+$"), F.lit(False)))
    state = F.when(moved["name"] == "load", F.lit("1")).otherwise(whole(moved["answer"], "$.state"))
    picked = _last(own, lambda c: c["name"].isin("select", "clrsel"))
    selection = F.map_filter(_json_map(picked["answer"], "$.selection"), lambda k, v: F.length(v) > 0)
    shown = _last(own, lambda c: c["name"] == "show")
    ranges = [F.from_json(whole(x, "$.range"), "array<double>") for x in (shown["answer"], expect)]
    tol = F.coalesce(whole(expect, "$.tol").cast("double"), F.lit(1e-6))
    close = lambda i: F.abs(ranges[0][i] - ranges[1][i]) <= F.greatest(tol, 1e-9 * F.greatest(F.abs(ranges[0][i]), F.abs(ranges[1][i])))
    hidden = _last(own, lambda c: c["name"] == "material")
    ints = lambda t: F.array_sort(F.array_distinct(F.coalesce(F.from_json(whole(t, "$.hidden_materials"), "array<int>"), F.array().cast("array<int>"))))
    action, name = whole(expect, "$.action"), whole(expect, "$.name")
    arg = lambda c, k: F.try_element_at(c["args"], F.lit(k))
    camera = (
        F.when(action == "reset", _some(own, lambda c: (c["name"] == "view") & (arg(c, "reset") == "true")))
        .when(action == "colormap", _some(own, lambda c: (c["name"] == "colormap") & (name.isNull() | (arg(c, "name") == name))))
        .when(action.isin("save", "restore", "list"), _some(own, lambda c: (c["name"] == "named_view") & (arg(c, "op") == F.upper(action)) & (name.isNull() | (arg(c, "name") == name))))
    )
    wanted = _json_map(expect, "$.arguments")
    answered = _some(own, lambda c: (
        (c["name"] == "query") & (whole(expect, "$.arguments").isNull() | (sorted_map(c["args"]) == sorted_map(wanted)))
        & (whole(expect, "$.table").isNull() | (sorted_map(_json_map(c["answer"], "$.table")) == sorted_map(_json_map(expect, "$.table"))))
    ))
    out = (
        F.when(kind == "state_index", state == whole(expect, "$.state")).when(kind == "selection_set", sorted_map(selection) == sorted_map(_json_map(expect, "$.selection")))
        .when(kind == "active_result", whole(shown["answer"], "$.result") == whole(expect, "$.result")).when(kind == "result_range", (F.size(ranges[0]) == 2) & (F.size(ranges[1]) == 2) & close(0) & close(1))
        .when(kind == "materials_visible", ints(hidden["answer"]) == ints(expect)).when(kind == "camera_named_view", camera).when(kind == "query_value", answered)
    )
    return F.coalesce(out, F.lit(False))


def driver_stop(messages: Column) -> Column:
    """The first reason of the closed set that a stop marker names."""
    reasons = F.transform(F.filter(messages, is_stop), lambda m: F.trim(F.substring(m["content"], 6, 1000)))
    known = F.filter(reasons, lambda r: r.isin(*STOPS))
    return F.when(F.size(known) > 0, known[0])


def verified(rollouts: DataFrame, schemas: Schemas, messages: str = "messages", kind: str = "kind", expect: str = "expect") -> DataFrame:
    """``rollouts`` with max_tier (0 to 3), reward (a third of it) and failure_mode (null at 3).

    Tier 3 takes a postcondition that holds, no stop of the driver, and a last message that is text alone. A stop names
    the failure; else, at 2, the postcondition does, and below, the call's label that says most.
    """
    m = F.col(messages)
    df = rollouts.withColumn("__calls", calls(m)).withColumn("__grades", graded(F.col("__calls"), schemas)).withColumn("__stop", driver_stop(m))
    df = df.withColumn("__best", F.coalesce(F.array_max(F.transform("__grades", lambda g: g["tier"])), F.lit(-1)))
    df = df.withColumn("__holds", F.when(F.col("__best") >= 2, holds(F.col("__calls"), F.col(kind), F.col(expect))).otherwise(False))
    kept = without_stops(m)
    clean = F.coalesce((F.size(kept) > 0) & says_something(F.element_at(kept, -1)), F.lit(False))
    passed = F.col("__holds") & F.col("__stop").isNull()
    tier = F.when(F.col("__best") < 0, 0).when(passed & clean, 3).otherwise(F.least(F.col("__best"), F.lit(2)))
    labels = F.transform(F.filter("__grades", lambda g: g["label"].isNotNull()), lambda g: g["label"])

    def preferred(order: tuple[str, ...]) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for label in order:
            out = out.when(F.array_contains(labels, label), label)
        return out.otherwise(F.coalesce(F.get(labels, F.lit(0)), F.lit("parse_error")))

    miss = F.element_at(F.create_map(*[F.lit(x) for kv in MISSES.items() for x in kv]), F.col(kind))
    mode = (
        F.when(passed & clean, F.lit(None).cast("string")).when(passed, "wrong_termination").when(F.col("__stop").isNotNull(), F.col("__stop")).when(F.col("__best") < 0, "parse_error")
        .when(F.col("__best") >= 2, miss).when(F.col("__best") == 1, preferred(ANSWERED)).otherwise(preferred(UNREAD))
    )
    out = df.withColumn("max_tier", tier.cast("int")).withColumn("reward", tier / 3.0).withColumn("failure_mode", mode)
    return out.drop("__calls", "__grades", "__stop", "__best", "__holds")


def summary(graded_rows: DataFrame) -> DataFrame:
    """(measure, key, value): tiers and failures as closed sets with zeros, rows, pass rate."""
    spark = graded_rows.sparkSession
    closed_set = spark.createDataFrame([("tier", str(t)) for t in range(4)] + [("failure", f) for f in FAILURES], "measure string, key string")
    seen = graded_rows.select(F.explode(F.array(F.struct(F.lit("tier").alias("measure"), F.col("max_tier").cast("string").alias("key")), F.struct(F.lit("failure").alias("measure"), F.col("failure_mode").alias("key")))).alias("x"))
    counts = seen.where("x.key is not null").groupBy("x.measure", "x.key").agg(F.count("*").cast("double").alias("value"))
    rows = closed_set.join(counts, ["measure", "key"], "left").select("measure", "key", F.coalesce("value", F.lit(0.0)).alias("value"))
    whole = graded_rows.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg((F.col("max_tier") == 3).cast("int")), F.lit(0.0)).alias("rate"), F.coalesce(F.avg("max_tier") / 3, F.lit(0.0)).alias("score"))
    more = whole.select(F.explode(F.array(*[F.struct(F.lit("whole").alias("measure"), F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("rows", "n"), ("pass_rate", "rate"), ("score", "score"))])).alias("x")).select("x.*")
    return rows.unionByName(more)


def by_intent(rows: DataFrame, intent: str) -> DataFrame:
    """(intent, n, passed, rate)."""
    return rows.groupBy(intent).agg(F.count("*").alias("n"), F.sum((F.col("max_tier") == 3).cast("long")).alias("passed"), F.avg((F.col("max_tier") == 3).cast("int")).alias("rate"))


def failures_by_count(rows: DataFrame) -> DataFrame:
    """(place, failure_mode, n): by count, largest first, then by name. The set is closed, so one window holds it."""
    n = rows.where("failure_mode is not null").groupBy("failure_mode").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "failure_mode")))


def uses(messages: Column, tool: str) -> Column:
    """Whether any call is of the tool."""
    return F.exists(calls(messages), lambda c: c["name"] == tool)


def loops(names: Column, window: int = 4) -> Column:
    """Whether the last ``window`` turns call the same tools: ``names`` is an array, by turn, of arrays of tool names."""
    keys = F.transform(F.slice(F.reverse(names), 1, window), lambda t: F.array_join(F.array_sort(t), ","))
    return (F.size(keys) == window) & (F.size(F.array_distinct(keys)) == 1)


def under_floor(rows: DataFrame, intent: str, floor: int) -> DataFrame:
    return rows.groupBy(intent).agg(F.count("*").alias("n")).where(F.col("n") < floor)


def compound_share(rows: DataFrame, id_column: str, prefix: str = "compound") -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.col(id_column).startswith(prefix).cast("int")), F.lit(0.0)).alias("share"))


def sft_record(rollouts: DataFrame, messages: str = "messages") -> DataFrame:
    """What training takes: without stops, closed, with flat calls and their key; the other columns stay."""
    own = closed(without_stops(F.col(messages)))
    return rollouts.withColumn(messages, own).withColumn("tool_calls_flat", flat_calls(F.col(messages))).withColumn("calls_key", calls_key(F.col("tool_calls_flat")))


def openai_tool(name: Column, description: Column, schema: Column) -> Column:
    return F.struct(F.lit("function").alias("type"), F.struct(name.alias("name"), description.alias("description"), schema.alias("parameters")).alias("function"))


def cost(usage: Column, model: Column, prices: dict[str, dict[str, float]]) -> Column:
    """Dollars: tokens of each kind times the model's price of a million; a model or kind without a price costs nothing."""
    out = F.lit(0.0)
    for m, own in prices.items():
        total = sum((F.coalesce(F.try_element_at(usage, F.lit(k)), F.lit(0)).cast("double") * (p / 1e6) for k, p in own.items()), F.lit(0.0))
        out = F.when(model == m, total).otherwise(out)
    return out


def enveloped(text: Column) -> Column:
    """(name, arguments) of calls written as ``<start_function_call>call:NAME{key:<escape>value<escape>,...}<end_function_call>``."""
    whole = F.regexp_extract_all(text, F.lit(r"(?s)<start_function_call>\s*call:(\w+\{.*?\})\s*<end_function_call>"), F.lit(1))

    def one(c: Column) -> Column:
        body = F.regexp_extract(c, r"(?s)^\w+\{(.*)\}$", 1)
        keys = F.regexp_extract_all(body, F.lit(r"(?s)(\w+):<escape>.*?<escape>"), F.lit(1))
        values = F.regexp_extract_all(body, F.lit(r"(?s)\w+:<escape>(.*?)<escape>"), F.lit(1))
        return F.struct(F.regexp_extract(c, r"^(\w+)", 1).alias("name"), F.map_from_arrays(keys, values).alias("arguments"))

    return F.transform(whole, one)


def filled_slots(template: Column, params: dict[str, Column]) -> Column:
    """A template with ``<param:x>`` and ``{x}`` put in."""
    out = template
    for name, value in params.items():
        for mark in (f"<param:{name}>", f"{{{name}}}"):
            out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def synthesized(params: DataFrame, seeds: list[int], cell: list[str], quota: int) -> DataFrame:
    """Up to ``quota`` rows of each cell from the product of its parameters with the seeds, in seeded hash order."""
    own = params.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    names = [c for c in own.columns]
    w = Window.partitionBy(*cell).orderBy(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in names])), *names)
    return own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota)


def assistant_mask(ids: Column, start: list[int], end: list[int], ignore: int = -100) -> Column:
    """Labels of token ids: those of spans between ``start`` and ``end`` (the end's tokens too) stay, all others are ignored."""

    def at(i: Column, mark: list[int]) -> Column:
        out = F.lit(True)
        for k, t in enumerate(mark):
            out = out & F.coalesce(F.get(ids, i + k) == t, F.lit(False))
        return out

    places = F.sequence(F.lit(0), F.size(ids) - 1)
    opened = F.transform(F.filter(places, lambda i: at(i, start)), lambda i: i + len(start))
    ended = F.filter(places, lambda i: at(i, end))

    def label(i: Column) -> Column:
        since = F.array_max(F.filter(opened, lambda s: s <= i))
        last = F.array_min(F.filter(ended, lambda x: x >= since)) + (len(end) - 1)
        return F.when(since.isNotNull() & (last.isNull() | (i <= last)), F.get(ids, i)).otherwise(F.lit(ignore)).cast("int")

    return F.when(F.size(ids) > 0, F.transform(places, label)).otherwise(F.array().cast("array<int>"))


def retained(rows: DataFrame, policy: str = "all") -> DataFrame:
    """Rows that are retained; a policy of ``actions`` drops those that only ask (intent ``query``)."""
    out = rows.where(F.col("retained"))
    return out.where(F.col("intent") != "query") if policy == "actions" else out


def aliased(catalog: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Results with their aliases and description, empty where there are none."""
    return catalog.join(aliases, name, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumn("description", F.coalesce("description", F.lit("")))


def without_keys(json: Column, keys: list[str]) -> Column:
    """A JSON object's text without the keys at its top, in the order of the others."""
    return F.to_json(F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: ~k.isin(keys)))
