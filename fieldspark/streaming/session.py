"""Session commands: text to rows, rows to state. Rows are (session, seq, verb, args)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Which kind of change each verb makes (fixed values).
DELTA = {
    "load": "LOADED", "close": "CLOSED", "state": "STATE", "next": "STATE", "prev": "STATE", "first": "STATE", "last": "STATE",
    "select": "SELECTION", "clrsel": "SELECTION", "show": "RESULT", "contour": "RESULT", "cmap": "RESULT", "legend": "RESULT", "render": "RESULT",
    "cutpln": "RESULT", "cutrpln": "RESULT", "rot": "CAMERA", "translate": "CAMERA", "scale": "CAMERA", "zoom": "CAMERA", "view": "CAMERA",
    "iso": "ISOSURFACE", "enable": "MATERIALS", "disable": "MATERIALS",
}


def parsed(df: DataFrame, key: str, script: str) -> DataFrame:
    """(key, place, verb, rest) of each command: separated by ; or line ends, # opens a comment, empty ones are no commands."""
    lines = F.split(F.col(script), "[;\\n]")
    rows = df.select(key, F.posexplode(lines).alias("place", "line"))
    clean = rows.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where("line <> ''")
    verb = F.lower(F.regexp_extract("line", r"^(\S+)", 1))
    return clean.select(key, "place", verb.alias("verb"), F.trim(F.regexp_replace("line", r"^\S+", "")).alias("rest"))


def delta(verb: Column) -> Column:
    """The kind of change of a verb; null for a verb that is none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in DELTA.items() for x in kv]), verb)


def folded(log: DataFrame, key: str, seq: str, kind: str, value: str) -> DataFrame:
    """The last write of each kind: what a fold of the whole log leaves."""
    return log.groupBy(key, kind).agg(F.max(F.struct(seq, value))[value].alias(value))


#: Commands of a log that one array holds when moves are put together.
CHUNK = 1024


def _composed(moves: Column) -> Column:
    """Moves (lo, hi, shift), each x -> max(lo, min(hi, x + shift)), one after another as one move."""
    start = F.struct(F.lit(-(1 << 62)).alias("lo"), F.lit(1 << 62).alias("hi"), F.lit(0).cast("long").alias("shift"))

    def after(f: Column, g: Column) -> Column:
        def through(x: Column) -> Column:
            return F.greatest(g["lo"], F.least(g["hi"], x + g["shift"]))

        return F.struct(through(f["lo"]).alias("lo"), through(f["hi"]).alias("hi"), (f["shift"] + g["shift"]).alias("shift"))

    return F.aggregate(moves, start, after)


def cursor(log: DataFrame, count: int, key: str = "session", seq: str = "seq") -> DataFrame:
    """(session, cursor): next, prev, first, last and state N over states 1..count, clamped at each step; other verbs move nothing.

    A clamped step is x -> max(lo, min(hi, x + shift)), and such steps compose to one of the same form. So a log is put
    together in two levels, of at most ``CHUNK`` commands each by their numbers, and no task holds a session's whole log.
    """
    to = F.when(F.col("verb") == "first", F.lit(1)).when(F.col("verb") == "last", F.lit(count)).when(F.col("verb") == "state", F.greatest(F.lit(1), F.least(F.lit(count), F.col("n"))))
    step = F.when(F.col("verb") == "next", 1).when(F.col("verb") == "prev", -1).otherwise(0).cast("long")
    move = F.struct(F.coalesce(to, F.lit(1)).cast("long").alias("lo"), F.coalesce(to, F.lit(count)).cast("long").alias("hi"), step.alias("shift"))
    own = log.where(F.col("verb").isin("next", "prev", "first", "last", "state")).select(key, F.col(seq).alias("seq"), move.alias("move"))
    for size in (CHUNK, CHUNK * CHUNK, None):
        part = [key] if size is None else [key, (F.floor(F.col("seq") / size) * size).alias("seq")]
        merged = F.transform(F.array_sort(F.collect_list(F.struct("seq", "move"))), lambda x: x["move"])
        own = own.groupBy(*part).agg(_composed(merged).alias("move"))
    at = F.greatest(F.col("move.lo"), F.least(F.col("move.hi"), 1 + F.col("move.shift")))
    return log.select(key).distinct().join(own.select(key, at.alias("cursor")), key, "left").select(key, F.coalesce("cursor", F.lit(1)).alias("cursor"))


def checked(commands: DataFrame) -> DataFrame:
    """Commands (…, verb, rest) with their words, their ``k=v`` options, the kind of change, and an error for an unknown verb or lost arguments."""
    words = F.filter(F.split(F.col("rest"), r"\s+"), lambda w: w != "")
    options = F.map_from_entries(F.transform(F.filter(words, lambda w: w.contains("=")), lambda w: F.struct(F.substring_index(w, "=", 1), F.regexp_replace(w, "^[^=]*=", ""))))
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv]), F.col("verb")), F.lit(0))
    kind = delta(F.col("verb"))
    out = commands.withColumn("words", F.filter(words, lambda w: ~w.contains("="))).withColumn("options", options).withColumn("kind", kind)
    error = F.when(F.col("kind").isNull(), F.concat(F.lit("unknown command verb "), "verb")).when(F.size("words") < least, F.concat("verb", F.lit(": missing arguments")))
    return out.withColumn("error", error)


#: Words that each verb must have after it, where it must have any (fixed values).
WORDS = {"load": 1, "state": 1, "select": 2, "clrsel": 1, "show": 1, "contour": 2, "cmap": 1, "legend": 2, "cutpln": 6, "cutrpln": 6, "rot": 3, "translate": 3, "scale": 1, "zoom": 1, "view": 1, "iso": 2}


def since_reset(log: DataFrame, key: str, seq: str) -> DataFrame:
    """What comes after each session's last close: that resets all but the numbering."""
    last = log.where("verb = 'close'").groupBy(key).agg(F.max(seq).alias("__closed"))
    return log.join(last, key, "left").where(F.col("__closed").isNull() | (F.col(seq) > F.col("__closed"))).drop("__closed")


def loaded(log: DataFrame, key: str, seq: str) -> DataFrame:
    """(session, root) of the last load since the last close."""
    return since_reset(log, key, seq).where("verb = 'load'").groupBy(key).agg(F.max(F.struct(seq, "words"))["words"][0].alias("root"))


def selection(log: DataFrame, key: str, seq: str) -> DataFrame:
    """(session, class, range): each class's last selection after the last clearing of it, or of all (``clrsel *``)."""
    own = since_reset(log, key, seq).where(F.col("verb").isin("select", "clrsel"))
    whole = own.where("verb = 'clrsel' and words[0] = '*'").groupBy(key).agg(F.max(seq).alias("__all"))
    single = own.where("not (verb = 'clrsel' and words[0] = '*')").withColumn("class", F.col("words")[0]).withColumn("range", F.when(F.col("verb") == "select", F.col("words")[1]))
    last = single.groupBy(key, "class").agg(F.max(F.struct(seq, "range")).alias("x"))
    return last.join(whole, key, "left").where(F.col("__all").isNull() | (F.col(f"x.{seq}") > F.col("__all"))).where("x.range is not null").select(key, "class", "x.range")


def result(log: DataFrame, key: str, seq: str, known: Column) -> DataFrame:
    """(session, result, component) of the last show or contour; a show whose variable (the component, else the result) is not ``known`` keeps what was there."""
    own = since_reset(log, key, seq).where(F.col("verb").isin("show", "contour"))
    own = own.withColumn("result", F.col("words")[0]).withColumn("component", F.when(F.col("verb") == "show", F.coalesce(F.get("words", F.lit(1)), F.lit(""))).otherwise(F.lit("")))
    own = own.withColumn("name", F.when(F.col("component") != "", F.col("component")).otherwise(F.col("result"))).where((F.col("verb") == "contour") | known)
    return own.groupBy(key).agg(F.max(F.struct(seq, "result", "component")).alias("x")).select(key, "x.result", "x.component")


def planes(log: DataFrame, key: str, seq: str) -> DataFrame:
    """(session, bucket, origin, normal): the last cutting and the last slicing plane; one without a normal clears its own. ``cutrpln`` turns it round."""
    own = since_reset(log, key, seq).where(F.col("verb").isin("cutpln", "cutrpln"))
    number = F.transform(F.slice("words", 1, 6), lambda w: w.cast("double"))
    own = own.withColumn("n", number).withColumn("bucket", F.when(F.coalesce(F.get("words", F.lit(6)), F.lit("")) == "slice", "slice").otherwise("cut"))
    last = own.groupBy(key, "bucket").agg(F.max(F.struct(seq, "verb", "n")).alias("x")).select(key, "bucket", "x.verb", "x.n")
    size = F.sqrt(sum((F.col("n")[i] ** 2 for i in (4, 5)), F.col("n")[3] ** 2))
    turn = F.when(F.col("verb") == "cutrpln", F.lit(-1.0)).otherwise(F.lit(1.0))
    return last.where(size >= 1e-12).select(key, "bucket", F.slice("n", 1, 3).alias("origin"), F.transform(F.slice("n", 4, 3), lambda v: v / size * turn).alias("normal"))


def hidden(log: DataFrame, key: str, seq: str) -> DataFrame:
    """(session, material, visible): the last word on each material; a class alone says nothing."""
    own = since_reset(log, key, seq).where(F.col("verb").isin("enable", "disable") & (F.size("words") > 1))
    return own.groupBy(key, F.col("words")[1].cast("int").alias("material")).agg((F.max(F.struct(seq, "verb"))["verb"] == "enable").alias("visible"))


def isosurface(log: DataFrame, key: str, seq: str) -> DataFrame:
    """(session, result, levels): the last surface, if it is on. Levels are listed, or spread over a range."""
    own = since_reset(log, key, seq).where("verb = 'iso'").groupBy(key).agg(F.max(F.struct(seq, "words")).alias("w"), F.max_by("options", seq).alias("options"))
    get = lambda k: F.try_element_at(F.col("options"), F.lit(k))
    count, lo, hi = F.coalesce(get("count").cast("int"), F.lit(0)), F.coalesce(get("min").cast("double"), F.lit(0.0)), F.coalesce(get("max").cast("double"), F.lit(1.0))
    spread = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: lo + (hi - lo) * i / (count + 1.0))).otherwise(F.array().cast("array<double>"))
    listed = F.transform(F.filter(F.split(F.coalesce(get("levels"), F.lit("")), ","), lambda t: t != ""), lambda t: t.cast("double"))
    return own.where("w.words[0] = 'on'").select(key, F.col("w.words")[1].alias("result"), F.when(F.size(listed) > 0, listed).otherwise(spread).alias("levels"))


#: A camera as it is at first (fixed values).
CAMERA = {"azimuth": 0.0, "elevation": 0.0, "distance": 1.0, "fx": 0.0, "fy": 0.0, "fz": 0.0}


def camera(log: DataFrame, key: str, seq: str) -> DataFrame:
    """(session, azimuth, elevation, distance, fx, fy, fz): turns and moves add up, scalings divide, since the last reset or setting.

    ``view save`` and ``view restore`` are resolved first: a restore goes on from the camera at the last save of its name.
    """
    own = since_reset(log, key, seq).where(F.col("verb").isin("rot", "translate", "scale", "zoom", "view"))
    number = lambda i: F.coalesce(F.get("words", F.lit(i)).try_cast("double"), F.lit(0.0))
    sub = F.when(F.col("verb") == "view", F.col("words")[0]).otherwise(F.col("verb"))
    own = own.select(key, F.col(seq).alias("seq"), sub.alias("op"), F.get("words", F.lit(1)).alias("name"), F.array(*[number(i) for i in range(7)]).alias("n"), F.size("words").alias("k"))
    ops = F.array_sort(F.collect_list(F.struct("seq", "op", "name", "n", "k")))
    first = F.struct(*[F.lit(v).alias(c) for c, v in CAMERA.items()])
    start = F.struct(first.alias("at"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<struct<{','.join(f'{c}:double' for c in CAMERA)}>>")).alias("saved"))

    def step(s: Column, c: Column) -> Column:
        at, n, op = s["at"], c["n"], c["op"]
        factor = F.when(op.isin("scale", "zoom") & (n[0] != 0), n[0]).otherwise(1.0)
        plain = F.struct(
            (at["azimuth"] + F.when(op == "rot", n[0]).otherwise(0.0)).alias("azimuth"), (at["elevation"] + F.when(op == "rot", n[1]).otherwise(0.0)).alias("elevation"), (at["distance"] / factor).alias("distance"),
            *[(at[f] + F.when(op == "translate", n[i]).otherwise(0.0)).alias(f) for i, f in enumerate(("fx", "fy", "fz"))],
        )
        placed = F.struct(n[1].alias("azimuth"), n[2].alias("elevation"), n[3].alias("distance"), *[F.when(c["k"] >= 7, n[4 + i]).otherwise(at[f]).alias(f) for i, f in enumerate(("fx", "fy", "fz"))])
        new = F.when(op == "reset", first).when(op == "set", placed).when(op == "restore", F.coalesce(F.try_element_at(s["saved"], c["name"]), at)).otherwise(plain)
        saved = F.when(op == "save", F.map_concat(F.map_filter(s["saved"], lambda k, _: k != c["name"]), F.create_map(c["name"], at))).otherwise(s["saved"])
        return F.struct(new.alias("at"), saved.alias("saved"))

    # a session's camera commands: one user's, in order
    return own.groupBy(key).agg(F.aggregate(ops, start, step)["at"].alias("at")).select(key, "at.*")


def history(log: DataFrame, keys: list[str], state: str, seq: str, value: str) -> DataFrame:
    """The latest sample of each state."""
    return log.groupBy(*keys, state).agg(F.max(F.struct(seq, value))[value].alias(value))


def numbered(log: DataFrame, key: str, order: str) -> DataFrame:
    """Commands with the session's own numbers, from 1 without gaps."""
    return log.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def subscribed(log: DataFrame, snapshot: DataFrame, kinds: list[str]) -> DataFrame:
    """What a subscriber gets: the state as it is first (at seq 0), then changes of the kinds asked for. Columns (session, seq, kind, value)."""
    return snapshot.select("session", F.lit(0).cast("long").alias("seq"), "kind", "value").where(F.col("kind").isin(kinds)).unionByName(log.where(F.col("kind").isin(kinds)).select("session", F.col("seq").cast("long").alias("seq"), "kind", "value"))
