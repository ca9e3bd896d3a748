"""Curation of conversational corpora: normal forms, deduplication, splits, pairs, grades and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def normal(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed, as Unicode has it."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def first_of(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The row whose place is the least of each key, by one aggregation: nothing is gathered or read again."""
    rest = [c for c in df.columns if c not in (place, *keys)]
    if not rest:
        return df.groupBy(*keys).agg(F.min(place).alias(place)).select(*df.columns)
    return df.groupBy(*keys).agg(F.min(F.struct(place, *rest)).alias("__x")).select(*[F.col(c) if c in keys else F.col(f"__x.`{c}`") for c in df.columns])


def held_out(df: DataFrame, group: str, cell: str) -> DataFrame:
    """Of each group the smallest cell by (count, name): the one to hold out. Only groups with two cells give one."""
    n = df.groupBy(group, cell).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    return n.withColumn("cells", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("n", cell))).where("cells > 1 and place = 1").select(group, cell, "n")


#: Parts of a group that are ranked each on its own, by the leading bits of a hash.
PARTS = 4096


def stratified(df: DataFrame, group: str, key: str, share: float, seed: int) -> DataFrame:
    """Rows marked ``val`` or ``train``: of n in a group, round-half-even(n * share) but at most n - 1, in seeded hash order.

    The hash's leading bits deal a group out in parts, whose counts say how many rows come before each; only the part in
    which the cut falls is ranked, so no task sorts a whole group.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    own = df.withColumn("__h", order).withColumn("__part", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    counts = own.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group).orderBy("__part")  # at most PARTS rows of a group
    upto = counts.withColumn("__upto", F.sum("__n").over(w)).withColumn("__all", F.sum("__n").over(Window.partitionBy(group)))
    most = F.greatest(F.lit(0), F.least(F.col("__all") - 1, F.bround(F.col("__all") * F.lit(share)).cast("long")))
    cut = upto.select(group, "__part", (most - (F.col("__upto") - F.col("__n"))).alias("__take"), F.col("__n"))
    placed = own.join(F.broadcast(cut), [group, "__part"])  # as many rows as groups have parts
    inside = placed.where("__take > 0 and __take < __n").withColumn("__place", F.row_number().over(Window.partitionBy(group, "__part").orderBy("__h", key)))
    ends = placed.where("__take <= 0 or __take >= __n").withColumn("__place", F.lit(0))
    split = F.when((F.col("__take") > 0) & (F.col("__place") <= F.col("__take")), "val").otherwise("train")
    return inside.unionByName(ends).withColumn("split", split).select(*df.columns, "split")


def pairs(df: DataFrame, key: str, good: Column, tie: str) -> DataFrame:
    """(key, chosen, rejected): of each key the first good and the first bad row, where it has both."""
    return df.groupBy(key).agg(F.min(F.when(good, F.col(tie))).alias("chosen"), F.min(F.when(~good, F.col(tie))).alias("rejected")).where("chosen is not null and rejected is not null")


def budget(df: DataFrame, group: str, tokens: str, limit: int) -> DataFrame:
    """Least, p50 (the median's whole part), p95 (the element at round-half-even(0.95 (n - 1))) and largest count, and how many exceed the limit.

    Rows are counted by value first; ranks come from the running counts, so a group's task has a row for each value only.
    """
    counts = df.groupBy(group, F.col(tokens).alias("__v")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group)
    ranked = counts.withColumn("__upto", F.sum("__n").over(w.orderBy("__v"))).withColumn("__all", F.sum("__n").over(w))

    def at(place: Column) -> Column:
        """The value at a place from 0."""
        return F.max(F.when((place < F.col("__upto")) & (place >= F.col("__upto") - F.col("__n")), F.col("__v")))

    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    return ranked.groupBy(group).agg(
        F.sum("__n").alias("n"), F.min("__v").alias("least"), F.floor((at(low) + at(high)) / 2).cast("long").alias("p50"), at(F.bround(0.95 * (F.col("__all") - 1))).alias("p95"),
        F.max("__v").alias("most"), F.sum(F.when(F.col("__v") > limit, F.col("__n")).otherwise(0)).alias("over"),
    )


def histogram(df: DataFrame, column: str, closed: list, spark) -> DataFrame:
    """Counts over a closed set of values, 0 where none has it."""
    values = spark.createDataFrame([(v,) for v in closed], f"{column} long")
    counts = df.groupBy(F.col(column).cast("long").alias(column)).agg(F.count("*").alias("n"))
    return values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def answered(turns: DataFrame, key: str, place: str, role: str, text: str) -> DataFrame:
    """Each user turn with the next assistant turn of its conversation, null if none follows."""
    w = Window.partitionBy(key).orderBy(place).rowsBetween(1, Window.unboundedFollowing)
    answer = F.first(F.when(F.col(role) == "assistant", F.col(place)), ignorenulls=True).over(w)
    return turns.withColumn("answer", answer).where(F.col(role) == "user").select(key, place, "answer")


def terminated(turns: DataFrame, key: str, place: str, role: str) -> DataFrame:
    """(key, turns, appended): conversations as role lists, with a closing assistant turn where the last is none."""
    roles = F.transform(F.array_sort(F.collect_list(F.struct(place, role))), lambda x: x[role])
    own = turns.groupBy(key).agg(roles.alias("roles"))
    last = F.element_at("roles", -1)
    done = F.when(last == "assistant", F.col("roles")).otherwise(F.concat("roles", F.array(F.lit("assistant"))))
    return own.select(key, F.array_join(done, ",").alias("turns"), (last != "assistant").alias("appended"))


#: Held-out n-grams' hashes, at most, that go to every task as a filter: 8 bytes each.
HELD = 1 << 20


def shared_ngrams(docs: DataFrame, held: DataFrame, width: int, text: str = "text", doc: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(doc, item, shared): distinct word n-grams that a document shares with a held-out item.

    Windows of words are hashed. A document's hashes are kept only if some item has them (a broadcast if the items' hashes
    are few enough, else a join on the hash), and only those n-grams are made text and compared as such.
    """

    def worded(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.array_remove(F.split(normal(F.col(text)), " "), "").alias("w")).where(F.size("w") >= width)

    def grams(df: DataFrame, key: str) -> DataFrame:
        """(key, h, gram) for each window."""
        once = df.withColumn("x", F.transform("w", lambda v: F.xxhash64(v)))
        h = F.expr(f"transform(sequence(0, size(x) - {width}), i -> struct(i as i, xxhash64({', '.join(f'get(x, i + {k})' for k in range(width))}) as h))")
        return once.select(key, "w", F.explode(h).alias("g")).select(key, "w", F.col("g.i").alias("i"), F.col("g.h").alias("h"))

    def told(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, "h", F.array_join(F.slice("w", F.col("i") + 1, width), " ").alias("gram"))

    items = told(grams(worded(held, item), item), item).distinct()
    hashes = items.select("h").distinct()
    if hashes.limit(HELD + 1).count() <= HELD:
        hashes = F.broadcast(hashes)
    rows = grams(worded(docs, doc), doc).join(hashes, "h", "left_semi")
    return told(rows, doc).distinct().join(items, ["h", "gram"]).groupBy(doc, item).agg(F.count("*").alias("shared"))
