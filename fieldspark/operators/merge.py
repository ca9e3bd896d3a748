"""Merging of fragments, reducers, updates and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order: merged fragments without repeats."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A dictionary merge: the value of the largest order stays. Orders are distinct within a key."""
    return df.groupBy(key).agg(F.max(F.struct(order, value))[value].alias(value))


def updated(df: DataFrame, updates: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Values replaced where an update matches the key; all other rows stay."""
    return df.join(updates.withColumnRenamed(value, "__new"), keys, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def pivoted(df: DataFrame, rows: str, column: str, names: list, value: str = "value") -> DataFrame:
    """One row for each state and a column for each named label; names are given, so no job looks for them."""
    return df.groupBy(rows).pivot(column, names).agg(F.sum(value))


def unpivoted(df: DataFrame, ids: list[str], columns: list[str], name: str = "component", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


# reducers of fragments: rows are (frag, place, key, value), a fragment's own order in ``place``


def concatenated(df: DataFrame, key: str = "key", value: str = "value", unique: bool = False) -> DataFrame:
    """(key, place, value): the fragments' values one after another; with ``unique`` each at its first place only."""
    if unique:
        df = df.groupBy(key, value).agg(F.min(F.struct("frag", "place")).alias("__o")).select(key, value, "__o.frag", "__o.place")
    w = Window.partitionBy(key).orderBy("frag", "place", value)
    return df.select(key, (F.row_number().over(w) - 1).alias("place"), value)


def zeroth(df: DataFrame, key: str = "key") -> DataFrame:
    """What the first fragment that has the key says."""
    first = df.groupBy(key).agg(F.min("frag").alias("frag"))
    return df.join(first, [key, "frag"], "left_semi")


def first_valid(df: DataFrame, invalid, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value) of the first fragment whose value is valid; the invalid one where none is."""
    good = F.when(F.col(value) != F.lit(invalid), F.struct("frag", value))
    return df.groupBy(key).agg(F.coalesce(F.min(good)[value], F.lit(invalid)).alias(value))


def rows_of_all(df: DataFrame, key: str = "label") -> DataFrame:
    """Rows of all fragments, of each label those of the first that has it, in the fragments' order unless a label repeats, then by label.

    (…, label_pos): the order is part of what a merged result says.
    """
    again = df.groupBy(key).agg(F.count("*").alias("__n")).agg(F.max(F.col("__n") > 1).alias("__sorted"))
    own = first_by(df, [key], ["frag", "place"]).crossJoin(F.broadcast(again))  # one row
    order = F.when(F.col("__sorted"), F.lit(0)).otherwise(F.col("frag"))
    return own.withColumn("label_pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, F.when(F.col("__sorted"), F.lit(0)).otherwise(F.col("place")), key)) - 1).drop("__sorted")


def outcome(codes: DataFrame, call: str = "call", code: str = "code") -> DataFrame:
    """(call, failed): a call fails if any fragment's code is CRITICAL, or all are ERROR."""
    return codes.groupBy(call).agg((F.max((F.col(code) == "CRITICAL").cast("int")) == 1).alias("c"), (F.min((F.col(code) == "ERROR").cast("int")) == 1).alias("e")).select(call, (F.col("c") | F.col("e")).alias("failed"))
