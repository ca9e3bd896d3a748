"""The driver's tables as fields, vectors and connectivity of a simulation model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FIRST_DAY = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (frag, class, state, label, value): state is the day from 1, label the user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") % 4).cast("int").alias("frag"), "event_id", F.col("event_type").alias("class"),
        (F.datediff(F.to_date("ts"), F.lit(FIRST_DAY)) + 1).cast("int").alias("state"), F.col("user_id").alias("label"), "value",
    )


def field(spark: SparkSession, sf_dir: str, by_class: bool = True) -> DataFrame:
    """The summed field: one value for each (class,) state and label that has events."""
    keys = [*(["class"] if by_class else []), "state", "label"]
    return raw_field(spark, sf_dir).groupBy(*keys).agg(F.sum("value").alias("value"))


def vectors(spark: SparkSession, sf_dir: str, names: tuple[str, ...], first: int = 1) -> DataFrame:
    """Embeddings as (vec_id, label, *names): the components from ``first`` on, in double precision."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.element_at("embedding", first + i).cast("double").alias(n) for i, n in enumerate(names)])


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (element, node): an order and the parts in it."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("element"), F.col("l_partkey").alias("node")).distinct()
