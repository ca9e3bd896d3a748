"""Reductions of each state over labels, running extrema over states, and stencils along the state axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def extreme(df: DataFrame, largest: bool, keys: list[str], label: str = "label", value: str = "value") -> DataFrame:
    """Least or largest value and its label; ties go to the least label. A NaN propagates, with the least label that has one."""
    number = (~F.isnan(value)).cast("int")
    pick = F.struct((-number if largest else number).alias("k"), F.col(value).alias("v"), (-F.col(label) if largest else F.col(label)).alias("p"))
    out = df.groupBy(*keys).agg((F.max if largest else F.min)(pick).alias("__x"))
    return out.select(*keys, (-F.col("__x.p") if largest else F.col("__x.p")).alias(label), F.col("__x.v").alias(value))


def reduced(df: DataFrame, how: str, keys: list[str], value: str = "value") -> DataFrame:
    """``average``, ``median`` or ``stddev`` (of the population) of each group."""
    f = {"average": F.avg, "median": F.median, "stddev": F.stddev_pop}[how]
    return df.groupBy(*keys).agg(f(value).alias(value))


def running(df: DataFrame, largest: bool, keys: list[str], state: str = "state", value: str = "value") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(state).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nan = F.max(F.isnan(value)).over(w)
    return df.withColumn(value, F.when(nan, F.lit(float("nan"))).otherwise((F.max if largest else F.min)(value).over(w)))


def dense(df: DataFrame, count: int, keys: list[str], state: str = "state", value: str = "value") -> DataFrame:
    """Every state of every key, 0 where there is no value: states are unrolled from each key, without a cross join."""
    grid = df.select(*keys).distinct().withColumn(state, F.explode(F.sequence(F.lit(1), F.lit(count))))
    return grid.join(df, [*keys, state], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))



def velocity(df: DataFrame, keys: list[str], time: str = "state", value: str = "value") -> DataFrame:
    """Backward difference; 0 at the first state."""
    w = Window.partitionBy(*keys).orderBy("state")
    d = (F.col(value) - F.lag(value).over(w)) / (F.col(time) - F.lag(time).over(w))
    return df.withColumn("velocity", F.when(F.col("state") == 1, F.lit(0.0)).otherwise(F.coalesce(d, F.lit(0.0))))


def acceleration(df: DataFrame, count: int, keys: list[str], value: str = "value", time: str = "state") -> DataFrame:
    """Second difference over the square of half the time between its ends: central, that of the next state at the first, of the one before at the last."""
    w = Window.partitionBy(*keys).orderBy("state")

    def around(c: str) -> dict:
        return {k: (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w) if k else F.col(c) for k in (-2, -1, 0, 1, 2)}

    u, t = around(value), around(time)

    def middle(k: int):
        half = 0.5 * (t[k + 1] - t[k - 1])
        return (u[k + 1] - 2 * u[k] + u[k - 1]) / (half * half)

    return df.withColumn("acceleration", F.when(F.col("state") == 1, middle(1)).when(F.col("state") == count, middle(-1)).otherwise(middle(0)))


def rate(df: DataFrame, count: int, keys: list[str], value: str = "value", time: str = "state") -> DataFrame:
    """0 at the first state, the backward rate at the last, else the mean of the backward and forward rates."""
    w = Window.partitionBy(*keys).orderBy("state")
    back = (F.col(value) - F.lag(value).over(w)) / (F.col(time) - F.lag(time).over(w))
    ahead = (F.lead(value).over(w) - F.col(value)) / (F.lead(time).over(w) - F.col(time))
    return df.withColumn("rate", F.when(F.col("state") == 1, 0.0).when(F.col("state") == count, back).otherwise((back + ahead) / 2))


def from_reference(df: DataFrame, reference: int, keys: list[str], values: list[str], state: str = "state") -> DataFrame:
    """Values less those of the reference state, matched by key."""
    ref = df.where(F.col(state) == reference).select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    return df.join(ref, keys).select(*keys, state, *[(F.col(v) - F.col(f"__{v}")).alias(v) for v in values])
