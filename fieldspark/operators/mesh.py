"""Connectivity, projection, neighbours, faces and planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def corner_columns(points: DataFrame, element: str, corner: str, count: int, names: tuple[str, ...] = ("x", "y", "z"), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each element with columns x0..z{count-1}; elements without all corners are left out."""
    aggs = [F.max(F.when(F.col(corner) == k, F.col(n))).alias(f"{n}{k}") for k in range(count) for n in names]
    out = points.groupBy(element, *keep).agg(F.count("*").alias("__n"), *aggs)
    return out.where(F.col("__n") == count).drop("__n")


def corners(count: int, names: tuple[str, ...] = ("x", "y", "z")) -> list[tuple[Column, ...]]:
    return [tuple(F.col(f"{n}{k}") for n in names) for k in range(count)]


def nodes_of(incidence: DataFrame, elements: list[int]) -> DataFrame:
    return incidence.where(F.col("element").isin(*elements)).select("node").distinct()


def elements_of(incidence: DataFrame, nodes: list[int]) -> DataFrame:
    return incidence.where(F.col("node").isin(*nodes)).select("element").distinct()


def projected(incidence: DataFrame, values: DataFrame, weight: str | None = None) -> DataFrame:
    """Mean of the incident elements' values at each node, by weight if one is named; ``values`` has (element, value[, weight])."""
    j = incidence.join(values, "element")
    if weight is None:
        return j.groupBy("node").agg(F.avg("value").alias("value"))
    return j.groupBy("node").agg((F.sum(F.col("value") * F.col(weight)) / F.sum(weight)).alias("value"))


def scattered(nodes: DataFrame, incidence: DataFrame, values: DataFrame) -> DataFrame:
    """The mean at every node, NaN where no element with a value is incident."""
    return nodes.join(projected(incidence, values), "node", "left").withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def distance(point: tuple[float, float, float], names: tuple[str, ...] = ("x", "y", "z")) -> Column:
    return F.sqrt(sum(((F.col(n) - F.lit(p)) ** 2 for n, p in zip(names[1:], point[1:], strict=True)), (F.col(names[0]) - F.lit(point[0])) ** 2))


def nearest(df: DataFrame, point: tuple[float, float, float], label: str) -> DataFrame:
    """The label nearest to a point and its distance; a top-1 that no task gathers. Ties to the least label."""
    return df.select(label, distance(point).alias("distance")).orderBy("distance", label).limit(1)


def within(df: DataFrame, point: tuple[float, float, float], radius: float, label: str) -> DataFrame:
    """Labels in a sphere: the box first, which reaches the scan's statistics, then the distance."""
    box = F.lit(True)
    for n, p in zip(("x", "y", "z"), point, strict=True):
        box = box & F.col(n).between(p - radius, p + radius)
    return df.where(box).select(label, distance(point).alias("distance")).where(F.col("distance") <= radius)


def ring(incidence: DataFrame, start: list[int], steps: int) -> DataFrame:
    """Elements reached from ``start`` over shared nodes in at most ``steps`` steps, without the start. Steps are few, so the plan is unrolled."""
    seen = incidence.where(F.col("element").isin(*start)).select("element").distinct()
    for _ in range(steps):
        nodes = incidence.join(seen, "element", "left_semi").select("node").distinct()
        seen = incidence.join(nodes, "node", "left_semi").select("element").distinct()
    return seen.where(~F.col("element").isin(*start))


def edges(cells: DataFrame, count: int) -> DataFrame:
    """Distinct edges (lo, hi) around cells with corner columns n0..n{count-1}."""
    ends = F.explode(F.array(*[F.struct(F.least(f"n{k}", f"n{(k + 1) % count}").alias("lo"), F.greatest(f"n{k}", f"n{(k + 1) % count}").alias("hi")) for k in range(count)]))
    return cells.select(ends.alias("e")).select("e.lo", "e.hi").distinct()


def hull(faces: DataFrame) -> DataFrame:
    """Faces by their sorted nodes: how many cells share each, and the first owner; 1 is the hull, more is inside."""
    key = faces.select("cell", F.array_sort("nodes").alias("nodes"))
    return key.groupBy("nodes").agg(F.count("*").alias("shared"), F.min("cell").alias("owner"))


def side(origin: tuple[float, float, float], normal: tuple[float, float, float], names: tuple[str, ...] = ("x", "y", "z")) -> Column:
    """Signed distance from a plane with a unit normal."""
    return sum(((F.col(n) - F.lit(o)) * F.lit(d) for n, o, d in zip(names[1:], origin[1:], normal[1:], strict=True)), (F.col(names[0]) - F.lit(origin[0])) * F.lit(normal[0]))


def nodes_of_any(incidence: DataFrame, elements: DataFrame) -> DataFrame:
    """Distinct nodes of the elements in a DataFrame."""
    return incidence.join(elements.distinct(), "element", "left_semi").select("node").distinct()
