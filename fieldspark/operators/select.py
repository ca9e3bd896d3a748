"""Selections: labels, states, materials, ranges, integration points and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import Name, QueryError, parse_name, ranges, ravel


def by_labels(df: DataFrame, labels: list[int], column: str = "label") -> DataFrame:
    """Rows of the labels; absent labels are dropped silently. The list comes from the user, so it is a pushed-down filter."""
    return df.where(F.col(column).isin(*labels))


def by_states(df: DataFrame, wanted: list[int], count: int) -> DataFrame:
    from ..functions.names import states

    return df.where(F.col("state").isin(*states(wanted, count)))


def by_range(df: DataFrame, text: str, column: str = "label") -> DataFrame:
    """Rows whose label is in a range string; no list is expanded."""
    cond = F.lit(False)
    for a, b in ranges(text):
        cond = cond | F.col(column).between(a, b)
    return df.where(cond)


def by_material(df: DataFrame, elements: DataFrame, material) -> DataFrame:
    """Rows whose label has the material; ``elements`` has (label, material)."""
    return df.join(elements.where(F.col("material") == F.lit(material)).select("label"), "label", "left_semi")


def component(values: str, name: str, comps: tuple[str, ...] = (), dims: tuple[int, ...] = ()) -> Column:
    """The atom of a packed array that a name like ``v[sx]`` or ``v[3]`` picks."""
    n: Name = parse_name(name)
    if n.component is not None:
        if n.component not in comps:
            raise QueryError(f"{n.base} has no component {n.component}")
        return F.element_at(values, comps.index(n.component) + 1)
    if n.subscript:
        return F.element_at(values, ravel(n.subscript, dims) + 1)
    return F.col(values)


def integration_points(values: str, points: list[int], labels: list[int], comps: tuple[str, ...]) -> dict[str, Column]:
    """Atoms named ``"{comp} ipt. {label}"``, component by component, of the points whose labels are asked for."""
    places = sorted({labels.index(p) for p in points if p in labels})
    if not places:
        raise QueryError(f"no integration point of {points}")
    return {f"{c} ipt. {labels[i]}": F.element_at(values, i * len(comps) + k + 1) for k, c in enumerate(comps) for i in places}


def leaves(df: DataFrame, values: str, name: str, keys: list[str]) -> DataFrame:
    """One row for each atom, named ``name[1]`` and so on."""
    long = df.select(*keys, F.posexplode(values).alias("place", "value"))
    return long.select(*keys, F.concat(F.lit(f"{name}["), (F.col("place") + 1).cast("string"), F.lit("]")).alias("component"), F.col("value").cast("double").alias("value"))
