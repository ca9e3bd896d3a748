"""The central select: results of a class, by label, material, state and integration point, reduced or projected.

All checks are made on the driver before any job, but for labels, whose absence one probe tells. Variables that the rows
hold, and results that follow from one row, come from a single scan, however many they are.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import errors as E, kernels as K, topology
from ..functions.names import Name, parse_name, ravel
from ..operators import modifiers as M
from .derived import REGISTRY, Derived
from .model import ARRAY, SCALAR, VEC_ARRAY, VECTOR, Database, Variable, atom

MODIFIERS = ("MIN", "MAX", "AVERAGE", "MEDIAN", "STDDEV", "CUMMIN", "CUMMAX")
RESULT = ("svar", "class", "state", "label", "place", "component", "value")
_KEYS = ["svar", "class", "component", "place"]


def query(
    db: Database, names: str | list[str], mesh_class: str, *, material: str | int | None = None, labels: list[int] | DataFrame | None = None, states: list[int] | int | None = None,
    points: list[int] | None = None, subrecord: str | None = None, modifier: str | None = None, project: str | None = None, reference_state: int = 0, face: int | None = None, updates: DataFrame | None = None,
) -> DataFrame:
    """Rows (svar, class, state, label, place, component, value); ``place`` orders a result's components.

    ``updates`` (state, label, component, value) replaces values in what is returned; see ``written`` for the run itself.
    """
    asked = list(dict.fromkeys([names] if isinstance(names, str) else names))
    _guards(asked, modifier, project, updates)
    db.mesh_class(mesh_class)
    wanted = db.state_list(states)
    resolved = [_resolve(db, n, mesh_class, points, subrecord) for n in asked]
    keep = _label_filter(db, mesh_class, material, labels)

    parts: list[DataFrame] = []
    rows = [x for r in resolved if r.how == "row" for x in r.columns]
    if rows:
        parts.append(_scan(db, mesh_class, rows, wanted, keep))
    for r in resolved:
        if r.how == "states":
            parts.append(_over_states(db, r, mesh_class, wanted, keep, reference_state))
        elif r.how == "mesh":
            parts.append(_over_mesh(db, r, mesh_class, wanted, keep, reference_state, face))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if updates is not None:
        new = updates.select("state", "label", "component", F.col("value").alias("new"))
        out = out.join(new, ["state", "label", "component"], "left").withColumn("value", F.coalesce("new", "value")).select(*RESULT)
    if project:
        return projected(db, out, mesh_class)
    return reduced(out, modifier) if modifier else out


def _guards(names: list[str], modifier: str | None, project: str | None, updates: DataFrame | None) -> None:
    if not names:
        raise E.UnknownName("no result named")
    if modifier and modifier not in MODIFIERS:
        raise E.Unsupported(f"no modifier {modifier!r}")
    if project and project != "node":
        raise E.Unsupported(f"no projection to {project!r}")
    for a, b, text in ((modifier, updates, "a modifier and updates"), (project, modifier, "a projection and a modifier"), (project, updates, "a projection and updates")):
        if a and b is not None:
            raise E.Unsupported(f"{text} exclude each other")


# names


class Resolved:
    """A result: how it comes, and for rows the columns (svar that holds it, result, place, component, value)."""

    def __init__(self, name: str, how: str, columns: list[tuple] | None = None, derived: Derived | None = None, parts: tuple[str, int] | None = None):
        self.name, self.how, self.columns, self.derived, self.parts = name, how, columns or [], derived, parts


def _holder(db: Database, leaf: str, mesh_class: str) -> tuple[str, int] | None:
    """The first variable that the class's subrecords hold and the leaf's place in its row: itself, or a vector that it is a component of."""
    own = [v for s in db.subrecords if s.mesh_class == mesh_class for v in s.variables]
    for v in own:
        if v == leaf:
            return v, 0
    for v in own:
        if db.variable_of[v].kind == VECTOR and leaf in (places := db.leaves(v)):
            return v, places.index(leaf)
    return None


def _resolve(db: Database, text: str, mesh_class: str, points: list[int] | None, subrecord: str | None) -> Resolved:
    name: Name = parse_name(text)
    if subrecord is not None:
        own = [s for s in db.subrecords if s.mesh_class == mesh_class and s.name == subrecord]
        if not own:
            raise E.NoSubrecord(f"{mesh_class} has no subrecord {subrecord}")
        db = replace(db, subrecords=own)
    if name.base in REGISTRY and name.base not in db.variable_of:
        return _resolve_derived(db, REGISTRY[name.base], mesh_class)
    if name.base not in db.variable_of and not db.containing(name.base):
        raise E.UnknownName(f"no result {name.base}")
    held = _holder(db, name.base, mesh_class)
    if held is None:
        raise E.NoSubrecord(f"{mesh_class} does not carry {name.base}")
    holder, first = held
    v = db.variable_of.get(name.base, Variable(name.base))
    return Resolved(text, "row", [(holder, text, k, c, x) for k, (c, x) in enumerate(_columns(db, v, name, text, first, points))])


def _columns(db: Database, v: Variable, name: Name, text: str, first: int, points: list[int] | None) -> list[tuple[str, Column]]:
    """(component, value) of a variable, or of the part that a subscript picks; ``first`` is its place in the row."""
    if name.subscript:
        if v.kind != ARRAY:
            raise E.SubscriptNotApplicable(f"{v.name} is no array")
        try:
            return [(text, atom(first + ravel(name.subscript, v.dims)))]
        except E.QueryError as e:
            raise E.InvalidSubscript(str(e)) from None
    if name.component is not None and (v.kind not in (VECTOR, VEC_ARRAY) or name.component not in v.components):
        raise (E.SubscriptNotApplicable if v.kind in (SCALAR, ARRAY) else E.UnknownName)(f"{v.name} has no component {name.component}")
    if v.kind == VEC_ARRAY:
        stride = sum(map(db.atoms, v.components))
        have = db.points(v.name) or tuple(range(1, v.dims[0] + 1))
        want = sorted(set(points)) if points else list(have)
        if lost := [p for p in want if p not in have]:
            raise E.PointOutOfRange(f"{v.name} has no integration points {lost}")
        out, at = [], 0
        for c in v.components:
            if name.component in (None, c):
                out += [(f"{leaf} ipt. {p}", atom(first + have.index(p) * stride + at + k)) for k, leaf in enumerate(db.leaves(c)) for p in want]
            at += db.atoms(c)
        return out
    leaves = db.leaves(v.name)
    if name.component is not None:
        at = sum(map(db.atoms, v.components[: v.components.index(name.component)]))
        own = db.leaves(name.component)
        return [(c, atom(first + at + k)) for k, c in enumerate(own)]
    return [(c, atom(first + k)) for k, c in enumerate(leaves)]


def _resolve_derived(db: Database, d: Derived, mesh_class: str) -> Resolved:
    shape = db.superclass(mesh_class)
    if d.shapes and shape not in d.shapes:
        raise E.Unsupported(f"{d.name} is of {d.shapes}, and {mesh_class} is {shape}")
    on = d.on or mesh_class
    held = [_holder(db, n, on) for n in d.needs]
    if None in held and d.instead:
        held = [_holder(db, n, on) for n in d.instead]
    if None in held:
        raise E.NoSubrecord(f"{on} does not carry all of {d.needs}")
    if d.how != "row":
        return Resolved(d.name, d.how, derived=d, parts=held)
    if len({h for h, _ in held}) > 1:
        raise E.Unsupported(f"{d.name} needs variables of one row")
    return Resolved(d.name, "row", [(held[0][0], d.name, 0, d.name, d.compute(*[atom(i) for _, i in held]))])


# rows


def _label_filter(db: Database, mesh_class: str, material: str | int | None, labels: list[int] | DataFrame | None):
    """A function that keeps the rows of the labels and of the material; both together intersect."""
    chosen = None
    if material is not None:
        numbers = db.material_filter(material)
        own = db.elements.where(F.col("class") == mesh_class)
        there = {r.material for r in own.where(F.col("material").isin(numbers)).select("material").distinct().collect()}  # at most as many as were asked for
        if lost := [n for n in numbers if n not in there]:
            raise E.UnknownMaterial(f"{mesh_class} has no material {lost}")
        chosen = own.where(F.col("material").isin(numbers)).select("label").distinct()
    if labels is None:
        return (lambda df: df) if chosen is None else (lambda df: df.join(chosen, "label", "left_semi"))
    own = db.labels(mesh_class).select("label")
    if isinstance(labels, DataFrame):
        given = labels.select("label").distinct()
        found = own.join(given, "label", "left_semi")
    else:
        given = None
        found = own.where(F.col("label").isin(list(labels)))
    if not found.limit(1).count():
        raise E.LabelNotFound(f"{mesh_class} has none of the labels")

    def keep(df: DataFrame) -> DataFrame:
        df = df.join(given, "label", "left_semi") if given is not None else df.where(F.col("label").isin(list(labels)))
        return df if chosen is None else df.join(chosen, "label", "left_semi")

    return keep


def _rows(db: Database, mesh_class: str, svars: list[str], states: list[int], keep) -> DataFrame:
    """Packed rows, once for each label: ghosts of later fragments go."""
    own = db.values.where((F.col("class") == mesh_class) & F.col("svar").isin(svars) & F.col("state").isin(states))
    return db.first_seen(keep(own), ["svar", "state", "label"])


def _scan(db: Database, mesh_class: str, columns: list[tuple], states: list[int], keep) -> DataFrame:
    own = _rows(db, mesh_class, sorted({c[0] for c in columns}), states, keep)
    for svar in {c[0] for c in columns}:
        v = db.variable_of[svar]
        if v.kind == VEC_ARRAY and any("ipt." in c[3] for c in columns if c[0] == svar):
            ragged = own.where((F.col("svar") == svar) & (F.size("values") != db.atoms(svar)))
            if ragged.limit(1).count():
                raise E.InconsistentPoints(f"{svar} has rows without {db.atoms(svar)} numbers")
    cases = None
    for svar in sorted({c[0] for c in columns}):
        atoms = F.array(*[F.struct(F.lit(n).alias("svar"), F.lit(k).alias("place"), F.lit(c).alias("component"), x.alias("value")) for s, n, k, c, x in columns if s == svar])
        cases = F.when(F.col("svar") == svar, atoms) if cases is None else cases.when(F.col("svar") == svar, atoms)
    out = own.select("class", "state", "label", F.explode(cases).alias("x"))
    return out.select("x.svar", "class", "state", "label", "x.place", "x.component", "x.value")


def _result(df: DataFrame, r: Resolved, mesh_class: str, value: Column, component: str | None = None, place: int = 0) -> DataFrame:
    return df.select(F.lit(r.name).alias("svar"), F.lit(mesh_class).alias("class"), "state", "label", F.lit(place).alias("place"), F.lit(component or r.name).alias("component"), value.alias("value"))


def _times(db: Database) -> Column:
    """The time of the row's state, from the run's state map."""
    return F.element_at(F.create_map(*[F.lit(x) for s in db.states for x in (s.state, float(s.time))]), F.col("state"))


def _over_states(db: Database, r: Resolved, mesh_class: str, wanted: list[int], keep, reference: int) -> DataFrame:
    d, count = r.derived, db.state_count()
    (holder, _), places = r.parts[0], [i for _, i in r.parts]
    stencil = {"vel": (1, 0), "acc": (2, 2), "eps": (1, 1)}.get(d.name[:3])
    if stencil:  # the stencil's states are read as well, and go at the end
        if d.name.startswith("acc") and count < 3:
            raise E.Unsupported("an acceleration needs three states")
        span = sorted({t for s in wanted for t in range(max(1, s - stencil[0]), min(count, s + stencil[1]) + 1)})
        own = _rows(db, mesh_class, [holder], span, keep)
        if d.name == "eps_rate":
            leaves = db.leaves(holder) if db.variable_of[holder].kind != SCALAR else [d.name]
            long = own.select("state", "label", F.posexplode("values").alias("place", "value")).withColumn("value", F.col("value").cast("double"))
            named = F.element_at(F.array(*map(F.lit, leaves)), F.col("place") + 1)
            out = M.rate(long.withColumn("time", _times(db)), count, ["label", "place"], time="time")
            return out.where(F.col("state").isin(wanted)).select(F.lit(r.name).alias("svar"), F.lit(mesh_class).alias("class"), "state", "label", "place", named.alias("component"), F.col("rate").alias("value"))
        own = own.select("state", "label", atom(places[0]).alias("value")).withColumn("time", _times(db))
        out = M.velocity(own, ["label"], time="time") if d.name.startswith("vel") else M.acceleration(own, count, ["label"], time="time")
        return _result(out.where(F.col("state").isin(wanted)), r, mesh_class, F.col("velocity" if d.name.startswith("vel") else "acceleration"))
    # displacements: from the first coordinates (0), or from a state; a centre of gravity's reference is state 1 by default
    cog = d.name.startswith("mat_cog")
    names = [f"d{k}" for k in range(len(places))]
    own = _rows(db, mesh_class, [holder], wanted, keep).select("state", "label", *[atom(i).alias(n) for i, n in zip(places, names, strict=True)])
    if reference == 0 and not cog:
        axis = {"ux": "x", "uy": "y", "uz": "z"}
        ref = db.nodes().select("label", *[F.col(axis[n]).cast("double").alias(f"{k}_0") for n, k in zip(d.needs, names, strict=True)])
    else:
        at = db.state_list(reference or 1)
        ref = _rows(db, mesh_class, [holder], at, keep).select("label", *[atom(i).alias(f"{n}_0") for i, n in zip(places, names, strict=True)])
    moved = [F.col(n) - F.col(f"{n}_0") for n in names]
    value = moved[0] if len(moved) == 1 else K.magnitude(*moved)
    return _result(own.join(ref, "label"), r, mesh_class, value)


# the mesh


def gathered(db: Database, mesh_class: str, states: list[int], keep, reference: bool = False) -> DataFrame:
    """(state, label, x0, y0, z0, ...): the corners of each element in each state, and X0, ... of the first coordinates if asked for."""
    shape = topology.shape(db.superclass(mesh_class))
    holder, first = _holder(db, "ux", "node") or ("nodpos", 0)
    position = _rows(db, "node", [holder], states, lambda df: df).select("state", F.col("label").alias("node"), *[atom(first + k).alias(a) for k, a in enumerate("xyz")])
    if reference:
        position = position.join(db.nodes().select(F.col("label").alias("node"), *[F.col(a).cast("double").alias(a.upper() + "r") for a in "xyz"]), "node")
    corners = keep(db.connectivity(mesh_class)).select("label", F.posexplode("nodes").alias("corner", "node")).where(F.col("corner") < shape.spanning)
    columns = [*"xyz", *(["Xr", "Yr", "Zr"] if reference else [])]
    picks = [F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{c}{k}") for k in range(shape.spanning) for c in columns]
    return corners.join(position, "node").groupBy("state", "label").agg(F.count("*").alias("n"), *picks).where(F.col("n") == shape.spanning).drop("n")


def _points(n: int, names: str = "xyz", tail: str = "") -> list[tuple[Column, ...]]:
    return [tuple(F.col(f"{c}{tail}{k}") for c in names) for k in range(n)]


def _over_mesh(db: Database, r: Resolved, mesh_class: str, wanted: list[int], keep, reference: int, face: int | None) -> DataFrame:
    d, superclass = r.derived, db.superclass(mesh_class)
    if reference and d.name != "centroid":
        raise E.Unsupported(f"{d.name} is against the first coordinates only")
    if d.name == "centroid" and superclass == "NODE":
        own = _rows(db, "node", [r.parts[0][0]], wanted, keep)
        parts = [_result(own, r, mesh_class, atom(k), f"centroid_{a}", k) for k, a in enumerate("xyz")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])
    if not topology.shape(superclass).nodes:
        raise E.Unsupported(f"{mesh_class} has no nodes")
    n = topology.shape(superclass).spanning
    if d.name == "centroid":
        own = gathered(db, mesh_class, wanted, keep)
        means = [sum((F.col(f"{a}{k}") for k in range(1, n)), F.col(f"{a}0")) / float(n) for a in "xyz"]
        parts = [_result(own, r, mesh_class, m, f"centroid_{a}", k) for k, (a, m) in enumerate(zip("xyz", means, strict=True))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])
    if d.name in ("element_volume", "area"):
        own = gathered(db, mesh_class, wanted, keep)
        value = {"HEX": K.hex_volume, "TET": K.tet_volume, "QUAD": K.quad_area}[superclass](_points(n))
        return _result(own, r, mesh_class, value)
    if d.name == "relative_volume":
        own = gathered(db, mesh_class, wanted, keep, reference=True)
        order = range(8) if superclass == "HEX" else (0, 1, 2, 2, 3, 3, 3, 3)
        now, then = _points(n), _points(n, "XYZ", "r")
        return _result(own, r, mesh_class, K.divide(K.jacobian([now[k] for k in order]), K.jacobian([then[k] for k in order])))
    if d.name.startswith("surfstrain"):
        if face is None or not 1 <= face <= 6:
            raise E.Unsupported("a surface strain needs a face from 1 to 6")
        corners = topology.SHAPES["HEX"].faces[face - 1]
        own = gathered(db, mesh_class, wanted, keep, reference=True)
        now, then = _points(n), _points(n, "XYZ", "r")
        own, strain = K.surface_strain(own, [now[k] for k in corners], [then[k] for k in corners])
        return _result(own, r, mesh_class, strain[d.name.removeprefix("surfstrain")])
    # forces: the primal of each element times its area
    holder, at = r.parts[0]
    own = _rows(db, mesh_class, [holder], wanted, keep).select("state", "label", atom(at).alias("primal"))
    joined = own.join(gathered(db, mesh_class, wanted, keep), ["state", "label"], "left")
    if joined.where(F.col("x0").isNull()).limit(1).count():
        raise E.LabelNotFound(f"{mesh_class} has elements without an area")
    return _result(joined, r, mesh_class, F.col("primal") * K.quad_area(_points(n)))


# reductions and projections


def reduced(df: DataFrame, modifier: str) -> DataFrame:
    """One row for each state, with its label for MIN and MAX; running extrema keep all rows."""
    keys = [*_KEYS, "state"]
    if modifier in ("MIN", "MAX"):
        return M.extreme(df, modifier == "MAX", keys).select(*RESULT)
    if modifier in ("CUMMIN", "CUMMAX"):
        return M.running(df, modifier == "CUMMAX", [*_KEYS, "label"]).select(*RESULT)
    return M.reduced(df, modifier.lower(), keys).select("svar", "class", "state", "place", "component", "value")


def projected(db: Database, df: DataFrame, mesh_class: str) -> DataFrame:
    """Element values at the nodes: by volume for hexahedra and tetrahedra, plain means for other shapes, nodes as they are."""
    superclass = db.superclass(mesh_class)
    if superclass == "NODE":
        return df
    if superclass not in ("HEX", "TET", "QUAD", "TRI", "BEAM", "TRUSS", "PARTICLE", "INODE"):
        raise E.Unsupported(f"no projection of {superclass}")
    shape = topology.shape(superclass)
    corners = db.connectivity(mesh_class).select("label", F.posexplode("nodes").alias("corner", "node")).where(F.col("corner") < shape.spanning)
    keys = [*_KEYS, "state", F.col("node").alias("label")]
    if superclass in ("HEX", "TET"):
        states = [r.state for r in df.select("state").distinct().collect()]  # as many as the query's states
        volume = query(db, "element_volume", mesh_class, states=states).select("state", "label", F.col("value").alias("weight"))
        out = df.join(volume, ["state", "label"]).join(corners, "label").groupBy(*keys).agg(K.divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight")).alias("value"))
    else:
        out = df.join(corners, "label").groupBy(*keys).agg(F.avg("value").alias("value"))
    return out.select(*RESULT)


# writing


def written(db: Database, svar: str, mesh_class: str, updates: DataFrame) -> Database:
    """The run with values of a variable replaced: ``updates`` has (state, label, place, value), places from 0 in the row."""
    db.variable(svar)
    if mesh_class not in db.carriers(svar):
        raise E.NoSubrecord(f"{mesh_class} does not carry {svar}")
    new = updates.groupBy("state", "label").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("new"))  # at most a row's numbers
    mine = (F.col("class") == mesh_class) & (F.col("svar") == svar)
    own = db.values.where(mine).join(new, ["state", "label"], "left")
    values = F.when(F.col("new").isNull(), F.col("values")).otherwise(F.transform("values", lambda x, i: F.coalesce(F.try_element_at(F.col("new"), i).cast("double"), x.cast("double"))))
    return replace(db, values=own.withColumn("values", values).select(*db.values.columns).unionByName(db.values.where(~mine)))


def filled(db: Database, svar: str, mesh_class: str, state: int, value: float) -> Database:
    """The run with one variable of one class and state set to a constant."""
    db.variable(svar)
    (own,) = db.state_list(state)
    mine = (F.col("class") == db.mesh_class(mesh_class).name) & (F.col("svar") == svar) & (F.col("state") == own)
    return replace(db, values=db.values.withColumn("values", F.when(mine, F.transform("values", lambda _: F.lit(float(value)))).otherwise(F.col("values"))))


def appended(db: Database, time: float, zero: bool = False, states_per_file: int | None = None) -> Database:
    """The run with a state after the last: its values, or zeros (then positions are the first coordinates, and ``sand`` is 1)."""
    from .model import StateRecord

    last = db.states[-1] if db.states else None
    if last and time <= last.time:
        raise E.Unsupported(f"time {time} does not come after {last.time}")
    count = sum(s.file == last.file for s in db.states) if last else 0
    roll = last is not None and states_per_file is not None and count >= states_per_file
    new = StateRecord((last.state if last else 0) + 1, time, (last.file + roll) if last else 0, 0 if roll or not last else last.offset + 1)
    own = db.values.where(F.col("state") == (last.state if last else 0)).withColumn("state", F.lit(new.state))
    if zero:
        own = own.withColumn("values", F.transform("values", lambda _: F.lit(0.0)))
        first = db.nodes_table.select("frag", F.lit("node").alias("class"), "label", F.array(*[F.col(a).cast("double") for a in "xyz"]).alias("first"))
        own = own.join(first, ["frag", "class", "label"], "left")
        own = own.withColumn("values", F.when((F.col("svar") == "nodpos") & F.col("first").isNotNull(), F.col("first")).when(F.col("svar") == "sand", F.array(F.lit(1.0))).otherwise(F.col("values"))).select(*db.values.columns)
    return replace(db, states=[*db.states, new], values=db.values.withColumn("values", F.col("values").cast("array<double>")).unionByName(own.withColumn("values", F.col("values").cast("array<double>"))))


def offsets(df: DataFrame, width: str, order: list[str], keys: list[str]) -> DataFrame:
    """The sum of the widths before each row, within its keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(width).over(w), F.lit(0)))
