"""A run as metadata on the driver and tables of entities, nodes, connectivity and values.

Metadata (classes, variables, subrecords, parameters, states) has a size that does not grow with the run's values, and
lives on the driver; the accessors return it as DataFrames. Everything with a row for each entity is a DataFrame:

    entities  (frag, class, ordinal, label)                ordinal from 1 within a fragment's class
    nodes     (frag, ordinal, label, x, y, z)
    elements  (frag, class, ordinal, label, nodes array of node labels, material, part)
    values    (frag, class, svar, state, label, values array)

A fragment is a part of the run written by one process; ghosts stand in several fragments. Accessors merge fragments:
the first fragment that has an entity names it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import errors as E, topology

SCALAR, VECTOR, ARRAY, VEC_ARRAY = "SCALAR", "VECTOR", "ARRAY", "VEC_ARRAY"


@dataclass(frozen=True)
class MeshClass:
    name: str
    long_name: str
    superclass: str
    #: Label ranges (first, last) where the labels are not stored: none means that they are.
    ranges: tuple[tuple[int, int], ...] = ()


@dataclass(frozen=True)
class Variable:
    """A state variable: components are names of scalars, or of other variables that nest; dims are of arrays."""

    name: str
    title: str = ""
    kind: str = SCALAR
    dims: tuple[int, ...] = ()
    components: tuple[str, ...] = ()
    type: str = "float"


@dataclass(frozen=True)
class Subrecord:
    name: str
    mesh_class: str
    variables: tuple[str, ...]
    object_ordered: bool = False


@dataclass(frozen=True)
class StateRecord:
    state: int
    time: float
    file: int = 0
    offset: int = 0
    format: int = 0


@dataclass(frozen=True)
class Parameter:
    name: str
    value: object  # a number, a string or a tuple of numbers
    kind: str = "APPLICATION"


@dataclass(frozen=True)
class ElementSet:
    name: str
    points: tuple[int, ...]


WIDTHS = {"float": 4, "int": 4, "double": 8, "long": 8, "string": 1}
#: The fields of ``metadata`` with their parameter and default.
METADATA = {"code_name": ("code_name", ""), "username": ("username", ""), "job_id": ("job_id", ""), "nprocs": ("nproc", "1"), "date": ("date", ""), "host_name": ("host name", ""), "library_version": ("lib version", "")}


@dataclass
class Database:
    spark: SparkSession
    classes: list[MeshClass]
    variables: list[Variable]
    subrecords: list[Subrecord]
    states: list[StateRecord]
    entities: DataFrame
    nodes_table: DataFrame
    elements: DataFrame
    values: DataFrame
    parameters_list: list[Parameter] = field(default_factory=list)
    materials_list: list[tuple[str, int]] = field(default_factory=list)
    element_sets_list: list[ElementSet] = field(default_factory=list)
    dimensions: int = 3

    # lookups on the driver

    def __post_init__(self):
        self.variable_of = {v.name: v for v in self.variables}
        self.class_of = {c.name: c for c in self.classes}
        for c in self.classes:
            topology.shape(c.superclass)
        for s in self.subrecords:
            for v in s.variables:
                if v not in self.variable_of:
                    raise E.UnknownName(f"subrecord {s.name} names {v}")

    def mesh_class(self, name: str) -> MeshClass:
        if name not in self.class_of:
            raise E.UnknownClass(f"no class {name}")
        return self.class_of[name]

    def variable(self, name: str) -> Variable:
        if name not in self.variable_of:
            raise E.UnknownName(f"no variable {name}")
        return self.variable_of[name]

    def atoms(self, name: str) -> int:
        """Numbers that one entity has: 1, the components' sum, the dimensions' product, or both multiplied."""
        v = self.variable_of.get(name)
        if v is None or v.kind == SCALAR:
            return 1
        size = sum(map(self.atoms, v.components)) if v.components else 1
        for d in v.dims:
            size *= d
        return size

    def leaves(self, name: str) -> list[str]:
        """Names of a variable's atoms in order: nested components flattened, an array as ``name[1]`` and so on."""
        v = self.variable_of.get(name)
        if v is None or v.kind == SCALAR:
            return [name]
        if v.kind == ARRAY:
            return [f"{name}[{i}]" for i in range(1, self.atoms(name) + 1)]
        own = [x for c in v.components for x in self.leaves(c)]
        if v.kind == VECTOR:
            return own
        points = self.points(name) or range(1, self.atoms(name) // len(own) + 1)
        return [f"{c} ipt. {p}" for c in own for p in points]

    def points(self, name: str) -> tuple[int, ...]:
        """Labels of a variable's integration points; the last element set of its name counts."""
        return next((s.points for s in reversed(self.element_sets_list) if s.name == name), ())

    def carriers(self, name: str) -> list[str]:
        """Classes with a subrecord that holds the variable, directly or within another, in order."""
        def holds(v: str) -> bool:
            return v == name or any(map(holds, self.variable_of[v].components if v in self.variable_of else ()))

        return list(dict.fromkeys(s.mesh_class for s in self.subrecords if any(map(holds, s.variables))))

    def containing(self, name: str) -> list[str]:
        return [v.name for v in self.variables if name in v.components]

    def frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # accessors: the run

    def metadata(self) -> DataFrame:
        """(field, value) of seven fields, with their defaults."""
        own = {p.name: p.value for p in self.parameters_list}
        return self.frame([(k, str(own.get(name, default))) for k, (name, default) in METADATA.items()], "field string, value string")

    def parameters(self) -> DataFrame:
        """(place, name, kind, value): each name at its first place with its last value."""
        own = {p.name: p for p in self.parameters_list}
        return self.frame([(i, n, own[n].kind, _text(own[n].value)) for i, n in enumerate(dict.fromkeys(p.name for p in self.parameters_list))], "place int, name string, kind string, value string")

    def parameter(self, name: str, default: object = None) -> object:
        return {p.name: p.value for p in self.parameters_list}.get(name, default)

    def parameter_search(self, key: str) -> DataFrame:
        """Parameters named ``key`` or beginning with it."""
        return self.parameters().where(F.col("name").startswith(key))

    def state_maps(self) -> DataFrame:
        """(state, time, file, offset, format)."""
        return self.frame([(s.state, s.time, s.file, s.offset, s.format) for s in self.states], "state int, time double, file int, offset long, format int")

    def times(self, states: list[int] | int | None = None) -> DataFrame:
        wanted = self.state_list(states)
        return self.state_maps().where(F.col("state").isin(wanted)).select("state", "time")

    def state_list(self, states: list[int] | int | None) -> list[int]:
        """States from 1, sorted and distinct; negative ones count from the end."""
        count = self.state_count()
        own = range(1, count + 1) if states is None else [states] if isinstance(states, int) else states
        out = {s + count + 1 if s < 0 else s for s in own}
        if bad := sorted(s for s in out if not 1 <= s <= count):
            raise E.StateOutOfRange(f"states {bad} of 1..{count}")
        return sorted(out)

    def state_count(self) -> int:
        return len(self.states)

    def reload_state_maps(self, states: list[StateRecord]) -> bool:
        """Take in newly written states; their times must go on from the last."""
        times = [s.time for s in states]
        if any(b <= a for a, b in zip(times, times[1:], strict=False)):
            raise E.FragmentMismatch("times do not increase")
        self.states = list(states)
        return True

    def mesh_dimensions(self) -> int:
        return int(self.parameter("mesh dimensions", self.dimensions))

    def record_formats(self) -> int:
        return 1

    # accessors: classes and labels

    def class_names(self) -> DataFrame:
        return self.frame([(i, c.name) for i, c in enumerate(self.classes)], "place int, class string")

    def superclass(self, name: str) -> str:
        return self.mesh_class(name).superclass

    def first_seen(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of the first fragment that has the key."""
        first = df.groupBy(*keys).agg(F.min("frag").alias("frag"))
        return df.join(first, [*keys, "frag"], "left_semi").dropDuplicates(keys)

    def labels(self, name: str | None = None) -> DataFrame:
        """(class, label): stored labels, or those of the declared ranges."""
        if name is not None:
            self.mesh_class(name)
        own = self.entities.select("class", "label")
        for c in self.classes:
            for a, b in c.ranges:
                own = own.unionByName(self.spark.range(a, b + 1).select(F.lit(c.name).alias("class"), F.col("id").alias("label")))
        return (own if name is None else own.where(F.col("class") == name)).distinct()

    def idents_exist(self, name: str) -> bool:
        """Whether the class has a source of labels."""
        return bool(self.mesh_class(name).ranges) or bool(self.entities.where(F.col("class") == name).limit(1).count())

    def object_classes(self) -> DataFrame:
        """(place, class, long_name, superclass, quantity, idents): quantity counts labels, over all fragments once."""
        own = self.frame([(i, c.name, c.long_name, c.superclass, topology.shape(c.superclass).code) for i, c in enumerate(self.classes)], "place int, class string, long_name string, superclass string, code int")
        count = self.labels().groupBy("class").agg(F.count("*").alias("quantity"))
        out = own.join(F.broadcast(count), "class", "left")  # a row for each class
        return out.select("place", "class", "long_name", "superclass", "code", F.coalesce("quantity", F.lit(0)).alias("quantity"), F.col("quantity").isNotNull().alias("idents"))

    def nodes(self) -> DataFrame:
        """(label, x, y, z), each label as its first fragment has it."""
        return self.first_seen(self.nodes_table, ["label"]).select("label", "x", "y", "z")

    def connectivity(self, name: str | None = None) -> DataFrame:
        """(class, label, nodes, material, part): nodes by label."""
        own = self.elements if name is None else self.elements.where(F.col("class") == self.mesh_class(name).name)
        return self.first_seen(own, ["class", "label"]).select("class", "label", "nodes", "material", "part")

    def connectivity_ids(self, name: str | None = None) -> DataFrame:
        """(frag, class, label, ids, material): nodes by their place in their fragment, from 0. Not merged, as places are the fragment's own."""
        own = self.elements if name is None else self.elements.where(F.col("class") == self.mesh_class(name).name)
        rows = own.select("frag", "class", F.col("label").alias("element"), "material", F.posexplode("nodes").alias("corner", "label"))
        found = rows.join(self.nodes_table.select("frag", "label", "ordinal"), ["frag", "label"])
        ids = F.transform(F.array_sort(F.collect_list(F.struct("corner", "ordinal"))), lambda x: x["ordinal"] - 1)
        return found.groupBy("frag", "class", "element", "material").agg(ids.alias("ids")).select("frag", "class", F.col("element").alias("label"), "ids", "material")

    # accessors: materials and parts

    def materials(self) -> DataFrame:
        """(name, numbers) sorted."""
        out: dict[str, list[int]] = {}
        for name, number in self.materials_list:
            out.setdefault(name, []).append(number)
        return self.frame([(n, sorted(set(v))) for n, v in out.items()], "name string, numbers array<int>")

    def material_numbers(self) -> DataFrame:
        return self.elements.select("material").distinct()

    def material_filter(self, material: str | int) -> list[int]:
        """Numbers of a material given by name, number or digits."""
        named = [n for name, n in self.materials_list if name == material]
        if named:
            return sorted(set(named))
        if isinstance(material, int) or str(material).strip().isdigit():
            return [int(material)]
        raise E.UnknownMaterial(f"no material {material!r}")

    def material_classes(self, material: str | int) -> DataFrame:
        return self.elements.where(F.col("material").isin(self.material_filter(material))).select("class").distinct()

    def labels_of_material(self, material: str | int, name: str | None = None) -> DataFrame:
        """(class, label) of the elements of a material."""
        own = self.elements.where(F.col("material").isin(self.material_filter(material)))
        return (own if name is None else own.where(F.col("class") == self.mesh_class(name).name)).select("class", "label").distinct()

    def nodes_of_material(self, material: str | int) -> DataFrame:
        own = self.elements.where(F.col("material").isin(self.material_filter(material)))
        return own.select(F.explode("nodes").alias("label")).distinct()

    def of_class(self, name: str, column: str) -> DataFrame:
        """(label, material or part) of each label of a class, -1 where it has none."""
        own = self.first_seen(self.elements.where(F.col("class") == self.mesh_class(name).name), ["label"])
        return self.labels(name).select("label").join(own.select("label", column), "label", "left").select("label", F.coalesce(column, F.lit(-1)).alias(column))

    def materials_of_class(self, name: str) -> DataFrame:
        return self.of_class(name, "material")

    def parts_of_class(self, name: str) -> DataFrame:
        return self.of_class(name, "part")

    def nodes_of_elements(self, name: str, labels: list[int]) -> DataFrame:
        """(label, nodes) of the elements asked for; an error if the class has none of them."""
        shape = topology.shape(self.superclass(name))
        if not shape.nodes:
            raise E.Unsupported(f"class {name} has no connectivity")
        out = self.connectivity(name).where(F.col("label").isin(labels)).select("label", "nodes")
        if not out.limit(1).count():
            raise E.LabelNotFound(f"{name} has none of {labels}")
        return out

    def elements_of_nodes(self, labels: list[int], material: str | int | None = None) -> DataFrame:
        """(class, label) of the elements with any of the nodes, of all classes, of a material if one is named."""
        own = self.elements if material is None else self.elements.where(F.col("material").isin(self.material_filter(material)))
        return own.where(F.arrays_overlap("nodes", F.array(*[F.lit(x).cast("long") for x in labels]))).select("class", "label").distinct()

    def faces(self, name: str, label: int) -> DataFrame:
        """(face, nodes) of a hexahedron, faces from 1."""
        if self.superclass(name) != "HEX":
            raise E.Unsupported("faces are of hexahedra")
        out = self.connectivity(name).where(F.col("label") == label)
        table = topology.SHAPES["HEX"].faces
        faces = F.array(*[F.struct(F.lit(k + 1).alias("face"), F.array(*[F.col("nodes")[i] for i in f]).alias("nodes")) for k, f in enumerate(table)])
        return out.select(F.explode(faces).alias("f")).select("f.face", "f.nodes")

    # accessors: variables and points

    def element_sets(self) -> DataFrame:
        """(name, points, count); the last set of a name counts."""
        own = {s.name: s for s in self.element_sets_list}
        return self.frame([(s.name, list(s.points), len(s.points)) for s in own.values()], "name string, points array<int>, count int")

    def integration_points(self) -> DataFrame:
        """(material, points): the material is a set name's last digit."""
        own = {int(s.name[-1]): s.points for s in self.element_sets_list if s.name[-1:].isdigit()}
        return self.frame([(m, list(p)) for m, p in own.items()], "material int, points array<int>")

    def points_of_variable(self, name: str, mesh_class: str) -> list[int]:
        """Labels of the points of the last element set that is the variable, or holds it, and that the class carries."""
        self.variable(name)
        self.mesh_class(mesh_class)
        own = [s for s in self.element_sets_list if (s.name == name or name in self.variable_of.get(s.name, Variable("")).components) and mesh_class in self.carriers(s.name)]
        return list(own[-1].points) if own else []

    def state_variables(self) -> DataFrame:
        rows = [(i, v.name, v.title, v.kind, v.type, list(v.dims), list(v.components), self.atoms(v.name), self.containing(v.name)) for i, v in enumerate(self.variables)]
        return self.frame(rows, "place int, svar string, title string, kind string, type string, dims array<int>, components array<string>, atoms int, containers array<string>")

    def queriable(self, vector_only: bool = False, show_points: bool = False) -> DataFrame:
        """(place, name): variables, and ``v[c]`` for the components of vectors; of vectors only, if so asked."""
        out: list[str] = []
        for v in self.variables:
            if v.kind == VECTOR:
                out += [v.name, *(f"{v.name}[{c}]" for c in v.components)]
            elif v.kind == VEC_ARRAY:
                out += [f"{v.name}{f'[0-{v.dims[0]}]' if show_points else ''}[{c}]" for c in v.components]
            elif not vector_only:
                out.append(v.name)
        return self.frame(list(enumerate(out)), "place int, name string")

    def classes_of_variable(self, name: str) -> DataFrame:
        self.variable(name)
        return self.frame([(c,) for c in self.carriers(name)], "class string")

    def variables_of_class(self, name: str) -> DataFrame:
        self.mesh_class(name)
        return self.frame([(v.name,) for v in self.variables if name in self.carriers(v.name)], "svar string")

    def containing_variables(self, name: str, mesh_class: str) -> DataFrame:
        self.variable(name)
        self.mesh_class(mesh_class)
        return self.frame([(c,) for c in self.containing(name) if mesh_class in self.carriers(c)], "svar string")

    def components_of(self, name: str) -> DataFrame:
        v = self.variable(name)
        if v.kind not in (VECTOR, VEC_ARRAY):
            raise E.SubscriptNotApplicable(f"{name} is no vector")
        return self.frame(list(enumerate(v.components)), "place int, component string")

    def titles(self) -> DataFrame:
        return self.frame([(v.name, v.title) for v in self.variables], "svar string, title string")

    def subrecord_table(self) -> DataFrame:
        """(place, subrecord, class, entities, bytes, offset): bytes of a state, and those of all subrecords before."""
        rows = [(i, s.name, s.mesh_class, sum(self.atoms(v) * WIDTHS[self.variable_of[v].type] for v in s.variables), s.object_ordered) for i, s in enumerate(self.subrecords)]
        own = self.frame(rows, "place int, subrecord string, class string, width long, object_ordered boolean")
        count = self.labels().groupBy("class").agg(F.count("*").alias("entities"))
        sized = own.join(F.broadcast(count), "class", "left").withColumn("entities", F.coalesce("entities", F.lit(0))).withColumn("bytes", F.col("entities") * F.col("width"))
        from pyspark.sql import Window

        # a row for each subrecord: no table of values goes through this window
        before = F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        return sized.select("place", "subrecord", "class", "object_ordered", "entities", "bytes", F.coalesce(before, F.lit(0)).alias("offset"))

    # whole values and bundles

    def variable_values(self, name: str, mesh_class: str, state: int) -> DataFrame:
        """(label, values) of one variable, class and state."""
        self.variable(name)
        (own,) = self.state_list(state)
        return self.values.where((F.col("class") == self.mesh_class(mesh_class).name) & (F.col("svar") == name) & (F.col("state") == own)).select("label", "values")

    def bundle(self) -> dict[str, DataFrame]:
        """What a viewer asks for at first: classes, nodes, connectivity by fragment, subrecords and variables, and the nodes of no element."""
        used = self.elements.select(F.explode("nodes").alias("label")).distinct()
        free = self.nodes().select("label").join(used, "label", "left_anti")
        return {"classes": self.object_classes(), "nodes": self.nodes(), "connectivity": self.connectivity_ids(), "subrecords": self.subrecord_table(), "variables": self.state_variables(), "free_nodes": free}

    # fragments

    def check_fragments(self, times: DataFrame) -> None:
        """``times`` (frag, state, time): an error unless all fragments have the same states and times, to the bit."""
        bad = times.groupBy("state").agg(F.countDistinct("time").alias("k"), F.countDistinct("frag").alias("f"))
        frags = times.select("frag").distinct().count()
        if bad.where((F.col("k") > 1) | (F.col("f") < frags)).limit(1).count():
            raise E.FragmentMismatch("the fragments' time axes differ")

    def only_fragments(self, frags: list[int]) -> Database:
        """The run as these fragments have it."""
        from dataclasses import replace

        own = F.col("frag").isin(frags)
        return replace(self, entities=self.entities.where(own), nodes_table=self.nodes_table.where(own), elements=self.elements.where(own), values=self.values.where(own))

    def without_states(self) -> Database:
        """A copy of everything but states and values."""
        from dataclasses import replace

        return replace(self, states=[], values=self.values.where("false"))


def _text(value: object) -> str:
    return ",".join(map(str, value)) if isinstance(value, (tuple, list)) else str(value)


def atom(i: int) -> Column:
    """The i-th number of the packed values, from 0."""
    return F.element_at("values", i + 1).cast("double")
