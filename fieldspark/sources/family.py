"""Binary families of runs as a Spark data source.

A family is a metadata file ``<base>A`` (``<base><digits>A`` for a fragment) with state files ``<base>00``, ``<base>01`` and,
where the metadata file has no state map, a map in ``<base>T``. The metadata file opens with a fixed header and ends in a
directory that is found from its last 16 bytes. It is read on the driver, once for each fragment, as its size does not
grow with the number of states; ``spark.read.format("run_family")`` then plans fragments and runs of states, and each
task reads the byte ranges of its own states.

All layouts are fixed values of the format.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..database import Database, ElementSet, MeshClass, Parameter, StateRecord, Subrecord, Variable
from ..functions import errors as E, topology

MAGIC, END_OF_MAP = b"mili", b"~"
#: Directory entries by code.
NODES, CONNECTIVITY, IDENTS, VARIABLES, RECORD, PARAM, APPLICATION, CLASS, SURFACE, TI = range(10)
_PARAMS = {PARAM: "RUN", APPLICATION: "APPLICATION", TI: "TI"}
#: Number types by code: string, two floats of four bytes, one of eight, two integers of four, one of eight.
TYPES = {1: ("S", 1), 2: ("f4", 4), 3: ("f4", 4), 4: ("f8", 8), 5: ("i4", 4), 6: ("i4", 4), 7: ("i8", 8)}
_NAMES = {1: "string", 2: "float", 3: "float", 4: "double", 5: "int", 6: "int", 7: "long"}
KINDS = ("SCALAR", "VECTOR", "ARRAY", "VEC_ARRAY")
#: Bytes before a state's data: its time and its format.
STATE_HEADER = 8


class FamilyError(E.QueryError):
    """Bytes that are no family, or of a version that is not read."""


@dataclass(frozen=True)
class Header:
    version: int
    directory: int
    big: bool
    double: bool
    suffix: int
    by_bytes: bool

    @property
    def order(self) -> str:
        return ">" if self.big else "<"


def header(data: bytes) -> Header:
    """The 16 bytes at the front: magic, versions, byte order, precision, suffix width, partition scheme; extensions are not read."""
    if len(data) < 16 or data[:4] != MAGIC:
        raise FamilyError("no family header")
    version, directory, order, precision, suffix, scheme = data[4:10]
    if not 2 <= version <= 3 or not 2 <= directory <= 3:
        raise FamilyError(f"versions {version} and {directory} are not read")
    if order not in (1, 2) or precision not in (1, 2) or scheme not in (1, 2) or not suffix or data[15]:
        raise FamilyError("header fields out of range")
    return Header(version, directory, order == 1, precision == 2, suffix, scheme == 2)


@dataclass(frozen=True)
class Entry:
    kind: int
    first: int
    second: int
    offset: int
    length: int
    names: tuple[str, ...]


def directory(data: bytes, head: Header) -> tuple[list[Entry], bytes, int]:
    """Entries with their names, the inline state map, and the number of states, walking back from the last four integers."""
    if len(data) < 32:
        raise FamilyError("no directory")
    names_length, _, count, states = struct.unpack(f"{head.order}4i", data[-16:])
    if count < 1 or names_length < 0:
        raise FamilyError("directory counts out of range")
    word = 4 if head.directory == 2 else 8
    map_start = len(data) - 16 - 20 * max(states, 0)
    start = map_start - 6 * word * count
    if start - names_length < 16:
        raise FamilyError("directory reaches into the header")
    numbers = np.frombuffer(data, f"{head.order}i{word}", 6 * count, start).reshape(count, 6)
    try:
        names = data[start - names_length : start].decode().split("\0")
    except UnicodeDecodeError:
        raise FamilyError("names are no text") from None
    out, at = [], 0
    for kind, first, second, strings, offset, length in numbers.tolist():
        if not 0 <= kind <= 9 or strings < 0 or at + strings > len(names):
            raise FamilyError("directory entry out of range")
        if offset < 0 or length < 0 or offset + length > len(data):
            raise FamilyError("payload past the end")
        out.append(Entry(kind, first, second, offset, length, tuple(names[at : at + strings])))
        at += strings
    return out, data[map_start : len(data) - 16], states


def parameter(data: bytes, entry: Entry, head: Header):
    """A scalar, a text, or the numbers of an array (rank, dimensions, then the body in row order)."""
    raw = data[entry.offset : entry.offset + entry.length]
    if entry.first not in TYPES or entry.second not in (0, 2):
        raise FamilyError(f"parameter {entry.names} of an unknown type")
    code, width = TYPES[entry.first]
    if entry.second == 2:
        (rank,) = struct.unpack_from(f"{head.order}i", raw)
        dims = struct.unpack_from(f"{head.order}{rank}i", raw, 4)
        atoms = int(np.prod(dims)) if dims else 1
        at = 4 + 4 * rank
        if rank < 0 or min(dims, default=0) < 0 or len(raw) < at + atoms * width:
            raise FamilyError(f"array {entry.names} past its payload")
        return raw[at : at + atoms].decode() if code == "S" else tuple(np.frombuffer(raw, head.order + code, atoms, at).tolist())
    if code == "S":
        return raw.split(b"\0", 1)[0].decode()
    if len(raw) < width:
        raise FamilyError(f"scalar {entry.names} past its payload")
    return np.frombuffer(raw, head.order + code, 1)[0].item()


def _streams(raw: bytes, head: Header, words: int, letters: int, at: int) -> tuple[list[int], list[str]]:
    """The integers and the texts that follow one another in a definition's payload."""
    if words < 0 or letters < 0 or len(raw) < at + 4 * words + letters:
        raise FamilyError("definition past its payload")
    numbers = np.frombuffer(raw, f"{head.order}i4", words, at).tolist()
    return numbers, raw[at + 4 * words : at + 4 * words + letters].decode().split("\0")


def variables(data: bytes, entry: Entry, head: Header, known: dict[str, Variable]) -> None:
    """Definitions of state variables; components that are new are defined right behind what they belong to."""
    raw = data[entry.offset : entry.offset + entry.length]
    words, letters = struct.unpack_from(f"{head.order}2i", raw)
    numbers, texts = _streams(raw, head, words - 2, letters, 8)
    ints, strings = iter(numbers), iter(texts)

    def one(kind: int) -> None:
        code = next(ints)
        name, title = next(strings), next(strings)
        if code not in TYPES or not 0 <= kind <= 3:
            raise FamilyError(f"variable {name} of an unknown type")
        dims = tuple(next(ints) for _ in range(next(ints))) if kind in (2, 3) else ()
        components = tuple(next(strings) for _ in range(next(ints))) if kind in (1, 3) else ()
        for c in components:
            if known.get(c) is None:
                one(next(ints))
        known[name] = Variable(name, title, KINDS[kind], dims, components, _NAMES[code])

    try:
        for kind in ints:
            one(kind)
    except StopIteration:
        raise FamilyError("variable definitions end too early") from None


@dataclass
class Block:
    """A subrecord: its layout, and the ranges of the ids that it holds, from 1."""

    name: str
    mesh_class: str
    variables: tuple[str, ...]
    by_object: bool
    ids: list[tuple[int, int]]

    @property
    def count(self) -> int:
        return sum(b - a + 1 for a, b in self.ids)


def record(data: bytes, entry: Entry, head: Header) -> tuple[int, list[Block]]:
    """The id of a record format, and its subrecords."""
    raw = data[entry.offset : entry.offset + entry.length]
    record_id, _, _, count = struct.unpack_from(f"{head.order}4i", raw)
    numbers, texts = _streams(raw, head, entry.first - 4, entry.second, 16)
    ints, strings = iter(numbers), iter(texts)
    out = []
    try:
        for _ in range(count):
            organization, held, blocks = next(ints), next(ints), next(ints)
            if organization not in (0, 1):
                raise FamilyError("subrecord of an unknown organization")
            name, mesh_class = next(strings), next(strings)
            own = tuple(next(strings) for _ in range(held))
            out.append(Block(name, mesh_class, own, organization == 1, [(next(ints), next(ints)) for _ in range(blocks)]))
    except StopIteration:
        raise FamilyError("subrecords end too early") from None
    return record_id, out


def state_map(raw: bytes, head: Header) -> list[StateRecord]:
    if len(raw) % 20:
        raise FamilyError("state map of a broken length")
    rows = np.frombuffer(raw, np.dtype([("file", f"{head.order}i4"), ("offset", f"{head.order}i8"), ("time", f"{head.order}f4"), ("format", f"{head.order}i4")]))
    return [StateRecord(i + 1, float(r["time"]), int(r["file"]), int(r["offset"]), int(r["format"])) for i, r in enumerate(rows)]


@dataclass
class Family:
    """What a fragment's metadata file says, and where its states are."""

    path: str
    head: Header
    states: list[StateRecord]
    classes: list[MeshClass]
    variables: dict[str, Variable]
    blocks: dict[int, list[Block]]
    parameters: list[Parameter]
    labels: dict[str, np.ndarray]
    coordinates: np.ndarray
    connectivity: dict[str, np.ndarray]  # nodes from 1, material, part
    materials: list[tuple[str, int]] = field(default_factory=list)
    sets: list[ElementSet] = field(default_factory=list)

    def state_file(self, number: int) -> str:
        return f"{self.path[:-1]}{number:0{self.head.suffix}d}"

    def atoms(self, name: str) -> int:
        v = self.variables[name]
        size = sum(map(self.atoms, v.components)) if v.components else 1
        return size * int(np.prod(v.dims)) if v.dims else size

    def leaf(self, name: str) -> Variable:
        """The scalar that says how a variable's numbers are stored."""
        v = self.variables[name]
        return self.leaf(v.components[0]) if v.components else v


_DTYPE = {"float": "f4", "double": "f8", "int": "i4", "long": "i8"}


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _read(path: str, start: int = 0, length: int | None = None) -> bytes:
    fs, own = _fs(path)
    with fs.open_input_file(own) as f:
        return f.read_at(f.size() - start if length is None else length, start)


def family(path: str) -> Family:
    """Read a metadata file."""
    data = _read(path)
    head = header(data)
    entries, inline, count = directory(data, head)
    if count <= 0 and head.version >= 3:  # the map is a file of its own; a run without one has no states yet
        try:
            raw = _read(f"{path[:-1]}T")
        except FileNotFoundError:
            raw = END_OF_MAP
        if raw[-1:] != END_OF_MAP:
            raise FamilyError("state map without its end")
        inline = raw[:-1]
    known: dict[str, Variable] = {}
    blocks: dict[int, list[Block]] = {}
    classes: dict[str, list] = {}
    values: list[Parameter] = []
    labels: dict[str, list] = {}
    ranges: dict[str, list] = {}
    materials, sets, conns, coords = [], [], {}, []
    dims = next((parameter(data, e, head) for e in entries if e.kind in _PARAMS and e.names[:1] == ("mesh dimensions",)), 3)
    for e in entries:
        raw = data[e.offset : e.offset + e.length]
        if e.kind == CLASS:
            name, long_name = e.names[:2]
            shape = topology.CODES.get(e.second)
            if shape is None or name in classes and classes[name][1] != shape:
                raise FamilyError(f"class {name} of a conflicting shape")
            classes[name] = [long_name, shape]
        elif e.kind == IDENTS:
            _, a, b = struct.unpack_from(f"{head.order}3i", raw)
            ranges.setdefault(e.names[0], []).append((a, b))
        elif e.kind == NODES:
            a, b = struct.unpack_from(f"{head.order}2i", raw)
            coords.append(np.frombuffer(raw, f"{head.order}f4", (b - a + 1) * dims, 8).reshape(-1, dims).astype(np.float32))
            ranges.setdefault(e.names[0], []).append((a, b))
        elif e.kind == CONNECTIVITY:
            code, parts = struct.unpack_from(f"{head.order}2i", raw)
            own = np.frombuffer(raw, f"{head.order}i4", 2 * parts, 8).reshape(-1, 2).tolist()
            shape = topology.shape(code)
            rows = sum(b - a + 1 for a, b in own)
            conns.setdefault(e.names[0], []).append(np.frombuffer(raw, f"{head.order}i4", rows * (shape.nodes + 2), 8 + 8 * parts).reshape(rows, -1).astype(np.int32))
            ranges.setdefault(e.names[0], []).extend(map(tuple, own))
        elif e.kind == VARIABLES:
            variables(data, e, head, known)
        elif e.kind == RECORD:
            record_id, own = record(data, e, head)
            blocks[record_id] = own
        elif e.kind in _PARAMS and e.names:
            value = parameter(data, e, head)
            name = e.names[0]
            values.append(Parameter(name, value, _PARAMS[e.kind]))
            found = re.search(r"\[.*/Sname-([^/]+)/", name)
            if e.kind == TI and found and "ElemIds" not in name and name.startswith("Node Labels" if found[1] == "node" else "Element Labels"):
                labels.setdefault(found[1], []).append(np.array(value, np.int64))
            elif e.kind == TI and (m := re.fullmatch(r"MAT_NAME_(\d+)", name)):
                materials.append((str(value), int(m[1])))
            elif e.kind == TI and name.startswith("IntLabel_es_"):
                sets.append(ElementSet(name.removeprefix("IntLabel_"), tuple(value[:-1])))
    for own in blocks.values():  # a subrecord of the whole mesh lists no ids
        for b in own:
            if not b.ids and classes.get(b.mesh_class, ["", ""])[1] == "MESH":
                b.ids.append((1, 1))
    named = {c: np.concatenate(x) for c, x in labels.items()}
    for c, own in ranges.items():
        named.setdefault(c, np.concatenate([np.arange(a, b + 1) for a, b in own]))
    return Family(
        path, head, state_map(inline, head), [MeshClass(n, long, s) for n, (long, s) in classes.items()], known, blocks, values, named,
        np.concatenate(coords) if coords else np.empty((0, dims), np.float32), {c: np.concatenate(x) for c, x in conns.items()}, materials, sets,
    )


def fragments(base: str, wanted: list[int] | None = None) -> list[tuple[int, str]]:
    """(rank, path) of the metadata files that ``base`` names: ``<base>A`` alone, or ``<base><digits>A``."""
    fs, own = _fs(base)
    folder, _, stem = own.rpartition("/")
    found = []
    for info in fs.get_file_info(pafs.FileSelector(folder or ".")):
        if m := re.fullmatch(re.escape(stem) + r"(\d*)A", info.base_name):
            found.append((int(m[1]) if m[1] else 0, base[: len(base) - len(stem)] + info.base_name))
    out = sorted(f for f in found if wanted is None or f[0] in wanted)
    if not out:
        raise FamilyError(f"no family {base}")
    return out


# the data source


class Part(InputPartition):
    def __init__(self, frag: int, path: str, states: list[int]):
        self.frag, self.path, self.states = frag, path, states


SCHEMAS = {
    "values": "frag int, class string, svar string, state int, label long, values array<double>",
    "nodes": "frag int, ordinal int, label long, x double, y double, z double",
    "elements": "frag int, class string, ordinal int, label long, nodes array<long>, material int, part int",
    "entities": "frag int, class string, ordinal int, label long",
    "states": "frag int, state int, time float, file int, offset long, format int",
}


def _array(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, max(rows.shape[1], 1), dtype=np.int32)), pa.array(np.ascontiguousarray(rows).ravel()))


class FamilyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.table = options["path"], options.get("table", "values")
        self.wanted = [int(x) for x in options["fragments"].split(",")] if options.get("fragments") else None
        self.per_task = int(options.get("states_per_task", 16))

    def partitions(self):
        out = []
        for frag, path in fragments(self.base, self.wanted):
            if self.table != "values":
                out.append(Part(frag, path, []))
                continue
            states = [s.state for s in family(path).states]
            out += [Part(frag, path, states[i : i + self.per_task]) for i in range(0, len(states), self.per_task)]
        return out or [Part(-1, "", [])]

    def read(self, part):
        if part.frag < 0:
            return
        own = family(part.path)
        yield from getattr(self, self.table)(own, part)

    def states(self, own: Family, part: Part):
        s = own.states
        yield pa.RecordBatch.from_arrays(
            [pa.array([part.frag] * len(s), pa.int32()), pa.array([x.state for x in s], pa.int32()), pa.array([x.time for x in s], pa.float32()), pa.array([x.file for x in s], pa.int32()), pa.array([x.offset for x in s], pa.int64()), pa.array([x.format for x in s], pa.int32())],
            names=["frag", "state", "time", "file", "offset", "format"],
        )

    def entities(self, own: Family, part: Part):
        for c, labels in own.labels.items():
            n = len(labels)
            yield pa.RecordBatch.from_arrays([pa.array([part.frag] * n, pa.int32()), pa.array([c] * n), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(labels.astype(np.int64))], names=["frag", "class", "ordinal", "label"])

    def nodes(self, own: Family, part: Part):
        n = len(own.coordinates)
        xyz = np.zeros((n, 3))
        xyz[:, : own.coordinates.shape[1]] = own.coordinates
        labels = own.labels.get("node", np.arange(1, n + 1))
        yield pa.RecordBatch.from_arrays([pa.array([part.frag] * n, pa.int32()), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(labels.astype(np.int64)), *[pa.array(xyz[:, i].copy()) for i in range(3)]], names=["frag", "ordinal", "label", "x", "y", "z"])

    def elements(self, own: Family, part: Part):
        nodes = own.labels.get("node", np.arange(1, len(own.coordinates) + 1))
        for c, rows in own.connectivity.items():
            n = len(rows)
            labels = own.labels.get(c, np.arange(1, n + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.frag] * n, pa.int32()), pa.array([c] * n), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(labels.astype(np.int64)), _array(nodes[rows[:, :-2] - 1].astype(np.int64)), pa.array(rows[:, -2].copy()), pa.array(rows[:, -1].copy())],
                names=["frag", "class", "ordinal", "label", "nodes", "material", "part"],
            )

    def values(self, own: Family, part: Part):
        for state in part.states:
            meta = own.states[state - 1]
            at = meta.offset + STATE_HEADER
            for b in own.blocks.get(meta.format, []):
                widths = [own.atoms(v) * np.dtype(_DTYPE[own.leaf(v).type]).itemsize for v in b.variables]
                raw = _read(own.state_file(meta.file), at, b.count * sum(widths))
                if len(raw) < b.count * sum(widths):
                    raise FamilyError(f"state {state} ends within {b.name}")
                at += len(raw)
                ids = np.concatenate([np.arange(x, y + 1) for x, y in b.ids]) if b.ids else np.empty(0, np.int64)
                labels = own.labels[b.mesh_class][ids - 1] if b.mesh_class in own.labels else ids
                place = 0
                for v, width in zip(b.variables, widths, strict=True):
                    dtype = own.head.order + _DTYPE[own.leaf(v).type]
                    if b.by_object:  # one entity's variables stand together
                        rows = np.frombuffer(raw, np.uint8).reshape(b.count, -1)[:, place : place + width].copy().view(dtype)
                        place += width
                    else:
                        rows = np.frombuffer(raw, dtype, b.count * own.atoms(v), place).reshape(b.count, -1)
                        place += b.count * width
                    n = b.count
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.frag] * n, pa.int32()), pa.array([b.mesh_class] * n), pa.array([v] * n), pa.array([state] * n, pa.int32()), pa.array(labels.astype(np.int64)), _array(rows.astype(np.float64))],
                        names=["frag", "class", "svar", "state", "label", "values"],
                    )


class FamilySource(DataSource):
    """``spark.read.format("run_family").option("path", base).option("table", …)``; options fragments and states_per_task."""

    @classmethod
    def name(cls):
        return "run_family"

    def schema(self):
        return SCHEMAS[self.options.get("table", "values")]

    def reader(self, schema):
        return FamilyReader(dict(self.options))


def read_table(spark: SparkSession, base: str, table: str = "values", wanted: list[int] | None = None) -> DataFrame:
    spark.dataSource.register(FamilySource)
    read = spark.read.format("run_family").option("path", base).option("table", table)
    return (read.option("fragments", ",".join(map(str, wanted))) if wanted else read).load()


def open_database(spark: SparkSession, base: str, procs: list[int] | None = None) -> Database:
    """The run of all fragments, or of those named; an error if their time axes differ."""
    own = [(frag, family(path)) for frag, path in fragments(base, procs)]
    first = own[0][1]
    classes: dict[str, MeshClass] = {}
    for _, f in own:
        for c in f.classes:
            if classes.setdefault(c.name, c).superclass != c.superclass:
                raise E.FragmentMismatch(f"class {c.name} has two shapes")
    if any([(s.time, s.format) for s in f.states] != [(s.time, s.format) for s in first.states] for _, f in own):
        raise E.FragmentMismatch("the fragments' time axes differ")
    known = {n: v for _, f in own for n, v in f.variables.items()}
    blocks: dict[tuple[str, str], Block] = {}
    for _, f in own:
        for formats in f.blocks.values():
            for b in formats:
                blocks.setdefault((b.name, b.mesh_class), b)
    tables = {t: read_table(spark, base, t, procs) for t in ("entities", "nodes", "elements", "values")}
    return Database(
        spark, list(classes.values()), list(known.values()), [Subrecord(b.name, b.mesh_class, b.variables, b.by_object) for b in blocks.values()], first.states, tables["entities"], tables["nodes"], tables["elements"], tables["values"],
        first.parameters, sorted({m for _, f in own for m in f.materials}), [s for _, f in own for s in f.sets], int(next((p.value for p in first.parameters if p.name == "mesh dimensions"), 3)),
    )


def reload(db: Database, base: str) -> Database:
    """The run with the states that its files have by now."""
    return open_database(db.spark, base)


def with_ranks(df: DataFrame) -> DataFrame:
    """Rows with ``label_pos``: the order of fragments, and within them of ordinals."""
    from pyspark.sql import Window

    return df.withColumn("label_pos", F.row_number().over(Window.partitionBy("class").orderBy("frag", "ordinal")) - 1)
