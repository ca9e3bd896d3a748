"""Families written here, byte by byte, and read back through the data source."""

import struct

import numpy as np
import pytest

from fieldspark.database import query
from fieldspark.functions import errors as E
from fieldspark.sources import family as B


class Writer:
    """A metadata file: payloads, names, entries of six words, the state map and four integers."""

    def __init__(self, order="<", directory=3, version=3):
        self.order, self.directory, self.version = order, directory, version
        self.body = b"mili" + bytes([version, directory, 2 if order == "<" else 1, 1, 2, 1]) + bytes(6)
        self.entries, self.names = [], b""

    def pack(self, fmt, *values):
        return struct.pack(self.order + fmt, *values)

    def add(self, kind, first, second, payload, *names):
        self.entries.append((kind, first, second, len(names), len(self.body), len(payload)))
        self.body += payload
        self.names += b"".join(n.encode() + b"\0" for n in names)

    def scalar(self, name, value, kind=5):
        if isinstance(value, str):
            self.add(kind, 1, 0, value.encode() + b"\0", name)
        elif isinstance(value, int):
            self.add(kind, 5, 0, self.pack("i", value), name)
        else:
            self.add(kind, 4, 0, self.pack("d", value), name)

    def array(self, name, values, kind=9):
        self.add(kind, 5, 2, self.pack(f"{2 + len(values)}i", 1, len(values), *values), name)

    def variables(self, ints, texts):
        letters = b"".join(t.encode() + b"\0" for t in texts)
        self.add(3, 0, 0, self.pack(f"{2 + len(ints)}i", 2 + len(ints), len(letters), *ints) + letters, "")

    def record(self, subrecords):
        ints, texts = [], []
        for name, mesh_class, own, by_object, ids in subrecords:
            ints += [int(by_object), len(own), len(ids), *[x for p in ids for x in p]]
            texts += [name, mesh_class, *own]
        letters = b"".join(t.encode() + b"\0" for t in texts)
        self.add(4, 4 + len(ints), len(letters), self.pack(f"{4 + len(ints)}i", 0, 0, 0, len(subrecords), *ints) + letters, "")

    def done(self, states, inline=True):
        word = "i" if self.directory == 2 else "q"
        entries = b"".join(self.pack(f"6{word}", *e) for e in self.entries)
        rows = b"".join(self.pack("iqfi", f, o, t, 0) for f, o, t in states)
        tail = self.pack("4i", len(self.names), 1, len(self.entries), len(states) if inline else 0)
        return self.body + self.names + entries + (rows if inline else b"") + tail, rows + b"~"


def value(frag, label, state, k):
    return float(frag * 1000 + label * 10 + state + k / 8)


def write(folder, base, frag=None, order="<", directory=3, inline=True, times=(0.5, 1.0, 2.0)):
    """Eight nodes and a brick a fragment; two states in the first state file, one in the second."""
    f = frag or 0
    w = Writer(order, directory)
    w.scalar("mesh dimensions", 3)
    w.scalar("code_name", "made here", 6)
    w.scalar("factor", 2.5, 6)
    w.scalar("factor", 3.5, 6)
    w.add(7, 0, 1, b"", "node", "Nodes")
    w.add(7, 0, 9, b"", "brick", "Bricks")
    w.add(7, 0, 11, b"", "glob", "Global")
    nodes = np.arange(24, dtype=order + "f4")
    w.add(0, 0, 0, w.pack("2i", 1, 8) + nodes.tobytes(), "node")
    w.add(1, 0, 0, w.pack("4i", 9, 1, 1, 1) + w.pack("10i", 8, 7, 6, 5, 4, 3, 2, 1, 3, 7), "brick")
    w.add(2, 0, 0, w.pack("3i", 11, 1, 1), "glob")
    w.array("Node Labels[/Mesh-0/Sname-node/Scls-M_NODE/Mat--1/]", [100 * f + i for i in range(11, 19)])
    w.array("Element Labels[/Mesh-0/Sname-brick/Scls-M_HEX/Mat--1/]", [50 + f])
    w.array("Element Labels ElemIds[/Mesh-0/Sname-brick/Scls-M_HEX/Mat--1/]", [1])
    w.scalar("MAT_NAME_3", "steel", 9)
    w.array("IntLabel_es_1", [2, 5, 2])
    # a vector of three, of which two are defined behind it; an element set of one component; doubles; a scalar of the mesh
    w.variables([1, 2, 3, 0, 2, 0, 2, 0, 2, 3, 2, 1, 2, 1, 0, 2, 0, 4, 0, 5], ["nodpos", "Position", "ux", "uy", "uz", "ux", "X", "uy", "Y", "uz", "Z", "es_1", "Set", "eps", "eps", "Strain", "sn", "Normal", "step", "Step"])
    w.record([("n", "node", ["nodpos"], False, [(1, 8)]), ("b", "brick", ["sn", "es_1"], True, [(1, 1)]), ("g", "glob", ["step"], False, [])])
    files, states = {0: b"", 1: b""}, []
    for s, t in enumerate(times, 1):
        number = 0 if s < 3 else 1
        states.append((number, len(files[number]), t))
        files[number] += w.pack("fi", t, 0)
        files[number] += b"".join(w.pack("3f", *[value(f, i, s, k) for k in range(3)]) for i in range(8))
        files[number] += w.pack("d", value(f, 7, s, 0)) + w.pack("2f", value(f, 1, s, 0), value(f, 2, s, 0)) + w.pack("i", s * 11)
    data, outside = w.done(states, inline)
    name = f"{base}{'' if frag is None else f'{frag:03d}'}"
    (folder / f"{name}A").write_bytes(data)
    if not inline:
        (folder / f"{name}T").write_bytes(outside)
    for n, raw in files.items():
        (folder / f"{name}{n:02d}").write_bytes(raw)
    return data


@pytest.mark.parametrize(("order", "directory", "inline"), [("<", 3, True), (">", 2, True), ("<", 2, False)])
def test_one_family(spark, tmp_path, order, directory, inline):
    write(tmp_path, "run", order=order, directory=directory, inline=inline)
    db = B.open_database(spark, f"{tmp_path}/run")
    assert [(s.time, s.file, s.offset > 0) for s in db.states] == [(0.5, 0, False), (1.0, 0, True), (2.0, 1, False)]
    assert db.parameter("factor") == 3.5 and db.metadata().where("field = 'code_name'").first().value == "made here" and db.mesh_dimensions() == 3
    assert [r["class"] for r in db.class_names().orderBy("place").collect()] == ["node", "brick", "glob"] and db.superclass("brick") == "HEX"
    assert [v.name for v in db.variables] == ["ux", "uy", "uz", "nodpos", "eps", "es_1", "sn", "step"] and db.atoms("es_1") == 2
    assert sorted(r.label for r in db.labels("node").collect()) == list(range(11, 19))
    (brick,) = db.connectivity("brick").collect()
    assert (brick.label, brick.nodes, brick.material, brick.part) == (50, list(range(18, 10, -1)), 3, 7)
    assert db.connectivity_ids("brick").first().ids == list(range(7, -1, -1)) and db.material_filter("steel") == [3]
    assert {r.label: (r.x, r.y, r.z) for r in db.nodes().collect()}[12] == (3, 4, 5)
    got = {(r.state, r.label): r.value for r in query(db, "uy", "node", states=[1, -1]).collect()}
    assert got == {(s, 11 + i): value(0, i, s, 1) for s in (1, 3) for i in range(8)}
    got = {(r.state, r.component): r.value for r in query(db, ["es_1", "sn"], "brick", labels=[50], material="steel").collect()}
    assert got == {(s, c): v for s in (1, 2, 3) for c, v in (("eps ipt. 2", value(0, 1, s, 0)), ("eps ipt. 5", value(0, 2, s, 0)), ("sn", value(0, 7, s, 0)))}
    assert [r.value for r in query(db, "step", "glob").orderBy("state").collect()] == [11, 22, 33]
    assert db.points_of_variable("eps", "brick") == [2, 5]


def test_fragments(spark, tmp_path):
    for f in (0, 1, 10):
        write(tmp_path, "par", frag=f)
    write(tmp_path, "parother")
    assert [f for f, _ in B.fragments(f"{tmp_path}/par")] == [0, 1, 10]
    db = B.open_database(spark, f"{tmp_path}/par")
    assert db.labels("brick").count() == 3 and query(db, "sn", "brick").count() == 9
    some = B.open_database(spark, f"{tmp_path}/par", procs=[10])
    assert [r.value for r in query(some, "sn", "brick", states=2).collect()] == [value(10, 7, 2, 0)]
    db.check_fragments(B.read_table(spark, f"{tmp_path}/par", "states"))
    assert [r.label_pos for r in B.with_ranks(db.entities.where("class = 'brick'")).orderBy("label").collect()] == [0, 1, 2]
    write(tmp_path, "par", frag=1, times=(0.5, 1.0, 2.5))
    with pytest.raises(E.FragmentMismatch):
        B.open_database(spark, f"{tmp_path}/par")
    with pytest.raises(B.FamilyError):
        B.fragments(f"{tmp_path}/nosuch")


def test_a_run_grows_and_may_have_no_states(spark, tmp_path):
    write(tmp_path, "run", times=(0.5,))
    db = B.open_database(spark, f"{tmp_path}/run")
    write(tmp_path, "run", times=(0.5, 1.0))
    assert (db.state_count(), B.reload(db, f"{tmp_path}/run").state_count()) == (1, 2)
    write(tmp_path, "new", times=(), inline=False)
    (tmp_path / "newT").unlink()
    none = B.open_database(spark, f"{tmp_path}/new")
    assert none.state_count() == 0 and none.values.count() == 0


def test_broken_bytes(tmp_path):
    good = write(tmp_path, "run")
    for data in (b"mil", b"MILI" + good[4:], good[:4] + b"\1" + good[5:], good[:5] + b"\4" + good[6:], good[:6] + b"\3" + good[7:], good[:8] + b"\0" + good[9:], good[:15] + b"\1" + good[16:], good[:16], good[:-16] + struct.pack("<4i", 10**6, 1, 3, 0), good[:-16] + struct.pack("<4i", 0, 1, 0, 0)):
        (tmp_path / "badA").write_bytes(data)
        with pytest.raises(B.FamilyError):
            B.family(f"{tmp_path}/badA")
    head = B.header(good)
    assert head.order == "<" and head.suffix == 2 and not head.by_bytes
    with pytest.raises(B.FamilyError):
        B.state_map(b"x" * 21, head)
    (tmp_path / "run00").write_bytes((tmp_path / "run00").read_bytes()[:50])
    own = B.family(f"{tmp_path}/runA")
    with pytest.raises(B.FamilyError):
        list(B.FamilyReader({"path": f"{tmp_path}/run"}).values(own, B.Part(0, f"{tmp_path}/runA", [1])))
