"""Errors, guards and edge cases of runs and their queries; kernels against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.database import Database, ElementSet, MeshClass, StateRecord, Subrecord, Variable, derived as D, query
from fieldspark.database.query import appended, written
from fieldspark.functions import errors as E, kernels as K, topology
from fieldspark.operators import modifiers as M, rollouts as R, surface as G
from fieldspark.sources.binding import mesh
from fieldspark.streaming import session as Z

CUBE = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]


@pytest.fixture(scope="module")
def db(spark, sf_dir):
    return mesh(spark, sf_dir)


@pytest.fixture(scope="module")
def cube(spark):
    """Two stacked cubes in three states of unequal times; the upper one moves up, and stretches by half in the last."""
    points = CUBE + [(x, y, 2) for x, y, _ in CUBE[:4]]
    nodes = spark.createDataFrame([(0, i + 1, i + 1, *map(float, p)) for i, p in enumerate(points)], "frag int, ordinal int, label long, x double, y double, z double")
    elements = spark.createDataFrame([(0, "hex", 1, 1, list(range(1, 9)), 1, 1), (0, "hex", 2, 2, [5, 6, 7, 8, 9, 10, 11, 12], 2, 1)], "frag int, class string, ordinal int, label long, nodes array<long>, material int, part int")
    rows = []
    for s, stretch in ((1, 0.0), (2, 0.0), (3, 0.5)):
        rows += [(0, "node", "nodpos", s, i + 1, [float(x), float(y), z * 1.0 + (stretch if z == 2 else 0.0)]) for i, (x, y, z) in enumerate(points)]
        rows += [(0, "hex", "es_1", s, e, [float(e * 10 + s + k) for k in range(4 if (s, e) != (3, 2) else 2)]) for e in (1, 2)]
    values = spark.createDataFrame(rows, "frag int, class string, svar string, state int, label long, values array<double>")
    entities = nodes.select("frag", F.lit("node").alias("class"), "ordinal", "label").unionByName(elements.select("frag", "class", "ordinal", "label"))
    variables = [Variable("nodpos", "", "VECTOR", components=("ux", "uy", "uz")), *(Variable(n) for n in ("ux", "uy", "uz")), Variable("es_1", "", "VEC_ARRAY", (2,), ("a", "b")), Variable("lone")]
    return Database(
        spark, [MeshClass("node", "", "NODE"), MeshClass("hex", "", "HEX"), MeshClass("glob", "", "MESH", ((1, 1),))], variables, [Subrecord("n", "node", ("nodpos",)), Subrecord("h", "hex", ("es_1",))],
        [StateRecord(1, 0.0), StateRecord(2, 1.0), StateRecord(3, 3.0)], entities, nodes, elements, values, element_sets_list=[ElementSet("es_1", (5, 9))],
    )


@pytest.mark.parametrize(
    ("error", "names", "mesh_class", "options"),
    [
        (E.UnknownName, "nosuch", "brick", {}), (E.UnknownClass, "sx", "nosuch", {}), (E.NoSubrecord, "sx", "shell", {}), (E.NoSubrecord, "sx", "brick", {"subrecord": "shell_rec"}), (E.LabelNotFound, "sx", "brick", {"labels": [10**9]}),
        (E.StateOutOfRange, "sx", "brick", {"states": [6]}), (E.StateOutOfRange, "sx", "brick", {"states": -6}), (E.UnknownMaterial, "sx", "brick", {"material": "wood"}), (E.UnknownMaterial, "sx", "brick", {"material": 99}),
        (E.PointOutOfRange, "es_1", "brick", {"points": [7]}), (E.InvalidSubscript, "grid[3,1]", "shell", {}), (E.InvalidSubscript, "grid[1]", "shell", {}), (E.SubscriptNotApplicable, "stress[2]", "brick", {}), (E.SubscriptNotApplicable, "sn[x]", "shell", {}),
        (E.UnknownName, "stress[nosuch]", "brick", {}), (E.Unsupported, "sx", "brick", {"modifier": "MODE"}), (E.Unsupported, "sx", "brick", {"modifier": "MAX", "project": "node"}), (E.Unsupported, "element_volume", "shell", {}),
        (E.Unsupported, "element_volume", "brick", {"reference_state": 2}), (E.Unsupported, "surfstrainx", "brick", {}), (E.Unsupported, "surfstrainx", "brick", {"face": 7}), (E.NoSubrecord, "eff_stress", "shell", {}),
    ],
)
def test_errors(db, error, names, mesh_class, options):
    with pytest.raises(error):
        query(db, names, mesh_class, **options)


def test_guard_of_updates(db):
    with pytest.raises(E.Unsupported):
        query(db, "sx", "brick", modifier="MAX", updates=db.labels())


def test_accessor_errors(db):
    for call, error in ((lambda: db.labels("x"), E.UnknownClass), (lambda: db.components_of("sn"), E.SubscriptNotApplicable), (lambda: db.faces("shell", 1), E.Unsupported), (lambda: db.nodes_of_elements("brick", [10**9]), E.LabelNotFound), (lambda: db.nodes_of_elements("glob", [1]), E.Unsupported), (lambda: D.classes_of(db, "x"), E.UnknownName), (lambda: db.times(9), E.StateOutOfRange)):
        with pytest.raises(error):
            call()
    assert db.idents_exist("glob") and db.idents_exist("brick") and not Database.idents_exist(db.only_fragments([]), "brick")


def test_fragments_must_agree(db, spark):
    good = [(f, s, s / 3) for f in (0, 1) for s in (1, 2)]
    db.check_fragments(spark.createDataFrame(good, "frag int, state int, time double"))
    for bad in ([*good[:-1], (1, 2, 2 / 3 + 1e-16)], good[:-1]):
        with pytest.raises(E.FragmentMismatch):
            db.check_fragments(spark.createDataFrame(bad, "frag int, state int, time double"))


def test_ragged_points(cube):
    with pytest.raises(E.InconsistentPoints):
        query(cube, "es_1", "hex").collect()
    got = {(r.label, r.component): r.value for r in query(cube, "es_1", "hex", states=1).collect()}
    assert got == {(e, f"{c} ipt. {p}"): e * 10.0 + 1 + 2 * i + k for e in (1, 2) for k, c in enumerate("ab") for i, p in enumerate((5, 9))}


def test_mesh_results_of_a_stretched_cube(cube):
    def one(name, **kw):
        return {(r.state, r.label): round(r.value, 9) for r in query(cube, name, "hex", **kw).collect()}

    assert one("element_volume") == {(s, e): 1.5 if (s, e) == (3, 2) else 1.0 for s in (1, 2, 3) for e in (1, 2)}
    assert one("relative_volume", states=3) == {(3, 1): 1.0, (3, 2): 1.5}
    # face 1 of the upper cube stands upright: its height grows by half of the height that it has now
    assert one("surfstrainz", states=3, face=1)[3, 2] == round(0.5 / 1.5, 9) and one("surfstrainx", states=3, face=1)[3, 2] == 0
    acc = {(r.state, r.label): r.value for r in query(cube, "acc_z", "node").collect()}
    assert all(math.isclose(acc[s, 9], 0.5 / 2.25) for s in (1, 2, 3)) and acc[2, 1] == 0
    vel = {(r.state, r.label): r.value for r in query(cube, "vel_z", "node").collect()}
    assert vel[1, 9] == 0 and vel[3, 9] == 0.25
    volume = {r.label: r.value for r in query(cube, "element_volume", "hex", states=3, project="node").collect()}
    assert volume[1] == 1 and volume[9] == 1.5 and math.isclose(volume[5], (1 + 1.5 * 1.5) / 2.5)


def test_appending(cube):
    with pytest.raises(E.Unsupported):
        appended(cube, 3.0)
    run = cube
    for t in (4.0, 5.0):
        run = appended(run, t, zero=True, states_per_file=4)
    assert [(s.state, s.file, s.offset) for s in run.states[3:]] == [(4, 0, 1), (5, 1, 0)]
    with pytest.raises(E.NoSubrecord):
        written(cube, "nodpos", "hex", run.values)


def test_extremes_with_nan(spark):
    rows = [(1, 8, 2.0), (1, 9, math.nan), (1, 7, 1.0), (1, 10, math.nan), (2, 3, 5.0), (2, 2, 5.0)]
    df = spark.createDataFrame(rows, "state int, label int, value double")
    for largest in (False, True):
        got = {r.state: (r.label, r.value) for r in M.extreme(df, largest, ["state"]).collect()}
        assert got[1][0] == 9 and math.isnan(got[1][1]) and got[2] == (2, 5.0)


def test_alternate_strain_of_nan_is_zero(spark):
    df = spark.createDataFrame([(math.nan, 1.0, 2.0, 0.1, 0.2, 0.3), (1.0, 1.0, 1.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double, e double, f double")
    for deviatoric in (False, True):
        assert all(x == 0 for r in df.select(*K.principal_alternate(*[F.col(c) for c in "abcdef"], deviatoric=deviatoric)).collect() for x in r)
    rng = np.random.default_rng(1)
    s = rng.normal(size=(50, 6))
    got = spark.createDataFrame([tuple(map(float, r)) for r in s], "a double, b double, c double, d double, e double, f double").select(*K.principal_alternate(*[F.col(c) for c in "abcdef"], deviatoric=True)).collect()
    for (x, y, z, xy, yz, zx), r in zip(s, got, strict=True):
        m = np.array([[x, xy, zx], [xy, y, yz], [zx, yz, z]])
        assert np.allclose(sorted(r), np.linalg.eigvalsh(m - np.trace(m) / 3 * np.eye(3)), atol=1e-9)


def test_shapes():
    h = topology.SHAPES["HEX"]
    assert len(h.edges) == 12 and len(h.faces) == 6 and len(h.triangles()) == 12 and h.around()[0] == [1, 3, 4]
    assert all(len(s.edges) == n for s, n in ((topology.SHAPES["TET"], 6), (topology.SHAPES["WEDGE"], 9), (topology.SHAPES["PYRAMID"], 8)))
    assert topology.shape(3).spanning == 2 and topology.shape(3).nodes == 3


def test_two_cubes_share_one_face(cube):
    own = G.shared_faces(cube.connectivity("hex").withColumn("superclass", F.lit("HEX"))).collect()
    assert sorted(r.shared for r in own) == [1] * 10 + [2] and [r.label for r in own if r.shared == 2] == [1]


def test_cut_of_a_cube(cube):
    points = cube.nodes().select(F.col("label").alias("node"), "x", "y", "z")
    faces = G.placed(G.faces(cube.connectivity("hex").withColumn("superclass", F.lit("HEX"))).select("class", "label", "part", "face"), points, "face")
    assert G.plane((0, 0, 0), (0, 0, 0)) is None
    (cap,) = G.capped(faces, G.plane((0, 0, 0.25), (0, 0, 2))).collect()
    assert (cap.label, cap.triangles, round(cap.area, 9), cap.cz) == (1, 4, 1.0, 0.25)


def rollout(calls, answers, end="ok", stop=None):
    out = []
    for i, (name, args) in enumerate(calls):
        out.append(("assistant", None, None, [(f"c{i}", name, args)]))
        if answers[i] is not None:
            out.append(("tool", answers[i], f"c{i}", None))
    if end:
        out.append(("assistant", end, None, None))
    if stop:
        out.append(("system", f"stop:{stop}", None, None))
    return out


OK = '{"ok": true, %s}'
SCHEMAS = {"load": {"root": ("string", True)}, "set_state": {"state": ("integer", True)}, "show": {"result": ("string", True)}, "select": {"class_name": ("string", True)}, "material": {}, "view": {"reset": ("boolean", False)}, "colormap": {}, "named_view": {}, "query": {}}
GRADED = [
    ("state_index", '{"state": 3}', rollout([("set_state", '{"state": "3"}')], [OK % '"state": 3']), 3, None),
    ("state_index", '{"state": 1}', rollout([("load", '{"root": "x"}')], ['{"ok": true}']), 3, None),
    ("state_index", '{"state": 3}', rollout([("set_state", '{"state": 3}')], [OK % '"state": 3'], end=None), 2, "wrong_termination"),
    ("state_index", '{"state": 3}', rollout([("set_state", '{"state": 3}')], [OK % '"state": 3'], stop="timeout"), 2, "timeout"),
    ("state_index", '{"state": 3}', rollout([("set_state", '{"state": 3}')], [OK % '"state": 3'], stop="other"), 3, None),
    ("state_index", '{"state": 3}', rollout([("set_state", '{"state": "x"}')], [OK % '"state": 3']), 0, "schema_mismatch"),
    ("state_index", '{"state": 3}', rollout([("set_state", "nope")], [OK % '"state": 3']), 0, "parse_error"),
    ("state_index", '{"state": 3}', rollout([("x", "{}"), ("set_state", "no")], [None, None]), 0, "unknown_tool"),
    ("state_index", '{"state": 3}', rollout([("set_state", '{"state": 9}')], ['{"ok": false, "error_kind": "state_out_of_range"}']), 1, "state_out_of_range"),
    ("state_index", '{"state": 3}', rollout([("set_state", '{"state": 9}'), ("show", '{"result": "q"}')], [None, '{"ok": false, "error_kind": "nonexistent_result"}']), 1, "nonexistent_result"),
    ("state_index", '{"state": 3}', [("assistant", "just text", None, None)], 0, "parse_error"),
    ("selection_set", '{"selection": {"brick": "1-3"}}', rollout([("select", '{"class_name": "brick"}')], [OK % '"selection": {"brick": "1-3", "node": ""}']), 3, None),
    ("selection_set", '{"selection": {}}', rollout([("show", '{"result": "sx"}')], ['{"ok": true}']), 3, None),
    ("selection_set", '{"selection": {"brick": "1"}}', rollout([("select", '{"class_name": "brick"}')], [OK % '"selection": {}']), 2, "wrong_selection"),
    ("active_result", '{"result": "sx"}', rollout([("show", '{"result": "sx"}')], [OK % '"result": "sx"']), 3, None),
    ("result_range", '{"range": [0, 1]}', rollout([("show", '{"result": "sx"}')], [OK % '"range": [0.0000005, 1]']), 3, None),
    ("result_range", '{"range": [0, 1]}', rollout([("show", '{"result": "sx"}')], [OK % '"range": [0.1, 1]']), 2, "wrong_range"),
    ("materials_visible", '{"hidden_materials": [2, 1]}', rollout([("material", "{}")], [OK % '"hidden_materials": [1, 2, 2]']), 3, None),
    ("materials_visible", '{"hidden_materials": []}', rollout([("material", "{}")], [OK % '"hidden_materials": [1]']), 2, "wrong_materials"),
    ("camera_named_view", '{"action": "reset"}', rollout([("view", '{"reset": true}')], ['{"ok": true}']), 3, None),
    ("camera_named_view", '{"action": "save", "name": "a"}', rollout([("named_view", '{"op": "SAVE", "name": "a"}')], ['{"ok": true}']), 3, None),
    ("camera_named_view", '{"action": "colormap", "name": "hot"}', rollout([("colormap", '{"name": "cool"}')], ['{"ok": true}']), 2, "wrong_final_state"),
    ("query_value", '{"table": {"result": "sx", "values": [1]}}', rollout([("query", "{}")], [OK % '"table": {"values": [1], "result": "sx"}']), 3, None),
    ("query_value", '{"table": {"a": 1}, "arguments": {"x": 1}}', rollout([("query", '{"x": 2}')], [OK % '"table": {"a": 1}']), 2, "wrong_final_state"),
]


def test_grades(spark):
    rows = [(i, k, e, m) for i, (k, e, m, _, _) in enumerate(GRADED)]
    df = spark.createDataFrame(rows, f"id int, kind string, expect string, messages {R.MESSAGES}")
    got = {r.id: (r.max_tier, r.failure_mode) for r in R.verified(df, SCHEMAS).collect()}
    assert got == {i: (t, f) for i, (*_, t, f) in enumerate(GRADED)}


def test_calls_key_ignores_argument_order(spark):
    rows = [(1, rollout([("a", '{"x": 1, "y": 2}')], [None])), (2, rollout([("a", '{"y": 2, "x": 1}')], [None])), (3, rollout([("a", "[1]")], [None]))]
    got = {r.id: (r.calls_key, r.messages[-1].content) for r in R.sft_record(spark.createDataFrame(rows, f"id int, messages {R.MESSAGES}")).collect()}
    assert got[1][0] == got[2][0] != got[3][0] and got[1][1] == "ok"


def test_cursor_matches_a_loop(spark):
    import random

    r = random.Random(5)
    log = [(s, i, r.choice(["next", "prev", "first", "last", "state", "show"]), r.randint(-3, 12)) for s in range(3) for i in range(3000)]
    want = {}
    for s, _, verb, n in log:
        at = want.get(s, 1)
        at = {"next": at + 1, "prev": at - 1, "first": 1, "last": 9}.get(verb, n if verb == "state" else at)
        want[s] = max(1, min(9, at))
    got = {x.session: x.cursor for x in Z.cursor(spark.createDataFrame([*log, (7, 1, "show", 1)], "session long, seq long, verb string, n long"), 9).collect()}
    assert got == want | {7: 1}


def test_camera_restores_what_was_saved(spark):
    lines = ["rot 10 5 0", "view save a", "zoom 2", "translate 1 2 3", "view restore a", "rot 1 0 0", "view restore nosuch", "view set 1 2 4", "scale 0", "view set 1 2 4 7 8 9", "zoom 4"]
    log = Z.checked(Z.parsed(spark.createDataFrame([(1, "; ".join(lines[:7])), (2, "\n".join(lines)), (3, "rot 1 1 1; close; zoom 2 # then nothing")], "session long, script string"), "session", "script"))
    got = {x.session: (x.azimuth, x.elevation, x.distance, x.fx, x.fy, x.fz) for x in Z.camera(log, "session", "place").collect()}
    assert got == {1: (11, 5, 1, 0, 0, 0), 2: (1, 2, 1, 7, 8, 9), 3: (0, 0, 0.5, 0, 0, 0)}
