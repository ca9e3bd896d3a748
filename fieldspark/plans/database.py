"""Queries on whole runs: accessors, and the central select with its names, filters, derived results and reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..database import derived as D, query as select
from ..database.query import appended, filled, written
from ..sources.binding import FRAGS, days, mesh
from .registry import FIELD, query, r

#: The mesh in SQL.
NODES = """e AS (SELECT vec_id AS k, label AS g, embedding AS x FROM embeddings),
pn AS (SELECT k, g, x, CAST((k // 8) % 4 AS INTEGER) AS frag FROM e UNION ALL SELECT k, g, x, CAST((k // 8 + 1) % 4 AS INTEGER) FROM e WHERE k % 8 = 0)"""
ELEMENTS = """el AS (SELECT 'brick' AS class, k // 8 + 1 AS label, 8 AS size, CAST(arg_min(g, k) % 10 + 1 AS INTEGER) AS material, CAST((k // 8) % 4 AS INTEGER) AS frag FROM e GROUP BY k // 8 HAVING count(*) = 8
UNION ALL SELECT 'shell', k // 4 + 1, 4, CAST(arg_min(g, k) % 3 + 11 AS INTEGER), CAST((k // 4) % 4 AS INTEGER) FROM e GROUP BY k // 4 HAVING count(*) = 4),
ex AS (SELECT class, label, size, material, frag, c, (label - 1) * size + c AS node FROM (SELECT *, unnest(range(1, size + 1)) AS c FROM el))"""
S = "s AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS state)"


def _brick(start: int, size: int, name: str = "b") -> str:
    """Rows (state, label, v0...) of a brick's numbers in each state."""
    cols = ", ".join(f"CAST(e.x[state + {start + i}] AS DOUBLE) AS v{i}" for i in range(size))
    return f"{name} AS (SELECT state, el.label, el.material, {cols} FROM el JOIN e ON e.k = (el.label - 1) * 8 CROSS JOIN s WHERE el.class = 'brick')"


def _node(name: str = "n", numbers: str = "3 * state - 2") -> str:
    return f"{name} AS (SELECT state, k + 1 AS label, " + ", ".join(f"CAST(x[{numbers} + {i}] AS DOUBLE) AS {a}" for i, a in enumerate("xyz")) + " FROM e CROSS JOIN s)"


def _out(df, digits: int = 6):
    return df.select("svar", "state", "label", "component", r("value", digits).alias("value"))


def _long(table: str, svar: str, parts: list[tuple[str, str]], digits: int = 6, where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT '{svar}' AS svar, state, label, '{c}' AS component, round({x}, {digits}) + 0.0 AS value FROM {table} WHERE {where}" for c, x in parts)


# accessors


@query("""SELECT * FROM (VALUES ('metadata', 'code_name', 'field'), ('metadata', 'username', ''), ('metadata', 'job_id', ''), ('metadata', 'nprocs', '4'), ('metadata', 'date', ''), ('metadata', 'host_name', 'here'), ('metadata', 'library_version', ''),
('parameter', 'mesh dimensions', '3'), ('parameter', 'code_name', 'field'), ('parameter', 'nproc', '4'), ('parameter', 'title', 'last'), ('parameter', 'Element Set 1', '1,2,3,4,4'), ('parameter', 'host name', 'here'),
('search', 'title', 'last'), ('default', 'absent', '7'), ('dimensions', '', '3'), ('formats', '', '1'), ('states', '', '5')) t(accessor, key, value)""")
def run_metadata(spark, d):
    """The run's fields, parameters (last value at the first place), a search by prefix, a default, and counts."""
    db = mesh(spark, d)
    out = db.metadata().select(F.lit("metadata").alias("accessor"), F.col("field").alias("key"), "value")
    out = out.unionByName(db.parameters().select(F.lit("parameter").alias("accessor"), F.col("name").alias("key"), "value"))
    out = out.unionByName(db.parameter_search("ti").select(F.lit("search").alias("accessor"), F.col("name").alias("key"), "value"))
    rest = [("default", "absent", str(db.parameter("absent", 7))), ("dimensions", "", str(db.mesh_dimensions())), ("formats", "", str(db.record_formats())), ("states", "", str(db.state_count()))]
    return out.unionByName(db.frame(rest, "accessor string, key string, value string"))


@query("SELECT CAST(i AS INTEGER) AS state, i * i / 2.0 AS time, CAST((i - 1) // 2 AS INTEGER) AS file, CAST((i - 1) % 2 * 1000 AS BIGINT) AS offset, i IN (1, 4, 5) AS chosen FROM (SELECT unnest(range(1, 6)) AS i)")
def run_states(spark, d):
    """The state map, and times of states given by number and from the end."""
    db = mesh(spark, d)
    chosen = db.times([-1, 1, -2]).select("state", F.lit(True).alias("chosen"))
    return db.state_maps().join(F.broadcast(chosen), "state", "left").select("state", "time", "file", "offset", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query(f"""WITH {NODES}, {ELEMENTS}, c AS (SELECT 'node' AS class, count(*) AS n FROM e UNION ALL SELECT class, count(*) FROM el GROUP BY 1 UNION ALL VALUES ('mat', 10), ('glob', 1))
SELECT t.place, t.class, t.superclass, t.code, coalesce(c.n, 0) AS quantity, c.n IS NOT NULL AS idents FROM
(VALUES (0, 'node', 'NODE', 1), (1, 'brick', 'HEX', 9), (2, 'shell', 'QUAD', 5), (3, 'mat', 'MAT', 10), (4, 'glob', 'MESH', 11)) t(place, class, superclass, code) LEFT JOIN c ON c.class = t.class""")
def mesh_classes(spark, d):
    """Declared classes in order, with their shapes, how many labels they have, and whether they have any."""
    db = mesh(spark, d)
    out = db.class_names().join(F.broadcast(db.object_classes().drop("place")), "class")
    return out.select("place", "class", "superclass", "code", "quantity", "idents")


@query(f"""WITH {NODES}, {ELEMENTS} SELECT 'node' AS class, k + 1 AS label FROM e UNION ALL SELECT class, label FROM el UNION ALL SELECT 'mat', unnest(range(1, 11)) UNION ALL SELECT 'glob', 1""")
def class_labels(spark, d):
    """Labels of all classes, ghosts once, and those of declared ranges."""
    return mesh(spark, d).labels()


@query(f"WITH {NODES} SELECT k + 1 AS label, round(CAST(x[1] AS DOUBLE), 6) + 0.0 AS x, round(CAST(x[2] AS DOUBLE), 6) + 0.0 AS y, round(CAST(x[3] AS DOUBLE), 6) + 0.0 AS z FROM e")
def merged_nodes(spark, d):
    """Coordinates of each node, as the first fragment has them."""
    return mesh(spark, d).nodes().select("label", *[r(F.col(a).cast("double"), 6).alias(a) for a in "xyz"])


@query(f"WITH {NODES}, {ELEMENTS} SELECT class, label, material, string_agg(CAST(node AS VARCHAR), ',' ORDER BY c) AS nodes FROM ex GROUP BY 1, 2, 3")
def element_connectivity(spark, d):
    return mesh(spark, d).connectivity().select("class", "label", "material", F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("nodes"))


@query(f"""WITH {NODES}, {ELEMENTS}, o AS (SELECT frag, k + 1 AS node, k // 4 + 1 AS ordinal FROM pn)
SELECT ex.frag, class, label, material, string_agg(CAST(o.ordinal - 1 AS VARCHAR), ',' ORDER BY c) AS ids FROM ex JOIN o ON o.frag = ex.frag AND o.node = ex.node GROUP BY 1, 2, 3, 4""")
def element_connectivity_ids(spark, d):
    """Nodes by their places from 0 in the element's own fragment; nodes that it does not have are left out."""
    return mesh(spark, d).connectivity_ids().select("frag", "class", "label", "material", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))


@query(f"""WITH {NODES}, {ELEMENTS}, m AS (SELECT DISTINCT material FROM el), t AS (SELECT 'm' || (i % 3) AS name, i FROM (SELECT unnest(range(1, 14)) AS i))
SELECT 'names' AS accessor, name AS key, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS value FROM t GROUP BY name
UNION ALL SELECT 'number', CAST(material AS VARCHAR), '' FROM m
UNION ALL SELECT 'classes', 'm1', class FROM (SELECT DISTINCT class FROM el WHERE material % 3 = 1)
UNION ALL SELECT 'labels', '3', class || ':' || label FROM el WHERE material = 3
UNION ALL SELECT 'brick_labels', '12', CAST(label AS VARCHAR) FROM el WHERE material = 12 AND class = 'shell'
UNION ALL SELECT 'nodes', '12', CAST(node AS VARCHAR) FROM (SELECT DISTINCT node FROM ex WHERE material = 12)""")
def material_accessors(spark, d):
    """Materials by name and number, and their classes, labels and nodes."""
    db = mesh(spark, d)
    text = lambda c: F.col(c).cast("string")
    out = db.materials().select(F.lit("names").alias("accessor"), F.col("name").alias("key"), F.concat_ws(",", F.col("numbers").cast("array<string>")).alias("value"))
    parts = [
        db.material_numbers().select(F.lit("number"), text("material"), F.lit("")), db.material_classes("m1").select(F.lit("classes"), F.lit("m1"), "class"),
        db.labels_of_material(3).select(F.lit("labels"), F.lit("3"), F.concat("class", F.lit(":"), text("label"))), db.labels_of_material("12", "shell").select(F.lit("brick_labels"), F.lit("12"), text("label")),
        db.nodes_of_material(12).select(F.lit("nodes"), F.lit("12"), text("label")),
    ]
    for p in parts:
        out = out.union(p)
    return out


@query(f"""WITH {NODES}, {ELEMENTS} SELECT class, label, material, material AS part FROM el WHERE class = 'brick' UNION ALL SELECT 'node', k + 1, -1, -1 FROM e""")
def materials_of_classes(spark, d):
    """The material and part of each label, -1 where there is none."""
    db = mesh(spark, d)
    out = None
    for name in ("brick", "node"):
        one = db.materials_of_class(name).join(db.parts_of_class(name), "label").select(F.lit(name).alias("class"), "label", "material", "part")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT * FROM (VALUES ('set', 'es_1', '1,2,3,4'), ('set', 'es_12', '1,2'), ('points', '1', '1,2,3,4'), ('points', '2', '1,2'), ('of', 'es_1', '1,2,3,4'), ('of', 'eps', '1,2,3,4'), ('of', 'stress', '')) t(accessor, key, value)""")
def point_accessors(spark, d):
    """Element sets, the points of each material, and those of a variable on a class."""
    db = mesh(spark, d)
    sets = db.element_sets().select(F.lit("set").alias("accessor"), F.col("name").alias("key"), F.concat_ws(",", F.col("points").cast("array<string>")).alias("value"))
    points = db.integration_points().select(F.lit("points"), F.col("material").cast("string"), F.concat_ws(",", F.col("points").cast("array<string>")))
    of = db.frame([("of", n, ",".join(map(str, db.points_of_variable(n, "brick")))) for n in ("es_1", "eps", "stress")], "accessor string, key string, value string")
    return sets.union(points).union(of)


_VARIABLES = [
    ("classes", "sx", "brick"), ("classes", "nodpos", "node"), ("classes", "eps", "brick"), ("of", "shell", "grid"), ("of", "shell", "sn"), ("of", "mat", "matcg"), ("of", "mat", "matcgx"), ("of", "mat", "matcgy"), ("of", "mat", "matcgz"),
    ("containing", "sx", "stress"), ("containing", "eps", "es_1"), ("components", "nodpos", "ux,uy,uz"), ("components", "es_1", "eps,sig"), ("title", "nodpos", "Nodal Position"), ("title", "sn", "Normal Traction"),
    ("atoms", "es_1", "8"), ("atoms", "grid", "6"), ("atoms", "stress", "6"), ("atoms", "sn", "1"), ("queriable", "0", "nodpos"), ("queriable", "1", "nodpos[ux]"), ("queriable", "2", "nodpos[uy]"), ("queriable", "3", "nodpos[uz]"),
    ("vectors", "22", "es_1[0-4][eps]"), ("vectors", "23", "es_1[0-4][sig]"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _VARIABLES) + ") t(accessor, key, value)")
def variable_accessors(spark, d):
    """What the dictionary of variables says: classes, containers, components, titles, sizes and queriable names."""
    db = mesh(spark, d)
    text = lambda c: F.col(c).cast("string")
    parts = [db.classes_of_variable(n).select(F.lit("classes").alias("accessor"), F.lit(n).alias("key"), F.col("class").alias("value")) for n in ("sx", "nodpos", "eps")]
    parts += [db.variables_of_class(c).select(F.lit("of"), F.lit(c), "svar") for c in ("shell", "mat")]
    parts += [db.containing_variables(n, "brick").select(F.lit("containing"), F.lit(n), "svar") for n in ("sx", "eps")]
    parts += [db.components_of(n).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("place", "component"))), lambda x: x["component"])).alias("v")).select(F.lit("components"), F.lit(n), "v") for n in ("nodpos", "es_1")]
    parts.append(db.titles().where("svar in ('nodpos', 'sn')").select(F.lit("title"), "svar", "title"))
    parts.append(db.state_variables().where("svar in ('es_1', 'grid', 'stress', 'sn')").select(F.lit("atoms"), "svar", text("atoms")))
    parts.append(db.queriable().where("place < 4").select(F.lit("queriable"), text("place"), "name"))
    parts.append(db.queriable(vector_only=True, show_points=True).where("name like 'es_1%'").select(F.lit("vectors"), text("place"), "name"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"""WITH {NODES}, {ELEMENTS}, c AS (SELECT 'node' AS class, count(*) AS n FROM e UNION ALL SELECT class, count(*) FROM el GROUP BY 1 UNION ALL VALUES ('mat', 10)),
t AS (SELECT t.*, c.n AS entities, c.n * width AS bytes FROM (VALUES (0, 'node_rec', 'node', 36), (1, 'brick_rec', 'brick', 48), (2, 'brick_es', 'brick', 32), (3, 'shell_rec', 'shell', 28), (4, 'mat_rec', 'mat', 12)) t(place, subrecord, class, width) JOIN c ON c.class = t.class)
SELECT place, subrecord, class, entities, CAST(bytes AS BIGINT) AS bytes, CAST(coalesce(sum(bytes) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM t""")
def subrecord_offsets(spark, d):
    """Subrecords with the bytes of a state, and the bytes of those before them."""
    return mesh(spark, d).subrecord_table().select("place", "subrecord", "class", "entities", "bytes", "offset")


@query(f"""WITH {NODES}, {ELEMENTS} SELECT class, label, string_agg(CAST(node AS VARCHAR), ',' ORDER BY c) AS nodes FROM ex WHERE class = 'brick' AND label IN (1, 3) GROUP BY 1, 2
UNION ALL SELECT DISTINCT class, label, '' FROM ex WHERE node IN (5, 17)""")
def adjacency_accessors(spark, d):
    """Nodes of elements by label (absent ones dropped), and all elements, of every class, with any of some nodes."""
    db = mesh(spark, d)
    of = db.nodes_of_elements("brick", [3, 1, 99999999]).select(F.lit("brick").alias("class"), "label", F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("nodes"))
    return of.unionByName(db.elements_of_nodes([5, 17]).withColumn("nodes", F.lit("")))


_FACES = ((1, 2, 6, 5), (2, 3, 7, 6), (0, 4, 7, 3), (1, 5, 4, 0), (4, 5, 6, 7), (0, 3, 2, 1))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{','.join(str(9 + k) for k in f)}')" for i, f in enumerate(_FACES)) + ") t(face, nodes)")
def brick_faces(spark, d):
    """The six faces of the second brick, by node labels."""
    return mesh(spark, d).faces("brick", 2).select("face", F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("nodes"))


@query(f"WITH {NODES}, {ELEMENTS} SELECT k + 1 AS label FROM e EXCEPT SELECT node FROM ex")
def free_nodes(spark, d):
    """Nodes of no element, of the bundle that a viewer asks for."""
    return mesh(spark, d).bundle()["free_nodes"]


_NEEDS = {n: (x.needs, x.on, x.shapes) for n, x in D.REGISTRY.items()}
_HAVE = {"node": ("NODE", {"ux", "uy", "uz", "nodpos", "nodtang_x", "nodtang_y", "nodtang_z"}), "brick": ("HEX", {*D.STRESS, *D.STRAIN, "eps"}), "shell": ("QUAD", {"sn"}), "mat": ("MAT", {"matcgx", "matcgy", "matcgz"}), "glob": ("MESH", set())}


@query("WITH need(name, svar, host, shapes) AS (VALUES " + ", ".join(f"('{n}', '{v}', '{on or ''}', '{','.join(sh)}')" for n, (vs, on, sh) in _NEEDS.items() for v in vs) + "), have(class, shape, svar) AS (VALUES "
       + ", ".join(f"('{c}', '{s}', '{v}')" for c, (s, vs) in _HAVE.items() for v in sorted(vs) or ["-"]) + """), c AS (SELECT DISTINCT class, shape FROM have)
SELECT c.class, n.name FROM c CROSS JOIN (SELECT DISTINCT name, shapes FROM need) n WHERE (n.shapes = '' OR list_contains(string_split(n.shapes, ','), c.shape))
AND NOT EXISTS (SELECT 1 FROM need q WHERE q.name = n.name AND NOT EXISTS (SELECT 1 FROM have h WHERE h.svar = q.svar AND h.class = CASE q.host WHEN '' THEN c.class ELSE q.host END))""")  # fmt: skip
def derived_of_classes(spark, d):
    """Derived results that each class can have: none of what they need is missing (relational division)."""
    db = mesh(spark, d)
    both = {(c.name, n) for c in db.classes for n in D.of_class(db, c.name)}
    assert both == {(c, n) for n in D.REGISTRY for c in D.classes_of(db, n)} | {x for x in both if D.REGISTRY[x[1]].instead}
    return db.frame(sorted(both), "class string, name string")


# the central select


@query(f"WITH {NODES}, {ELEMENTS}, {S}, {_brick(0, 6)} " + _long("b", "sy", [("sy", "v1")]))
def query_single(spark, d):
    """One component of a vector, asked for by its own name, over all states and labels."""
    return _out(select(mesh(spark, d), "sy", "brick"))


@query(f"WITH {NODES}, {ELEMENTS}, {S}, {_brick(0, 6)}, {_brick(10, 6, 'c')}, {_brick(20, 8, 'p')} "
       + " UNION ALL ".join([_long("b", "stress", [(n, f"v{i}") for i, n in enumerate(D.STRESS)]), _long("c", "strain[ez]", [("ez", "v2")]), _long("p", "es_1", [(f"{c} ipt. {q}", f"v{(q - 1) * 2 + k}") for k, c in enumerate(("eps", "sig")) for q in (1, 4)]),
                             _long("b", "pressure", [("pressure", "-(v0 + v1 + v2) / 3")])]))
def query_many(spark, d):
    """A vector, a component, two integration points and a derived result in one scan of the values."""
    return _out(select(mesh(spark, d), ["stress", "strain[ez]", "es_1", "pressure", "stress"], "brick", points=[4, 1]))


@query(f"WITH {NODES}, {ELEMENTS}, {S}, {_brick(0, 6)} " + _long("b", "sx", [("sx", "v0")], where="state IN (2, 5) AND label <= 60 AND material = 4"))
def query_filters(spark, d):
    """Labels (absent ones dropped) and a material by its digits intersect; states count from the end as well."""
    db = mesh(spark, d)
    return _out(select(db, "sx", "brick", material="4", labels=[*range(60, 0, -1), 10**9], states=[-1, 2, 5], subrecord="brick_rec"))


@query(f"WITH {NODES}, {ELEMENTS}, {S}, g AS (SELECT state, el.label, CAST(e.x[state + 34] AS DOUBLE) AS v FROM el JOIN e ON e.k = (el.label - 1) * 4 CROSS JOIN s WHERE class = 'shell') " + _long("g", "grid[2,2]", [("grid[2,2]", "v")]))
def query_subscript(spark, d):
    return _out(select(mesh(spark, d), "grid[2,2]", "shell"))


_M = f"WITH {FIELD}, v AS (SELECT * FROM f WHERE class = 'click') "


@query(_M + " UNION ALL ".join(f"""SELECT '{m}' AS modifier, state, label, round(value, 4) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY value {o}, label) AS k FROM v) WHERE k = 1""" for m, o in (("MIN", "ASC"), ("MAX", "DESC")))
       + "".join(f" UNION ALL SELECT '{m}', state, -1, round({x}, 4) + 0.0 FROM v GROUP BY state" for m, x in (("AVERAGE", "avg(value)"), ("MEDIAN", "median(value)"), ("STDDEV", "stddev_pop(value)")))
       + "".join(f" UNION ALL SELECT '{m}', state, label, round({x}(value) OVER (PARTITION BY label ORDER BY state), 4) + 0.0 FROM v" for m, x in (("CUMMIN", "min"), ("CUMMAX", "max"))))
def query_modifiers(spark, d):
    """All seven reductions of one field."""
    db, out = days(spark, d), None
    for m in ("MIN", "MAX", "AVERAGE", "MEDIAN", "STDDEV", "CUMMIN", "CUMMAX"):
        one = select(db, "value", "click", modifier=m)
        label = F.col("label") if "label" in one.columns else F.lit(-1)
        one = one.select(F.lit(m).alias("modifier"), "state", label.cast("long").alias("label"), r("value").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


_T = "(state * state / 2.0)"


@query(f"""WITH {NODES}, {S}, {_node()}, w AS (SELECT *, CAST(q.x[1] AS DOUBLE) AS x0, CAST(q.x[2] AS DOUBLE) AS y0, {_T} AS t, lag(n.x) OVER o AS p1, lag({_T}) OVER o AS t1 FROM n JOIN e q ON q.k = n.label - 1 WINDOW o AS (PARTITION BY n.label ORDER BY state))
SELECT 'disp_y' AS svar, state, label, round(y - y0, 6) + 0.0 AS value FROM w WHERE state >= 4
UNION ALL SELECT 'disp_rad_mag_xy', state, label, round(sqrt((w.x - x0) ** 2 + (y - y0) ** 2), 6) + 0.0 FROM w WHERE state >= 4
UNION ALL SELECT 'vel_x', state, label, round(CASE WHEN state = 1 THEN 0 ELSE (w.x - p1) / (t - t1) END, 6) + 0.0 FROM w WHERE state >= 4""".replace("SELECT *, CAST", "SELECT n.state, n.label, n.x, n.y, n.z, CAST"))
def query_motion(spark, d):
    """Displacements from the first coordinates and velocities with unequal steps; the stencil reads states that are not asked for."""
    return select(mesh(spark, d), ["disp_y", "disp_rad_mag_xy", "vel_x"], "node", states=[4, 5]).select("svar", "state", "label", r("value", 6).alias("value"))


@query(f"""WITH {NODES}, {S}, {_node()}, w AS (SELECT state, label, {_T} AS t, x AS u, lag(x) OVER o AS u1, lag(x, 2) OVER o AS u2, lead(x) OVER o AS v1, lead(x, 2) OVER o AS v2,
lag({_T}) OVER o AS t1, lag({_T}, 2) OVER o AS t2, lead({_T}) OVER o AS r1, lead({_T}, 2) OVER o AS r2 FROM n WINDOW o AS (PARTITION BY label ORDER BY state))
SELECT state, label, round(CASE WHEN state = 1 THEN (v2 - 2 * v1 + u) / (0.5 * (r2 - t)) ** 2 WHEN state = 5 THEN (u - 2 * u1 + u2) / (0.5 * (t - t2)) ** 2 ELSE (v1 - 2 * u + u1) / (0.5 * (r1 - t1)) ** 2 END, 5) + 0.0 AS value FROM w WHERE state IN (1, 3, 5)""")
def query_acceleration(spark, d):
    """Second differences over unequal steps: forward, central and backward."""
    return select(mesh(spark, d), "acc_x", "node", states=[1, 3, 5]).select("state", "label", r("value", 5).alias("value"))


@query(f"""WITH {NODES}, {ELEMENTS}, {S}, {_brick(20, 8)}, l AS (SELECT state, label, p, {_T} AS t, CASE p WHEN 1 THEN v0 WHEN 2 THEN v2 WHEN 3 THEN v4 ELSE v6 END AS v FROM b CROSS JOIN (SELECT unnest(range(1, 5)) AS p)),
w AS (SELECT *, (v - lag(v) OVER o) / (t - lag(t) OVER o) AS back, (lead(v) OVER o - v) / (lead(t) OVER o - t) AS ahead FROM l WINDOW o AS (PARTITION BY label, p ORDER BY state))
SELECT state, label, 'eps ipt. ' || p AS component, round(CASE state WHEN 1 THEN 0 WHEN 5 THEN back ELSE (back + ahead) / 2 END, 6) + 0.0 AS value FROM w""")
def query_point_rates(spark, d):
    """The plastic strain's rate at each integration point."""
    db = mesh(spark, d)
    from ..operators import modifiers as M

    own = select(db, "es_1[eps]", "brick").withColumn("time", F.col("state") * F.col("state") / 2.0)
    return M.rate(own, 5, ["label", "component"], time="time").select("state", "label", "component", r("rate", 6).alias("value"))


@query("""WITH c AS (SELECT g + 1 AS label, state, avg(CAST(x[state + 1] AS DOUBLE)) AS v FROM (SELECT label AS g, embedding AS x, CAST(unnest(range(1, 6)) AS INTEGER) AS state FROM embeddings) GROUP BY 1, 2)
SELECT c.state, c.label, round(c.v - q.v, 6) + 0.0 AS value FROM c JOIN c q ON q.label = c.label AND q.state = 1""")
def query_gravity(spark, d):
    """A centre of gravity's movement, from state 1 by default."""
    return select(mesh(spark, d), "mat_cog_disp_y", "mat").select("state", "label", r("value", 6).alias("value"))


_CORNERS = f"{NODES}, {ELEMENTS}, {S}, {_node()}, p AS (SELECT n.state, ex.label, ex.c, n.x, n.y, n.z, CAST(e.x[1] AS DOUBLE) AS rx, CAST(e.x[2] AS DOUBLE) AS ry, CAST(e.x[3] AS DOUBLE) AS rz FROM ex JOIN n ON n.label = ex.node JOIN e ON e.k = ex.node - 1 WHERE ex.class = '{{}}'), q AS (SELECT state, label, " + ", ".join(f"max({v}) FILTER (WHERE c = {k + 1}) AS {v}{k}" for k in range(8) for v in ("x", "y", "z", "rx", "ry", "rz")) + " FROM p GROUP BY state, label)"


@query("WITH " + _CORNERS.format("brick") + " " + _long("q", "centroid", [(f"centroid_{a}", "(" + " + ".join(f"{a}{k}" for k in range(8)) + ") / 8") for a in "xyz"]))
def query_centroid(spark, d):
    return _out(select(mesh(spark, d), "centroid", "brick"))


def _det(rows: list[str]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = (tuple(f"{r}{x}" for x in "xyz") for r in rows)
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _jacobian(p: str) -> str:
    """Rows of the trilinear map's gradient at the middle."""
    plus = {"r": (1, 2, 5, 6), "s": (2, 3, 6, 7), "t": (4, 5, 6, 7)}
    return ", ".join(f"(" + " + ".join(f"{p}{a}{k}" for k in up) + " - " + " - ".join(f"{p}{a}{k}" for k in range(8) if k not in up) + f") / 8 AS {p}{n}{a}" for n, up in plus.items() for a in "xyz")


@query("WITH " + _CORNERS.format("brick") + f", j AS (SELECT state, label, {_jacobian('')}, {_jacobian('r')} FROM q) SELECT state, label, round({_det(['r', 's', 't'])} / {_det(['rr', 'rs', 'rt'])}, 3) + 0.0 AS value FROM j WHERE abs({_det(['rr', 'rs', 'rt'])}) > 1e-4")
def query_relative_volume(spark, d):
    """The determinant of the deformation at a brick's middle; nearly flat first shapes are left out of the comparison on both sides."""
    db = mesh(spark, d)
    from ..database.query import gathered
    from ..functions import kernels as K

    first = gathered(db, "brick", [1], lambda df: df, reference=True)
    det = K.jacobian([tuple(F.col(f"{a}r{k}") for a in "XYZ") for k in range(8)])
    solid = first.where(F.abs(det) > 1e-4).select("label")
    return select(db, "relative_volume", "brick").join(solid, "label", "left_semi").select("state", "label", r("value", 3).alias("value"))


@query("WITH " + _CORNERS.format("shell") + """, f AS (SELECT q.state, q.label, CAST(e.x[q.state + 41] AS DOUBLE) AS sn, x1 + x2 - x0 - x3 AS ux, y1 + y2 - y0 - y3 AS uy, z1 + z2 - z0 - z3 AS uz, x2 + x3 - x0 - x1 AS vx, y2 + y3 - y0 - y1 AS vy, z2 + z3 - z0 - z1 AS vz
FROM q JOIN e ON e.k = (q.label - 1) * 4) SELECT state, label, round(sn * sqrt(greatest(0, (ux * ux + uy * uy + uz * uz) * (vx * vx + vy * vy + vz * vz) - (ux * vx + uy * vy + uz * vz) ** 2) / 16), 5) + 0.0 AS value FROM f""".replace("state + 41", "state + 40"))
def query_normal_force(spark, d):
    """A shell's normal traction times its area."""
    return select(mesh(spark, d), "normal_force", "shell").select("state", "label", r("value", 5).alias("value"))


@query(f"""WITH {NODES}, {ELEMENTS}, {S}, g AS (SELECT state, el.label, CAST(e.x[state + 40] AS DOUBLE) AS v FROM el JOIN e ON e.k = (el.label - 1) * 4 CROSS JOIN s WHERE class = 'shell')
SELECT state, ex.node AS label, round(avg(v), 6) + 0.0 AS value FROM g JOIN ex ON ex.class = 'shell' AND ex.label = g.label GROUP BY 1, 2""")
def query_projected(spark, d):
    """Shell values at the nodes."""
    return select(mesh(spark, d), "sn", "shell", project="node").select("state", "label", r("value", 6).alias("value"))


@query(f"""WITH {NODES}, {ELEMENTS}, {S}, {_brick(0, 6)} SELECT state, label, round(CASE WHEN state = 2 AND label % 2 = 0 THEN label * 0.5 ELSE v1 END, 6) + 0.0 AS value FROM b""")
def query_written(spark, d):
    """Values written into a run, and read again."""
    db = mesh(spark, d)
    new = db.labels("brick").where("label % 2 = 0").select(F.lit(2).alias("state"), "label", F.lit(1).alias("place"), (F.col("label") * 0.5).alias("value"))
    return select(written(db, "stress", "brick", new), "sy", "brick").select("state", "label", r("value", 6).alias("value"))


@query(f"""WITH {NODES}, {ELEMENTS}, {S} SELECT k + 1 AS label, 6 AS state, round(CAST(x[1] AS DOUBLE), 6) + 0.0 AS value FROM e UNION ALL SELECT label, 7, 2.5 FROM el WHERE class = 'shell'""")
def query_appended(spark, d):
    """A zeroed state after the last, where positions are the first coordinates; and one filled with a constant."""
    db = appended(mesh(spark, d), 20.0, zero=True)
    first = select(db, "ux", "node", states=-1).select("label", "state", r("value", 6).alias("value"))
    more = filled(appended(db, 30.0), "sn", "shell", -1, 2.5)
    return first.unionByName(select(more, "sn", "shell", states=[7]).select("label", "state", r("value", 6).alias("value")))


@query(f"""WITH {NODES}, {ELEMENTS} SELECT frag, class, count(*) AS n FROM (SELECT frag, 'node' AS class FROM pn UNION ALL SELECT frag, class FROM el) WHERE frag IN (1, 3) GROUP BY 1, 2""")
def query_fragments(spark, d):
    """A run opened by some of its fragments."""
    db = mesh(spark, d).only_fragments([1, FRAGS - 1])
    return db.entities.groupBy("frag", "class").agg(F.count("*").alias("n"))
