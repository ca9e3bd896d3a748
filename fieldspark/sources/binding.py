"""The driver's tables as runs: a mesh of the embeddings in five states, and the events as fields over thirty days.

Mesh: a node for each embedding (its first three numbers are the coordinates); each eight nodes in a row are a brick, each
four a shell. Fragments take bricks in turn; a brick's first node is a ghost in the next fragment as well. Values of state
s come from the embedding further on. Times are s * s / 2, so the steps differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..database import Database, ElementSet, MeshClass, Parameter, StateRecord, Subrecord, Variable
from . import field, table

MESH_STATES, FRAGS, DAYS = 5, 4, 30
POINTS = (1, 2, 3, 4)
STRESS, STRAIN = ("sx", "sy", "sz", "sxy", "syz", "szx"), ("ex", "ey", "ez", "exy", "eyz", "ezx")

CLASSES = [
    MeshClass("node", "Nodes", "NODE"), MeshClass("brick", "Hexahedra", "HEX"), MeshClass("shell", "Shells", "QUAD"), MeshClass("mat", "Materials", "MAT", ((1, 10),)), MeshClass("glob", "Global", "MESH", ((1, 1),)),
]
VARIABLES = [
    Variable("nodpos", "Nodal Position", "VECTOR", components=("ux", "uy", "uz"), type="double"),
    *(Variable(n, f"{n[-1].upper()} Position", type="double") for n in ("ux", "uy", "uz")),
    Variable("nodtang", "Nodal Tangential Traction", "VECTOR", components=("nodtang_x", "nodtang_y", "nodtang_z")),
    *(Variable(f"nodtang_{a}", f"{a.upper()} Tangential Traction") for a in "xyz"),
    Variable("stress", "Stress", "VECTOR", components=STRESS),
    *(Variable(n, f"Stress {n[1:].upper()}") for n in STRESS),
    Variable("strain", "Strain", "VECTOR", components=STRAIN),
    *(Variable(n, f"Strain {n[1:].upper()}") for n in STRAIN),
    Variable("es_1", "Element Set 1", "VEC_ARRAY", (4,), ("eps", "sig")),
    Variable("eps", "Effective Plastic Strain"),
    Variable("sig", "Signal"),
    Variable("grid", "Grid", "ARRAY", (2, 3)),
    Variable("sn", "Normal Traction"),
    Variable("matcg", "Material Center of Gravity", "VECTOR", components=("matcgx", "matcgy", "matcgz")),
    *(Variable(f"matcg{a}", f"{a.upper()} Center of Gravity") for a in "xyz"),
]
SUBRECORDS = [
    Subrecord("node_rec", "node", ("nodpos", "nodtang")), Subrecord("brick_rec", "brick", ("stress", "strain"), True), Subrecord("brick_es", "brick", ("es_1",)),
    Subrecord("shell_rec", "shell", ("grid", "sn")), Subrecord("mat_rec", "mat", ("matcg",)),
]
PARAMETERS = [
    Parameter("mesh dimensions", 3, "RUN"), Parameter("code_name", "field"), Parameter("nproc", FRAGS), Parameter("title", "first"), Parameter("Element Set 1", (1, 2, 3, 4, 4), "TI"), Parameter("title", "last"), Parameter("host name", "here"),
]
STATES = [StateRecord(s, s * s / 2.0, (s - 1) // 2, (s - 1) % 2 * 1000) for s in range(1, MESH_STATES + 1)]


def _part(start: str, size: int) -> Column:
    return F.expr(f"slice(embedding, {start}, {size})").cast("array<double>")


def mesh(spark: SparkSession, sf_dir: str) -> Database:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("label").alias("group"), "embedding")
    home = (F.expr("k div 8") % FRAGS).cast("int")
    frag = F.explode(F.when(F.col("k") % 8 == 0, F.array(home, (home + 1) % FRAGS)).otherwise(F.array(home)))
    placed = e.withColumn("frag", frag)
    label = (F.col("k") + 1).alias("label")
    nodes = placed.select("frag", F.expr("k div 4 + 1").cast("int").alias("ordinal"), label, *[F.col("embedding")[i].alias(a) for i, a in enumerate("xyz")])
    full = {}
    for name, size, shift in (("brick", 8, 1), ("shell", 4, 11)):
        whole = e.groupBy(F.expr(f"k div {size}").alias("b")).agg(F.count("*").alias("n"), F.min(F.struct("k", "group")).alias("first")).where(F.col("n") == size)
        material = (F.col("first.group") % (10 if name == "brick" else 3) + shift).cast("int")
        corners = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.col("b") * size + i)
        full[name] = whole.select((F.col("b") % FRAGS).cast("int").alias("frag"), F.lit(name).alias("class"), F.expr(f"b div {FRAGS} + 1").cast("int").alias("ordinal"), (F.col("b") + 1).alias("label"), corners.alias("nodes"), material.alias("material"), material.alias("part"))
    elements = full["brick"].unionByName(full["shell"])
    entities = nodes.select("frag", F.lit("node").alias("class"), "ordinal", "label").unionByName(elements.select("frag", "class", "ordinal", "label"))

    def over(df: DataFrame, name: str, svar: str, own: Column, label: Column) -> DataFrame:
        states = df.withColumn("state", F.explode(F.sequence(F.lit(1), F.lit(MESH_STATES))))
        return states.select("frag", F.lit(name).alias("class"), F.lit(svar).alias("svar"), "state", label.cast("long").alias("label"), own.alias("values"))

    def firsts(size: int) -> DataFrame:
        """The embedding of each whole element's first node."""
        own = e.where(F.col("k") % size == 0)
        name = "brick" if size == 8 else "shell"
        return own.join(full[name].select((F.col("label") * size - size).alias("k"), "frag"), "k")

    bricks, shells = firsts(8), firsts(4)
    groups = e.withColumn("state", F.explode(F.sequence(F.lit(1), F.lit(MESH_STATES)))).groupBy("group", "state").agg(*[F.avg(F.element_at("embedding", F.col("state") + i).cast("double")).alias(f"c{i}") for i in range(3)])
    values = over(placed, "node", "nodpos", _part("3 * state - 2", 3), F.col("k") + 1)
    values = values.unionByName(over(placed, "node", "nodtang", _part("state + 15", 3), F.col("k") + 1))
    b = F.expr("k div 8 + 1")
    for svar, start, size in (("stress", "state", 6), ("strain", "state + 10", 6), ("es_1", "state + 20", 8)):
        values = values.unionByName(over(bricks, "brick", svar, _part(start, size), b))
    s = F.expr("k div 4 + 1")
    for svar, start, size in (("grid", "state + 30", 6), ("sn", "state + 40", 1)):
        values = values.unionByName(over(shells, "shell", svar, _part(start, size), s))
    mats = groups.select(F.lit(0).alias("frag"), F.lit("mat").alias("class"), F.lit("matcg").alias("svar"), "state", (F.col("group") + 1).cast("long").alias("label"), F.array("c0", "c1", "c2").alias("values"))
    return Database(
        spark, CLASSES, VARIABLES, SUBRECORDS, STATES, entities, nodes, elements, values.unionByName(mats), PARAMETERS, [(f"m{n % 3}", n) for n in range(1, 14)], [ElementSet("es_1", POINTS), ElementSet("es_12", (1, 2))],
    )


def days(spark: SparkSession, sf_dir: str) -> Database:
    """Events: a class for each type, users as labels, days as states, and two variables: the sum, and the vector (sum, half)."""
    kinds = ("click", "error", "purchase", "signup", "view")
    cells = field(spark, sf_dir).withColumn("frag", F.lit(0)).withColumn("label", F.col("label").cast("long"))
    values = cells.select("frag", "class", F.lit("value").alias("svar"), "state", "label", F.array("value").alias("values"))
    values = values.unionByName(cells.select("frag", "class", F.lit("pair").alias("svar"), "state", "label", F.array(F.col("value"), F.col("value") / 2).alias("values")))
    entities = cells.select("frag", "class", F.col("label").cast("int").alias("ordinal"), "label").distinct()
    none = table(spark, sf_dir, "embeddings").where("false")
    nodes = none.select(F.lit(0).alias("frag"), F.lit(0).alias("ordinal"), F.col("vec_id").alias("label"), *[F.lit(0.0).alias(a) for a in "xyz"])
    elements = none.select(F.lit(0).alias("frag"), F.lit("").alias("class"), F.lit(0).alias("ordinal"), F.col("vec_id").alias("label"), F.array("vec_id").alias("nodes"), F.lit(0).alias("material"), F.lit(0).alias("part"))
    variables = [Variable("value", "Sum", type="double"), Variable("pair", "Sum and half", "VECTOR", components=("whole", "half"), type="double"), Variable("whole"), Variable("half")]
    return Database(spark, [MeshClass(k, k.title(), "UNIT") for k in kinds], variables, [Subrecord(f"{k}_rec", k, ("value", "pair")) for k in kinds], [StateRecord(s, float(s)) for s in range(1, DAYS + 1)], entities, nodes, elements, values)
