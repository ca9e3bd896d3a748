"""Kernels against NumPy, names, and streams against batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import kernels as K
from fieldspark.functions.names import QueryError, parse_name, ranges, ravel, states
from fieldspark.streaming import session, windows


def test_principal_values_match_numpy(spark):
    rng = np.random.default_rng(5)
    t = np.concatenate([rng.normal(size=(200, 6)), [[0] * 6, [2, 2, 2, 0, 0, 0], [1, 0, 0, 0, 0, 0], [0, 0, 0, 1, 0, 0]]])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(t)], "i int, " + ", ".join(f"{c} double" for c in K.STRESS))
    s = [F.col(c) for c in K.STRESS]
    got = df.select("i", *[e.alias(f"e{k}") for k, e in enumerate(K.principal(*s))], K.effective(*s).alias("vm")).orderBy("i").collect()
    for r, x in zip(got, t, strict=True):
        m = np.array([[x[0], x[3], x[5]], [x[3], x[1], x[4]], [x[5], x[4], x[2]]])
        own = np.sort(np.linalg.eigvalsh(m))[::-1]
        assert np.allclose([r.e0, r.e1, r.e2], own, atol=1e-7)
        assert np.isclose(r.vm, np.sqrt(((own[0] - own[1]) ** 2 + (own[1] - own[2]) ** 2 + (own[2] - own[0]) ** 2) / 2), atol=1e-7)


def test_alternate_principal_values_agree(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0, 0.3, -0.2, 0.7)], ", ".join(f"{c} double" for c in K.STRAIN))
    e = [F.col(c) for c in K.STRAIN]
    a = df.select(*K.principal(*e)).first()
    b = df.select(*K.principal_alternate(*e)).first()
    assert np.allclose(a, b)


def test_volumes_of_known_cells(spark):
    cube = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    sheared = [(x + 0.4 * z, y, 2 * z) for x, y, z in cube]
    one = spark.range(1)
    lit = lambda ps: [tuple(F.lit(float(c)) for c in p) for p in ps]
    r = one.select(K.hex_volume(lit(cube)).alias("a"), K.hex_volume(lit(sheared)).alias("b"), K.jacobian(lit(cube)).alias("j"), K.tet_volume(lit([cube[0], cube[1], cube[3], cube[4]])).alias("t"), K.quad_area(lit(cube[:4])).alias("q")).first()
    assert np.allclose([r.a, r.b, r.j, r.t, r.q], [1, 2, 1 / 8, 1 / 6, 1])


def test_division_follows_ieee(spark):
    r = spark.range(1).select(K.divide(F.lit(1.0), F.lit(0.0)).alias("a"), K.divide(F.lit(-1.0), F.lit(0.0)).alias("b"), K.divide(F.lit(0.0), F.lit(0.0)).alias("c")).first()
    assert r.a == np.inf and r.b == -np.inf and np.isnan(r.c)


def test_names():
    assert parse_name("v[2, 3]").subscript == (2, 3) and parse_name("v[sx]").component == "sx" and parse_name("x").base == "x"
    assert ravel((2, 3), (4, 16)) == 18
    assert states([-1, 1, 1], 30) == [1, 30] and states(None, 3) == [1, 2, 3]
    assert ranges("1-3, 9") == [(1, 3), (9, 9)]
    for bad in ("v[", "1x", "v[a,1]"):
        with pytest.raises(QueryError):
            parse_name(bad)
    with pytest.raises(QueryError):
        states([31], 30)
    with pytest.raises(QueryError):
        ravel((5, 1), (4, 16))


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "6 hours", ["event_type"], "value")
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    own = {(r.start, r.event_type): r.n for r in windows.tumbling(e, "6 hours", ["event_type"], "value").collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("tumbled").collect()} == own


def test_cursor_clamps_at_each_step(spark):
    log = spark.createDataFrame([(1, 1, "prev", 0), (1, 2, "next", 0), (1, 3, "state", 99), (1, 4, "prev", 0), (2, 1, "last", 0)], "session long, seq long, verb string, n long")
    assert {r.session: r.cursor for r in session.cursor(log, 10).collect()} == {1: 9, 2: 10}
