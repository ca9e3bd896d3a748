"""Queries on stress and strain: invariants, principal values, magnitudes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources import vectors
from .registry import query, r, vector_sql

_S = vector_sql(K.STRESS)
_E = vector_sql(K.STRAIN, 7)
_ROOTS = """p AS (SELECT *, sqrt(((sx - q) ** 2 + (sy - q) ** 2 + (sz - q) ** 2 + 2 * (sxy ** 2 + syz ** 2 + szx ** 2)) / 6) AS p FROM (SELECT *, (sx + sy + sz) / 3 AS q FROM s)),
t AS (SELECT *, acos(greatest(-1.0, least(1.0, ((sx - q) * ((sy - q) * (sz - q) - syz ** 2) - sxy * (sxy * (sz - q) - syz * szx) + szx * (sxy * syz - (sy - q) * szx)) / (2 * p ** 3)))) / 3 AS a FROM p),
e AS (SELECT vec_id, q, q + 2 * p * cos(a) AS e1, q + 2 * p * cos(a + 2 * pi() / 3) AS e3 FROM t)"""
_ROOTS_E = _ROOTS.replace("szx", "ezx").replace("syz", "eyz").replace("sxy", "exy").replace("sx", "ex").replace("sy", "ey").replace("sz", "ez")
_J2 = "s AS (SELECT *, (sx + sy + sz) / 3 AS m FROM ({}) x), j AS (SELECT *, ((sx - m) ** 2 + (sy - m) ** 2 + (sz - m) ** 2) / 2 + sxy ** 2 + syz ** 2 + szx ** 2 AS j2 FROM s)".format(_S)


def _stress(spark, d):
    return vectors(spark, d, K.STRESS), [F.col(c) for c in K.STRESS]


def _strain(spark, d):
    return vectors(spark, d, K.STRAIN, 7), [F.col(c) for c in K.STRAIN]


@query(f"SELECT vec_id, round(-(sx + sy + sz) / 3, 6) + 0.0 AS pressure FROM ({_S})")
def pressure(spark, d):
    df, s = _stress(spark, d)
    return df.select("vec_id", r(K.pressure(*s[:3]), 6).alias("pressure"))


@query(f"WITH {_J2} SELECT vec_id, round(sqrt(3 * j2), 6) + 0.0 AS eff_stress FROM j")
def eff_stress(spark, d):
    df, s = _stress(spark, d)
    return df.select("vec_id", r(K.effective(*s), 6).alias("eff_stress"))


@query(f"WITH {_J2} SELECT vec_id, round(m / sqrt(3 * j2), 5) + 0.0 AS triaxiality FROM j")
def triaxiality(spark, d):
    df, s = _stress(spark, d)
    return df.select("vec_id", r(K.triaxiality(*s), 5).alias("triaxiality"))


@query(f"WITH {_J2} SELECT vec_id, round(-m / sqrt(3 * j2), 5) + 0.0 AS norm_press FROM j")
def norm_press(spark, d):
    df, s = _stress(spark, d)
    return df.select("vec_id", r(K.normalized_pressure(*s), 5).alias("norm_press"))


@query(f"WITH s AS ({_S}), {_ROOTS} SELECT vec_id, round(e1, 5) + 0.0 AS prin1, round(3 * q - e1 - e3, 5) + 0.0 AS prin2, round(e3, 5) + 0.0 AS prin3 FROM e")
def prin_stress(spark, d):
    df, s = _stress(spark, d)
    return df.select("vec_id", *[r(e, 5).alias(f"prin{i + 1}") for i, e in enumerate(K.principal(*s))])


@query(f"WITH s AS ({_S}), {_ROOTS} SELECT vec_id, round(e1 - q, 5) + 0.0 AS prin1, round(2 * q - e1 - e3, 5) + 0.0 AS prin2, round(e3 - q, 5) + 0.0 AS prin3 FROM e")
def prin_dev_stress(spark, d):
    df, s = _stress(spark, d)
    return df.select("vec_id", *[r(e, 5).alias(f"prin{i + 1}") for i, e in enumerate(K.principal_deviatoric(*s))])


@query(f"WITH s AS ({_S}), {_ROOTS} SELECT vec_id, round((e1 - e3) / 2, 5) + 0.0 AS max_shear FROM e")
def max_shear(spark, d):
    df, s = _stress(spark, d)
    return df.select("vec_id", r(K.max_shear(*s), 5).alias("max_shear"))


@query(f"SELECT vec_id, round(ex + ey + ez, 6) + 0.0 AS vol_strain FROM ({_E})")
def vol_strain(spark, d):
    df, e = _strain(spark, d)
    return df.select("vec_id", r(e[0] + e[1] + e[2], 6).alias("vol_strain"))


@query(f"WITH s AS ({_E}), {_ROOTS_E} SELECT vec_id, round(e1, 5) + 0.0 AS prin1, round(3 * q - e1 - e3, 5) + 0.0 AS prin2, round(e3, 5) + 0.0 AS prin3 FROM e")
def prin_strain(spark, d):
    df, e = _strain(spark, d)
    return df.select("vec_id", *[r(x, 5).alias(f"prin{i + 1}") for i, x in enumerate(K.principal(*e))])


@query(f"WITH s AS ({_E}), {_ROOTS_E} SELECT vec_id, round(e1 - q, 5) + 0.0 AS prin1, round(2 * q - e1 - e3, 5) + 0.0 AS prin2, round(e3 - q, 5) + 0.0 AS prin3 FROM e")
def prin_dev_strain(spark, d):
    df, e = _strain(spark, d)
    return df.select("vec_id", *[r(x, 5).alias(f"prin{i + 1}") for i, x in enumerate(K.principal_deviatoric(*e))])


@query(f"""WITH s AS ({_E}), h AS (SELECT *, (ex + ey + ez) / 3 AS h FROM s), i AS (SELECT *, ((ex - h) ** 2 + (ey - h) ** 2 + (ez - h) ** 2) / 2 + exy ** 2 + eyz ** 2 + ezx ** 2 AS j2,
(ex - h) * ((ey - h) * (ez - h) - eyz ** 2) - exy * (exy * (ez - h) - eyz * ezx) + ezx * (exy * eyz - (ey - h) * ezx) AS j3 FROM h),
a AS (SELECT vec_id, h, j2, acos(greatest(-1.0, least(1.0, -0.5 * sqrt(27 / j2) * j3 / j2))) / 3 AS t FROM i)
SELECT vec_id, round(CASE WHEN j2 < 1e-12 THEN 0 ELSE h - 2 * sqrt(j2 / 3) * cos(t + 2 * pi() / 3) END, 5) + 0.0 AS prin1,
round(CASE WHEN j2 < 1e-12 THEN 0 ELSE h - 2 * sqrt(j2 / 3) * cos(t - 2 * pi() / 3) END, 5) + 0.0 AS prin2,
round(CASE WHEN j2 < 1e-12 THEN 0 ELSE h - 2 * sqrt(j2 / 3) * cos(t) END, 5) + 0.0 AS prin3 FROM a""")
def prin_strain_alt(spark, d):
    df, e = _strain(spark, d)
    return df.select("vec_id", *[r(x, 5).alias(f"prin{i + 1}") for i, x in enumerate(K.principal_alternate(*e))])


@query("SELECT vec_id, round(sqrt(CAST(embedding[1] AS DOUBLE) ** 2 + CAST(embedding[2] AS DOUBLE) ** 2), 6) + 0.0 AS shear_magnitude FROM embeddings")
def shear_magnitude(spark, d):
    df = vectors(spark, d, ("qxx", "qyy"))
    return df.select("vec_id", r(K.magnitude(F.col("qxx"), F.col("qyy")), 6).alias("shear_magnitude"))


@query("SELECT vec_id, round(sqrt(CAST(embedding[1] AS DOUBLE) ** 2 + CAST(embedding[2] AS DOUBLE) ** 2 + CAST(embedding[3] AS DOUBLE) ** 2), 6) + 0.0 AS nodtangmag FROM embeddings")
def nodtangmag(spark, d):
    df = vectors(spark, d, ("x", "y", "z"))
    return df.select("vec_id", r(K.magnitude(F.col("x"), F.col("y"), F.col("z")), 6).alias("nodtangmag"))
