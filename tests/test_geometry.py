import math

import numpy as np

from pointloom.functions import geometry as g
from pyspark.sql import functions as F

from .clouds import cloud, points, random_points


def test_transform_and_inverse(spark):
    p = random_points(40)
    t = g.compose(g.rotation((1, 1, 0), 0.7), g.translation(1, 2, 3))
    got = points(g.transform(cloud(spark, p), t))
    assert np.allclose(got, p @ t[:3, :3].T + t[:3, 3])
    assert np.allclose(points(g.transform(g.transform(cloud(spark, p), t), np.linalg.inv(t))), p)


def test_rotation():
    assert np.allclose(g.rotation((0, 0, 5), math.pi / 2)[:3, :3], [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    assert np.allclose(g.rotation((1, 2, 3), 0), np.eye(4))
    assert np.isnan(g.rotation((0, 0, 0), 1)).any()


def test_composition_is_newest_left(spark):
    a, b = g.rotation((0, 0, 1), 0.3), g.translation(1, 0, 0)
    assert np.allclose(g.compose(a, b), b @ a)
    rows = [(1, [float(v) for v in b.ravel()]), (0, [float(v) for v in a.ravel()])]
    got = g.compose_rows(spark.createDataFrame(rows, "seq int, m array<double>")).first().t
    assert np.allclose(np.reshape(got, (4, 4)), b @ a)


def test_replay(spark):
    keys = spark.createDataFrame([(0, "w"), (1, "?"), (2, "J"), (3, "x"), (4, "W")], "seq int, key string")
    got = np.reshape(g.replay(keys).first().t, (4, 4))
    assert np.allclose(got, g.rotation((0, 1, 0), math.radians(1)) @ g.translation(dz=0.05))


def test_jet_ends(spark):
    df = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 0.5), (3, 1.0), (4, 9.0)], "i int, v double")
    got = [tuple(r)[1:] for r in df.select("i", *[c.alias(n) for n, c in g.jet(F.col("v")).items()]).orderBy("i").collect()]
    assert got == [(0, 0, 0.5), (0, 0, 0.5), (0.5, 1, 0.5), (0.5, 0, 0), (0.5, 0, 0)]


def test_scale_about_mean(spark):
    p = random_points(30)
    got = points(g.scale(cloud(spark, p), 0.5))
    assert np.allclose(got, p.mean(0) + 0.5 * (p - p.mean(0)))
    c = cloud(spark, p)
    assert g.scale(c, 1.0) is c


def test_voxel_index_is_clipped(spark):
    p = random_points(50)
    c = cloud(spark, p)
    dims = g.grid_dims(c, 0.3, 0.1)
    n = dims.first()
    lo = p.min(0) - 0.1
    assert (n.nx, n.ny, n.nz) == tuple(np.ceil((p.max(0) + 0.1 - lo) / 0.3).astype(int) + 1)
    got = g.voxel_index(c, dims, 0.3).toPandas().sort_values("pid")[["ix", "iy", "iz"]].to_numpy()
    assert (got == np.clip(np.floor((p - lo) / 0.3), 0, np.array([n.nx, n.ny, n.nz]) - 1)).all()


def test_intensity(spark):
    base = "pid long, x double, y double, z double"
    rows = [(0, 0.0, 0.0, 0.0, 7, 9)]
    got = g.intensity(spark.createDataFrame(rows, base + ", I int, reflectance int"))
    assert got.columns == ["pid", "x", "y", "z", "I", "reflectance", "intensity"]
    assert got.first().intensity == 9.0 and dict(got.dtypes)["intensity"] == "float"
    got = g.intensity(spark.createDataFrame([(0, 0.0, 0.0, 0.0, [3.0, 4.0])], base + ", Intensity array<double>"))
    assert got.columns == ["pid", "x", "y", "z", "intensity"] and got.first().intensity == 3.0
    got = g.intensity(spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1)], base + ", other int"))
    assert got.columns == ["pid", "x", "y", "z"]
