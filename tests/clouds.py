"""Small clouds for tests."""

import numpy as np
import pandas as pd

POINT = "pid bigint, x double, y double, z double"


def random_points(n, seed=0, clumps=False):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 3))
    if clumps:
        p = p * 0.05 + rng.integers(0, 3, (n, 1)) * 2.0
    return p


def cloud(spark, points, first=0):
    points = np.asarray(points, float).reshape(-1, 3)
    if not len(points):
        return spark.createDataFrame([], POINT)
    return spark.createDataFrame(pd.DataFrame({"pid": np.arange(first, first + len(points)), "x": points[:, 0], "y": points[:, 1], "z": points[:, 2]}), POINT)


def points(df):
    out = df.select("pid", "x", "y", "z").toPandas().sort_values("pid")
    return out[["x", "y", "z"]].to_numpy()


def pids(df):
    return sorted(r.pid for r in df.select("pid").collect())


def distances(a, b):
    return np.sqrt(((np.asarray(a)[:, None] - np.asarray(b)[None]) ** 2).sum(-1))
