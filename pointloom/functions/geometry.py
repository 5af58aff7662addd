"""Scalar geometry: rigid transforms, rotations, scaling, colours, voxels.

Clouds are DataFrames with columns pid, x, y, z; other columns pass through.
Transforms are 4x4 arrays applied from the left.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def transform(cloud: DataFrame, t: np.ndarray) -> DataFrame:
    """p' = R p + t."""
    t = np.asarray(t, float)
    return cloud.withColumns({a: sum((F.lit(float(t[i, j])) * F.col(b) for j, b in enumerate(AXES)), F.lit(float(t[i, 3]))) for i, a in enumerate(AXES)})


def compose(*steps: np.ndarray) -> np.ndarray:
    """The transform that applies steps in order: the newest is on the left."""
    return reduce(lambda total, step: np.asarray(step, float) @ total, steps, np.eye(4))


def rotation(axis: tuple[float, float, float], angle: float) -> np.ndarray:
    """Rotation about an axis through the origin (Rodrigues); the axis is
    normalised, a zero axis gives NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        x, y, z = np.asarray(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    out = np.eye(4)
    out[:3, :3] += math.sin(angle) * k + (1 - math.cos(angle)) * k @ k
    return out


def translation(dx: float = 0.0, dy: float = 0.0, dz: float = 0.0) -> np.ndarray:
    out = np.eye(4)
    out[:3, 3] = dx, dy, dz
    return out


STEP, TURN = 0.05, math.radians(1)
#: Pose-tool keys: moves along and turns about the axes.
KEYS = {
    "W": translation(dz=STEP),
    "S": translation(dz=-STEP),
    "A": translation(dx=-STEP),
    "D": translation(dx=STEP),
    "Q": translation(dy=STEP),
    "E": translation(dy=-STEP),
    "J": rotation((0, 1, 0), TURN),
    "L": rotation((0, 1, 0), -TURN),
    "I": rotation((1, 0, 0), TURN),
    "K": rotation((1, 0, 0), -TURN),
    "U": rotation((0, 0, 1), TURN),
    "O": rotation((0, 0, 1), -TURN),
}


def flat(t: np.ndarray) -> Column:
    """A 4x4 transform as an array column, by rows."""
    return F.array(*[F.lit(float(v)) for v in np.asarray(t, float).ravel()])


def _matmul(a: Column, b: Column) -> Column:
    return F.array(*[sum((a[4 * i + k] * b[4 * k + j] for k in range(4)), F.lit(0.0)) for i in range(4) for j in range(4)])


def compose_rows(steps: DataFrame, *keys: str) -> DataFrame:
    """(keys, t): the ordered product of rows (keys, seq, m), newest on the left."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "m")))
    return steps.groupBy(*keys).agg(F.aggregate(ordered, flat(np.eye(4)), lambda acc, s: _matmul(s["m"], acc)).alias("t"))


def replay(keys: DataFrame) -> DataFrame:
    """The pose (one row, t) after pressing keys (seq, key); other keys do
    nothing, X ends the session, case does not matter."""
    end = keys.where(F.upper("key") == "X").agg(F.min("seq").alias("end"))
    table = F.create_map(*[x for k, m in KEYS.items() for x in (F.lit(k), flat(m))])
    pressed = keys.join(F.broadcast(end)).where(F.col("end").isNull() | (F.col("seq") < F.col("end"))).withColumn("m", table[F.upper("key")]).where("m is not null")
    return compose_rows(pressed.select("seq", "m"))


def scale(vertices: DataFrame, factor: float) -> DataFrame:
    """Scale about the mean of the vertices; 1 leaves them as they are."""
    if factor == 1.0:
        return vertices
    centre = vertices.agg(*[F.avg(a).alias(f"__c{a}") for a in AXES])
    return vertices.join(F.broadcast(centre)).withColumns({a: F.col(f"__c{a}") + F.lit(float(factor)) * (F.col(a) - F.col(f"__c{a}")) for a in AXES}).drop(*[f"__c{a}" for a in AXES])


def clip(c: Column, low: float | Column, high: float | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(c, lit(low)), lit(high))


def jet(value: Column) -> dict[str, Column]:
    """Red, green and blue of a value in [0, 1] on the jet map."""
    v = clip(value, 0.0, 1.0)
    return {c: clip(F.lit(1.5) - F.abs(4 * v - F.lit(float(k))), 0.0, 1.0) for c, k in (("r", 3), ("g", 2), ("b", 1))}


def error_colours(cloud: DataFrame, dist: str = "dist", vmax: float = 0.20) -> DataFrame:
    """Colour points by their error, saturated at vmax."""
    return cloud.withColumns(jet(clip(F.col(dist) / F.lit(vmax), 0.0, 1.0)))


def paint(cloud: DataFrame, r: float, g: float, b: float) -> DataFrame:
    return cloud.withColumns({"r": F.lit(float(r)), "g": F.lit(float(g)), "b": F.lit(float(b))})


def grid_dims(cloud: DataFrame, voxel: float, margin: float) -> DataFrame:
    """One row: origin ox, oy, oz and numbers of cells nx, ny, nz."""
    low_high = cloud.agg(*[f(a).alias(f"__{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    out = {f"o{a}": F.col(f"__lo{a}") - F.lit(float(margin)) for a in AXES}
    for a in AXES:
        out[f"n{a}"] = (F.ceil(((F.col(f"__hi{a}") + F.lit(float(margin))) - (F.col(f"__lo{a}") - F.lit(float(margin)))) / F.lit(float(voxel))) + 1).cast("int")
    return low_high.select(*[c.alias(n) for n, c in out.items()])


def voxel_index(cloud: DataFrame, dims: DataFrame, voxel: float) -> DataFrame:
    """cloud with ix, iy, iz: cells of a grid (grid_dims), clipped to it."""
    cells = {f"i{a}": clip(F.floor((F.col(a) - F.col(f"o{a}")) / F.lit(float(voxel))).cast("int"), F.lit(0), F.col(f"n{a}") - 1) for a in AXES}
    return cloud.join(F.broadcast(dims)).withColumns(cells).drop(*[f"{p}{a}" for a in AXES for p in "on"])


#: Names an intensity may go by, in order of preference.
INTENSITY = ("intensity", "intensities", "Intensity", "reflectance", "scalar_Intensity", "ScalarField", "I")


def intensity(cloud: DataFrame, names: tuple[str, ...] = INTENSITY) -> DataFrame:
    """Add `intensity` (float) from the first attribute of `names` present
    (case-sensitive); of several channels the first. The original stays unless
    its name differs by case only. Without any, only coordinates remain."""
    found = next((n for n in names if n in cloud.columns), None)
    if found is None:
        return cloud.select(*[c for c in ("pid", *AXES) if c in cloud.columns])
    at = cloud.columns.index(found)
    unique = [f"__{i}" for i in range(len(cloud.columns))]
    plain = cloud.toDF(*unique)
    source = F.col(unique[at])
    if cloud.schema.fields[at].dataType.typeName() == "array":
        source = source[0]
    keep = [(u, n) for u, n in zip(unique, cloud.columns) if n.lower() != "intensity"]
    return plain.select(*[F.col(u).alias(n) for u, n in keep], source.cast("float").alias("intensity"))
