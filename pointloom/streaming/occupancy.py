"""Occupied cells of a cloud that arrives in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_cells(points: DataFrame, voxel: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(ix, iy, iz): each cell once, when a point first falls into it, on a
    grid fixed beforehand. Works on batch and streaming frames; the state is
    one entry per occupied cell."""
    cells = [F.floor((F.col(a) - F.lit(float(o))) / F.lit(float(voxel))).cast("int").alias(f"i{a}") for a, o in zip("xyz", origin)]
    return points.select(*cells).dropDuplicates()
