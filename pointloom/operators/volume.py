"""Voxel grids: occupancy, distance transforms, signed distance, surfaces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import grid_dims, voxel_index
from ..storage import stored
from .ranking import numbered

INDEX = ("ix", "iy", "iz")
MIN_POINTS = 50


def occupancy(cloud: DataFrame, voxel: float, margin: float) -> DataFrame:
    """Distinct occupied cells (ix, iy, iz)."""
    return voxel_index(cloud, grid_dims(cloud, voxel, margin), voxel).select(*INDEX).distinct()


def dense(occupied: DataFrame, dims: DataFrame) -> DataFrame:
    """Every cell of the grid: (ix, iy, iz, occ)."""
    row = dims.first()
    spark = occupied.sparkSession
    cells = spark.range(row.nx * row.ny * row.nz).select(
        (F.col("id") / (row.ny * row.nz)).cast("int").alias("ix"),
        (F.pmod((F.col("id") / row.nz).cast("long"), F.lit(row.ny))).cast("int").alias("iy"),
        F.pmod("id", F.lit(row.nz)).cast("int").alias("iz"),
    )
    return cells.join(occupied.withColumn("occ", F.lit(True)), list(INDEX), "left").withColumn("occ", F.coalesce("occ", F.lit(False)))


def _line_pass(grid: DataFrame, axis: str, value: str) -> DataFrame:
    """D(q) = min over p of (q - p)^2 + f(p), along one axis."""
    others = [i for i in INDEX if i != axis]

    def run(line: pd.DataFrame) -> pd.DataFrame:
        p, f = line[axis].to_numpy(float), line[value].to_numpy(float)
        out = np.empty(len(p))
        for a in range(0, len(p), 1024):
            out[a : a + 1024] = ((p[a : a + 1024, None] - p[None]) ** 2 + f[None]).min(1)
        return line.assign(**{value: out})

    return grid.groupBy(*others).applyInPandas(run, grid.schema)


def distance_transform(grid: DataFrame, voxel: float, seeds: str = "occ") -> DataFrame:
    """grid with `dist`: Euclidean distance of each cell to the nearest cell
    where `seeds` holds, exactly, by one pass per axis; infinite where there is
    none."""
    squared = grid.withColumn("dist", F.when(F.expr(seeds), 0.0).otherwise(F.lit(float("inf"))))
    for axis in INDEX:
        squared = _line_pass(squared, axis, "dist")
    return squared.withColumn("dist", F.sqrt("dist") * F.lit(float(voxel)))


def signed_distance(grid: DataFrame, voxel: float) -> DataFrame:
    """grid with `sdf`: distance to the occupied cells outside, minus the
    distance to the empty ones inside."""
    out = distance_transform(grid, voxel, "occ").withColumnRenamed("dist", "sdf")
    inside = distance_transform(grid, voxel, "not occ").select(*INDEX, "dist")
    return out.join(inside, list(INDEX)).withColumn("sdf", F.col("sdf") - F.col("dist")).drop("dist")


def gaussian(grid: DataFrame, sigma: float, value: str = "sdf", radius: float = 4.0) -> DataFrame:
    """Smooth a dense grid by a Gaussian of sigma cells, cut at `radius`
    sigmas, mirrored at the borders. 0 leaves it as it is."""
    if sigma <= 0:
        return grid
    reach = int(radius * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    def along(axis: str):
        def run(line: pd.DataFrame) -> pd.DataFrame:
            line = line.sort_values(axis, ignore_index=True)
            v = np.pad(line[value].to_numpy(float), reach, "symmetric")
            return line.assign(**{value: np.convolve(v, k, "valid")})

        return run

    out = grid
    for axis in INDEX:
        out = out.groupBy(*[i for i in INDEX if i != axis]).applyInPandas(along(axis), out.schema)
    return out


def boundary_midpoints(occupied: DataFrame, dims: DataFrame) -> DataFrame:
    """(ix, iy, iz, axis, dir): occupied cells and the faces to empty cells of
    the grid. At zero smoothing these are the surface's vertices on edges."""
    steps = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(d).alias("dir")) for a in range(3) for d in (-1, 1)])
    n = occupied.join(F.broadcast(dims.select("nx", "ny", "nz"))).select(*INDEX, "nx", "ny", "nz", F.explode(steps).alias("s"))
    for a, i in enumerate(INDEX):
        n = n.withColumn(f"n{i}", F.col(i) + F.when(F.col("s.axis") == a, F.col("s.dir")).otherwise(0))
    inside = n.where(" and ".join(f"ni{a} >= 0 and ni{a} < n{a}" for a in "xyz"))
    full = occupied.select(*[F.col(i).alias(f"n{i}") for i in INDEX])
    return inside.join(full, [f"n{i}" for i in INDEX], "left_anti").select(*INDEX, "s.axis", "s.dir")


#: Corner k of a cube is at (k & 1, k >> 1 & 1, k >> 2 & 1).
EDGES = [(a, b) for a in range(8) for b in range(a + 1, 8) if bin(a ^ b).count("1") == 1]
_EDGE = {e: i for i, e in enumerate(EDGES)}


def _faces() -> list[list[int]]:
    """Corner cycles of the six sides, counter-clockwise seen from outside."""
    out = []
    for axis in range(3):
        u, v = (axis + 1) % 3, (axis + 2) % 3
        ring = [0, 1 << u, (1 << u) | (1 << v), 1 << v]
        out.append([k | (1 << axis) for k in ring])
        out.append(ring[::-1])
    return out


def _case(inside: int) -> list[tuple[int, int, int]]:
    """Triangles of edges for a set of inside corners. On every side each run
    of inside corners is cut off by a segment of its own, so neighbouring cubes
    agree on shared sides and the surface is closed; the segments are linked to
    loops and these cut into fans."""
    follow: dict[int, int] = {}
    for ring in _faces():
        sign = [inside >> k & 1 for k in ring]
        for i in range(4):
            if sign[i] and not sign[i - 1]:
                j = i
                while sign[(j + 1) % 4]:
                    j += 1
                enter = _EDGE[tuple(sorted((ring[i - 1], ring[i])))]
                leave = _EDGE[tuple(sorted((ring[j % 4], ring[(j + 1) % 4])))]
                follow[enter] = leave
    tris, todo = [], set(follow)
    while todo:
        start = min(todo)
        loop, e = [], start
        while e in todo:
            todo.remove(e)
            loop.append(e)
            e = follow[e]
        tris += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
    return tris


def cases() -> list[list[tuple[int, int, int]]]:
    return [_case(k) for k in range(256)]


def case_rows() -> list[tuple[int, int, int, int, int]]:
    """(mask, triangle, corner, edge's first cube corner, its axis) of every case."""
    out = []
    for mask, tris in enumerate(cases()):
        for t, tri in enumerate(tris):
            for corner, e in enumerate(tri):
                a, b = EDGES[e]
                out.append((mask, t, corner, a, (a ^ b).bit_length() - 1))
    return out


def _packed(x: Column, y: Column, z: Column) -> Column:
    """Three indices below 2^20 in one number."""
    return F.shiftleft(x.cast("long"), 40) + F.shiftleft(y.cast("long"), 20) + z


def _soup(cubes: DataFrame, share: Column, voxel: float, origin: tuple[float, float, float], step: int, cell_center: bool) -> DataFrame:
    """Triangle corners of cubes (ix, iy, iz, mask, ..). `share` is where the
    surface crosses an edge from cube corner `a` along `axis`. The table of
    cases is a few thousand rows at any size of the grid."""
    table = cubes.sparkSession.createDataFrame(case_rows(), "mask int, t int, corner int, a int, axis int")
    base = [F.col(i) + F.shiftright("a", k).bitwiseAND(1) for k, i in enumerate(INDEX)]
    shift = 0.5 if cell_center else 0.0
    at = [F.lit(float(o)) + (b + F.when(F.col("axis") == k, share).otherwise(0.0) + shift) * (voxel * step) for k, (o, b) in enumerate(zip(origin, base))]
    rows = cubes.join(F.broadcast(table), "mask")
    return rows.select((_packed(*map(F.col, INDEX)) * 8 + F.col("t")).alias("tid"), "corner", (_packed(*base) * 3 + F.col("axis")).alias("edge"), *[p.alias(n) for p, n in zip(at, "xyz")])


def surface(grid: DataFrame, voxel: float, origin: tuple[float, float, float], level: float = 0.0, value: str = "sdf", step: int = 1, cell_center: bool = False, slope: float | None = None) -> DataFrame:
    """Triangles of the level set of a dense grid: (tid, corner, edge, x, y, z),
    three rows a triangle; `edge` names the grid edge a corner lies on, so equal
    edges are one vertex. Only cubes with corners on both sides are built.
    Samples lie at the cells' lower corners unless cell_center.

    With `slope`, the most that the value changes over a length of one (2 for a
    signed distance), cells too far from the level for their cubes to reach it
    are left out before anything is shuffled.
    """
    kept = grid.where(" and ".join(f"{i} % {step} = 0" for i in INDEX)) if step > 1 else grid
    if slope is not None:
        kept = kept.where(F.abs(F.col(value) - F.lit(level)) <= slope * 3**0.5 * voxel * step * (1 + 1e-9))
    low = kept.select(*[(F.col(i) / step).cast("int").alias(i) for i in INDEX], F.col(value).alias("v"))
    offset = F.array(*[F.struct(*[F.lit(k >> a & 1).alias(f"d{a}") for a in range(3)], F.lit(k).alias("k")) for k in range(8)])
    spread = low.select(*INDEX, "v", F.explode(offset).alias("o"))
    cube = spread.select(*[(F.col(i) - F.col(f"o.d{a}")).alias(i) for a, i in enumerate(INDEX)], "v", F.col("o.k").alias("k"))
    whole = cube.groupBy(*INDEX).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.array_sort(F.collect_list(F.struct("k", "v"))).alias("c"))
    mixed = whole.where((F.col("n") == 8) & (F.col("lo") < level) & (F.col("hi") >= level)).select(*INDEX, F.col("c.v").alias("c"))
    mask = sum((F.when(F.col("c")[k] < level, 1 << k).otherwise(0) for k in range(8)), F.lit(0))
    first, second = F.element_at("c", F.col("a") + 1), F.element_at("c", F.col("a") + F.pow(F.lit(2), F.col("axis")).cast("int") + 1)
    return _soup(mixed.withColumn("mask", mask), (F.lit(level) - first) / (second - first), voxel, origin, step, cell_center)


def occupancy_surface(occupied: DataFrame, dims: DataFrame, voxel: float, cell_center: bool = False) -> DataFrame:
    """The zero level of the signed distance of occupied cells, unsmoothed,
    without a dense grid: across a side between an occupied and an empty cell
    the distance goes from minus to plus one cell, so the surface crosses in
    the middle. Only cubes at occupied cells are built; their cases are the
    union of their cells' bits."""
    d = dims.first()
    offset = F.array(*[F.struct(*[F.lit(k >> a & 1).alias(f"d{a}") for a in range(3)], F.lit(1 << k).alias("bit")) for k in range(8)])
    cube = occupied.select(*INDEX, F.explode(offset).alias("o")).select(*[(F.col(i) - F.col(f"o.d{a}")).alias(i) for a, i in enumerate(INDEX)], F.col("o.bit").alias("bit"))
    inside = cube.where(" and ".join(f"{i} >= 0 and {i} < {n - 1}" for i, n in zip(INDEX, (d.nx, d.ny, d.nz))))
    cubes = inside.groupBy(*INDEX).agg(F.bit_or("bit").alias("mask")).where("mask < 255")
    return _soup(cubes, F.lit(0.5), voxel, (d.ox, d.oy, d.oz), 1, cell_center)


def mesh_of(soup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and faces (fid, i0, i1, i2) of a surface."""
    soup = stored(soup, "soup")
    ids, tids = numbered(soup, "edge", "vid"), numbered(soup, "tid", "fid")
    vertices = soup.groupBy("edge").agg(*[F.min(a).alias(a) for a in "xyz"]).join(ids, "edge").select("vid", "x", "y", "z")
    corner = lambda k: F.max(F.when(F.col("corner") == k, F.col("vid"))).alias(f"i{k}")
    faces = soup.join(ids, "edge").groupBy("tid").agg(*[corner(k) for k in range(3)]).join(tids, "tid").select("fid", "i0", "i1", "i2")
    return vertices, faces
