"""Triangle meshes: cleaning, areas, normals and surface sampling.

A mesh is two DataFrames: vertices (vid, x, y, z) and faces (fid, i0, i1, i2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import draw

AXES = ("x", "y", "z")
CORNERS = ("i0", "i1", "i2")


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces with corner structs a, b, c; faces with a missing vertex drop out."""
    out = faces
    for i, name in zip(CORNERS, "abc"):
        v = vertices.select(F.col("vid").alias(i), F.struct(*AXES).alias(name))
        out = out.join(v, i)
    return out


def cross(a: str = "a", b: str = "b", c: str = "c") -> list[Column]:
    """(b - a) x (c - a)."""
    u = [F.col(f"{b}.{k}") - F.col(f"{a}.{k}") for k in AXES]
    v = [F.col(f"{c}.{k}") - F.col(f"{a}.{k}") for k in AXES]
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def face_area() -> Column:
    return 0.5 * F.sqrt(sum((k * k for k in cross()), F.lit(0.0)))


def surface_area(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: area."""
    return triangles(vertices, faces).agg(F.sum(face_area()).alias("area"))


def sample_budget(area: DataFrame, voxel: float, density: float = 10.0, low: int = 100_000, high: int = 8_000_000) -> DataFrame:
    """One row n: samples for an area at a resolution, within limits."""
    wanted = F.col("area") / F.lit(float(voxel * voxel)) * F.lit(float(density))
    return area.select(F.least(F.greatest(wanted, F.lit(float(low))), F.lit(float(high))).cast("long").alias("n"))


def merge_vertices(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices with equal coordinates become the one with the smallest id."""
    first = vertices.groupBy(*AXES).agg(F.min("vid").alias("keep"))
    at = first.withColumnsRenamed({a: f"__{a}" for a in AXES})
    remap = vertices.join(at, [F.col(a).eqNullSafe(F.col(f"__{a}")) for a in AXES]).select(F.col("vid").alias("old"), "keep")
    out = faces
    for i in CORNERS:
        out = out.join(remap.withColumnRenamed("old", i), i).drop(i).withColumnRenamed("keep", i)
    return first.select(F.col("keep").alias("vid"), *AXES), out.select(faces.columns)


def rotated(i: str = "i") -> list[Column]:
    """Corners rotated so that the smallest comes first; the orientation stays."""
    a, b, c = (F.col(k) for k in CORNERS)
    first = lambda x, y, z: F.when((a <= b) & (a <= c), x).when((b <= a) & (b <= c), y).otherwise(z)
    return [first(a, b, c).alias("r0"), first(b, c, a).alias("r1"), first(c, a, b).alias("r2")]


def drop_duplicate_faces(faces: DataFrame) -> DataFrame:
    """Faces equal up to a rotation of their corners: the smallest fid stays."""
    keyed = faces.select("*", *rotated())
    keep = keyed.groupBy("r0", "r1", "r2").agg(F.min("fid").alias("fid"))
    return faces.join(keep.select("fid"), "fid", "left_semi").select(faces.columns)


def drop_degenerate_faces(faces: DataFrame) -> DataFrame:
    """Faces with two equal corners go."""
    return faces.where("i0 <> i1 and i1 <> i2 and i0 <> i2")


def drop_nonmanifold_faces(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Of the faces at an edge the two largest stay; areas equal to 12 places
    are ties, which go to the smallest fid."""
    sized = triangles(vertices, faces).select("fid", *CORNERS, face_area().alias("area"))
    edge = lambda i, j: F.struct(F.least(i, j).alias("u"), F.greatest(i, j).alias("v"))
    edges = sized.select("fid", "area", F.explode(F.array(edge("i0", "i1"), edge("i1", "i2"), edge("i2", "i0"))).alias("e"))
    at = Window.partitionBy("e").orderBy(F.round("area", 12).desc(), "fid")
    gone = edges.withColumn("k", F.row_number().over(at)).where("k > 2").select("fid").distinct()
    return faces.join(gone, "fid", "left_anti").select(faces.columns)


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vertices with nx, ny, nz: the normalised sum of the normals of their
    faces; NULL for vertices without faces or with a zero sum."""
    unit = triangles(vertices, faces).select(*CORNERS, *[n.alias(f"n{a}") for n, a in zip(cross(), AXES)])
    length = F.sqrt(sum((F.col(f"n{a}") * F.col(f"n{a}") for a in AXES), F.lit(0.0)))
    face = unit.select(F.explode(F.array(*CORNERS)).alias("vid"), *[(F.col(f"n{a}") / F.nullif(length, F.lit(0.0))).alias(f"n{a}") for a in AXES])
    total = face.groupBy("vid").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in AXES])
    return vertices.join(total.select("vid", *[(F.col(f"n{a}") / F.nullif(length, F.lit(0.0))).alias(f"n{a}") for a in AXES]), "vid", "left")


def clean(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Duplicate vertices and faces, degenerate faces and non-manifold edges go."""
    vertices, faces = merge_vertices(vertices, faces)
    faces = drop_degenerate_faces(drop_duplicate_faces(faces))
    return vertices, drop_nonmanifold_faces(vertices, faces)


#: Blocks of faces whose running sums of area are made apart.
BLOCKS = 4096


def sample_surface(vertices: DataFrame, faces: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n points (pid, x, y, z, fid), uniform over the surface; none for
    a mesh without area. Each face gets the whole points between the rounded
    running shares of area. Running sums go by blocks of faces (of fid): only
    one small row per block, BLOCKS at most, meets in one task."""
    sized = triangles(vertices, faces).select("fid", "a", "b", "c", face_area().alias("area")).withColumn("block", F.pmod("fid", F.lit(BLOCKS)))
    block = sized.groupBy("block").agg(F.sum("area").alias("whole"))
    order = Window.orderBy("block")
    before = block.select("block", (F.sum("whole").over(order) - F.col("whole")).alias("start"), F.sum("whole").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("block").orderBy("fid")
    run = sized.join(F.broadcast(before), "block").withColumn("upto", F.col("start") + F.sum("area").over(inside))
    # the last running share of a block is the next block's start, whatever the rounding
    last = F.row_number().over(Window.partitionBy("block").orderBy(F.col("fid").desc())) == 1
    nxt = before.select("block", F.lead("start", 1).over(order).alias("next"))
    run = run.join(F.broadcast(nxt), "block").withColumn("hi", F.when(last, F.coalesce("next", "total")).otherwise(F.col("upto"))).withColumn("lo", F.coalesce(F.lag("upto").over(inside), "start"))
    share = lambda c: F.round(F.lit(float(n)) * F.col(c) / F.col("total")).cast("long")
    counted = run.where("total > 0").withColumns({"k0": share("lo"), "k1": share("hi")}).where("k1 > k0")
    point = counted.select("fid", "a", "b", "c", F.explode(F.sequence(F.col("k0"), F.col("k1") - 1)).alias("pid"))
    uniform = lambda s: (draw("pid", seed, s) + F.lit(0.5)) / F.lit(float(1 << 60))
    r, q = F.sqrt(uniform(1)), uniform(2)
    return point.select("pid", *[((1 - r) * F.col(f"a.{k}") + r * (1 - q) * F.col(f"b.{k}") + r * q * F.col(f"c.{k}")).alias(k) for k in AXES], "fid")
