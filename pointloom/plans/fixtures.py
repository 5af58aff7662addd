"""Clouds, meshes and depth maps taken from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLOUD_SQL = "cloud AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label, embedding FROM embeddings), gt AS (SELECT * FROM cloud WHERE pid % 2 = 0), pred AS (SELECT * FROM cloud WHERE pid % 2 = 1)"


def cloud(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """pid, x, y, z from the first components of the embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("pid"), *at, *extra)


def truth(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return cloud(spark, sf_dir, *extra).where("pid % 2 = 0")


def predicted(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return cloud(spark, sf_dir, *extra).where("pid % 2 = 1")


def large_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud of line items: quantity, price and ship date, about a cube of
    50. Ids are digests of the item's keys, the same in every engine."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    return li.select(
        F.conv(F.substring(keys, 1, 15), 16, 10).cast("long").alias("pid"),
        F.col("l_quantity").cast("double").alias("x"),
        (F.col("l_extendedprice") / 2000.0).alias("y"),
        (day / F.lit(50.0)).alias("z"),
    )


LARGE_SQL = "big AS (SELECT ('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15))::BIGINT AS pid, l_quantity::DOUBLE AS x, l_extendedprice / 2000.0 AS y, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) / 50.0 AS z FROM lineitem)"


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select((F.col("l_discount") * 100.0).alias("pred"), (F.col("l_quantity") / 4.0).alias("trgt"))


DEPTH_SQL = "depth AS (SELECT l_discount * 100.0 AS pred, l_quantity / 4.0 AS trgt FROM lineitem)"


def mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Disjoint triangles of three points each in order of pid."""
    c = cloud(spark, sf_dir)
    vertices = c.withColumnRenamed("pid", "vid")
    whole = c.agg((F.floor((F.max("pid") + 1) / 3)).alias("n"))
    faces = whole.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("fid")).select(F.col("fid").cast("long"), *[(F.col("fid") * 3 + i).cast("long").alias(f"i{i}") for i in range(3)])
    return vertices, faces


MESH_SQL = CLOUD_SQL + ", vertices AS (SELECT pid AS vid, x, y, z FROM cloud), faces AS (SELECT k AS fid, 3 * k AS i0, 3 * k + 1 AS i1, 3 * k + 2 AS i2 FROM range((SELECT (max(pid) + 1) // 3 FROM cloud)) t(k))"


def dirty_mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A mesh on a coarse lattice, so that vertices, faces and edges repeat."""
    c = cloud(spark, sf_dir)
    vertices = c.select(F.col("pid").alias("vid"), *[F.round(a, 1).alias(a) for a in "xyz"])
    n = c.count()
    faces = c.select(F.col("pid").alias("fid"), *[F.pmod(F.col("pid") * m + k, F.lit(n)).alias(f"i{i}") for i, (m, k) in enumerate(((1, 0), (3, 1), (7, 2)))])
    return vertices, faces


DIRTY_SQL = CLOUD_SQL + ", vertices AS (SELECT pid AS vid, round(x, 1) AS x, round(y, 1) AS y, round(z, 1) AS z FROM cloud), faces AS (SELECT pid AS fid, pid % n AS i0, (pid * 3 + 1) % n AS i1, (pid * 7 + 2) % n AS i2 FROM cloud, (SELECT count(*) AS n FROM cloud))"

#: Published update times of mapping methods: (method, variant, voxel_m, mean_ms, sd_ms).
BENCH = [
    ("field method", "", 0.30, 187.0, 34.0),
    ("field method", "", 0.20, 317.0, 65.0),
    ("field method", "", 0.10, 656.0, 132.0),
    ("grid method", "no downsample", 0.30, 137.8, 20.6),
    ("grid method", "no downsample", 0.20, 138.4, 12.7),
    ("grid method", "no downsample", 0.10, 140.8, 8.6),
    ("grid method", "no downsample", 0.05, 154.7, 16.9),
    ("grid method", "DS=2", 0.30, 66.8, 7.2),
    ("grid method", "DS=2", 0.20, 67.7, 7.4),
    ("grid method", "DS=2", 0.10, 70.0, 6.2),
    ("grid method", "DS=2", 0.05, 91.1, 5.9),
]


def bench(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BENCH, "method string, variant string, voxel_m double, mean_ms double, sd_ms double")
