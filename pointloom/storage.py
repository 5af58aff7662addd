"""Where intermediate tables of iterative operators are cut off."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def session_dir(spark: SparkSession) -> str:
    """A folder of this application's in spark.checkpoint.dir, which all
    executors share. It is deleted when the driver ends.

    Where the setting is unset a folder of our own stands in, in local mode
    only: on a cluster executors would write to disks that others don't see.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="pointloom-")
            _path(spark, where)[0].deleteOnExit(_path(spark, where)[1])
        folder = f"{where.rstrip('/')}/pointloom-{app}-{uuid.uuid4().hex[:8]}"
        fs, path = _path(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders[app] = folder
    return _folders[app]


def _path(spark: SparkSession, where: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a
    lost executor costs nothing but a reread."""
    spark = df.sparkSession
    where = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.stored_at = where
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by `stored` that nothing reads any more."""
    for df in tables:
        if df is not None and (where := getattr(df, "stored_at", None)):
            fs, path = _path(df.sparkSession, where)
            fs.delete(path, True)
