"""Aggregates: downsampling, reconstruction and depth metrics, moments."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import bounds
from .spatial import AXES, nearest, nn_truncated

DISPLAY = {
    "mae_acc": "MAE_accuracy (m)",
    "mae_com": "MAE_completeness (m)",
    "chamfer_l1": "Chamfer_L1 (m)",
    "chamfer_l2": "Chamfer_L2 (m)",
    "precision_pct": "Precision [Accuracy] (%)",
    "recall_pct": "Recall [Completeness] (%)",
    "f_score_pct": "F-score (%)",
}


def voxel_downsample(cloud: DataFrame, voxel: float) -> DataFrame:
    """One row per voxel with the mean of every numeric column but pid, which
    becomes the smallest of the voxel. The grid starts half a voxel below the
    cloud. A size of 0 or less leaves the cloud as it is."""
    if voxel <= 0:
        return cloud
    v = F.lit(float(voxel))
    key = [F.floor((F.col(a) - (F.col(f"lo_{a}") - v / 2)) / v).cast("long").alias(f"__v{a}") for a in AXES]
    numeric = [f.name for f in cloud.schema.fields if f.name != "pid" and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    celled = cloud.join(F.broadcast(bounds(cloud))).select("pid", *numeric, *key)
    return celled.groupBy("__vx", "__vy", "__vz").agg(F.min("pid").alias("pid"), *[F.avg(c).alias(c) for c in numeric]).drop("__vx", "__vy", "__vz")


def distance_metrics(pred: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """One row of metrics from distances (dist) of predicted points, those
    beyond truncation dropped, and of true points, clamped to it. NULL where a
    side is empty or precision and recall are both 0."""
    hit = lambda: F.avg(F.when(F.col("dist") < F.lit(float(threshold)), 100.0).otherwise(0.0))
    side = lambda df, n: df.agg(F.avg("dist").alias(f"m{n}"), F.avg(F.col("dist") * F.col("dist")).alias(f"s{n}"), hit().alias(f"h{n}"))
    p, r = F.col("hp"), F.col("hr")
    return side(pred, "p").crossJoin(side(truth, "r")).select(
        F.col("mp").alias("mae_acc"),
        F.col("mr").alias("mae_com"),
        (0.5 * (F.col("mp") + F.col("mr"))).alias("chamfer_l1"),
        F.sqrt(0.5 * (F.col("sp") + F.col("sr"))).alias("chamfer_l2"),
        p.alias("precision_pct"),
        r.alias("recall_pct"),
        (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f_score_pct"),
    )


def recon_metrics(pred: DataFrame, truth: DataFrame, threshold: float = 0.2, truncation_acc: float = 0.5, truncation_com: float = 0.5) -> DataFrame:
    """Accuracy, completeness, Chamfer distances, precision, recall, F-score."""
    acc = nn_truncated(truth, pred, truncation_acc)
    com = nn_truncated_distance(pred, truth, truncation_com)
    return distance_metrics(acc, com, threshold).withColumns({"threshold": F.lit(float(threshold)), "truncation_acc": F.lit(float(truncation_acc)), "truncation_com": F.lit(float(truncation_com))})


def nn_truncated_distance(reference: DataFrame, query: DataFrame, truncation: float) -> DataFrame:
    """(pid, dist) of every query point, clamped to truncation: like
    nn_truncated without the neighbour, so far points need no search."""
    some = reference.limit(1).agg(F.count(F.lit(1)).alias("__some"))
    near = nn_truncated(reference, query, truncation).select("pid", "dist")
    return query.select("pid").join(near, "pid", "left").join(F.broadcast(some)).where("__some > 0").select("pid", F.coalesce("dist", F.lit(float(truncation))).alias("dist"))


def error_distribution(pred: DataFrame, truth: DataFrame, near: float = 0.05, far: float = 0.20) -> DataFrame:
    """Shares of predicted points nearer than two distances, and the range."""
    d = nearest(pred, truth)
    share = lambda t: F.avg(F.when(F.col("dist") < F.lit(float(t)), 100.0).otherwise(0.0))
    return d.agg(share(near).alias("pct_near"), share(far).alias("pct_far"), F.min("dist").alias("min_dist"), F.median("dist").alias("median_dist"), F.max("dist").alias("max_dist"))


def depth_metrics(depth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Depth-map errors from (pred, trgt), over pixels with pred > 0 and
    0 < trgt < 10; complete is the share of all pixels with pred > 0."""
    p, t = F.col("pred"), F.col("trgt")
    ok = (p > 0) & (t > 0) & (t < 10)
    # the inner guards keep logarithms and divisions off masked rows
    ps, ts = F.when(ok, p), F.when(ok, t)
    ratio = F.greatest(ts / ps, ps / ts)
    err = F.abs(ps - ts)
    good = lambda k: F.avg(F.when(ratio < F.lit(1.25**k), 1.0).when(ok, 0.0))
    return depth.groupBy(*by).agg(
        F.avg(err / ts).alias("abs_rel"),
        F.avg(err).alias("abs_diff"),
        F.avg(err * err / ts).alias("sq_rel"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sqrt(F.avg(F.pow(F.ln(ps) - F.ln(ts), F.lit(2.0)))).alias("log_rmse"),
        good(1).alias("r1"),
        good(2).alias("r2"),
        good(3).alias("r3"),
        F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("complete"),
    )


def centroid(cloud: DataFrame, *by: str) -> DataFrame:
    return cloud.groupBy(*by).agg(*[F.avg(a).alias(f"c{a}") for a in AXES])


def xy_covariance(cloud: DataFrame) -> DataFrame:
    """One row: population covariance of x and y."""
    return cloud.agg(F.var_pop("x").alias("cxx"), F.covar_pop("x", "y").alias("cxy"), F.var_pop("y").alias("cyy"))


def yaw(cxx: float | None, cxy: float | None, cyy: float | None) -> float:
    """Direction of the dominant axis; 0 where there is none."""
    if cxx is None or not all(map(math.isfinite, (cxx, cxy, cyy))):
        return 0.0
    w, v = np.linalg.eigh([[cxx, cxy], [cxy, cyy]])
    x, y = v[:, int(np.argmax(w))]
    return math.atan2(y, x)


def runtime_summary(runs: DataFrame) -> DataFrame:
    """Mean and deviation of (method, variant, voxel_m, ms)."""
    return runs.groupBy("method", "variant", "voxel_m").agg(F.avg("ms").alias("mean_ms"), F.stddev_samp("ms").alias("sd_ms"), F.count(F.lit(1)).alias("n"))


def speedup(bench: DataFrame, base: str) -> DataFrame:
    """bench (method, variant, voxel_m, mean_ms, sd_ms) with updates per second
    and the speed-up over a base method at the same voxel size."""
    ref = bench.where(F.col("method") == base).select("voxel_m", F.col("mean_ms").alias("base_ms"))
    return bench.join(ref, "voxel_m", "left").withColumns({"per_s": 1000.0 / F.col("mean_ms"), "speedup": F.col("base_ms") / F.col("mean_ms")}).drop("base_ms")


def report(metrics: DataFrame, names: dict[str, str] = DISPLAY) -> DataFrame:
    """A one-row metrics table as rows (metric, value)."""
    cols = [c for c in metrics.columns if metrics.schema[c].dataType.typeName() == "double"]
    rows = F.array(*[F.struct(F.lit(names.get(c, c)).alias("metric"), F.col(c).alias("value")) for c in cols])
    return metrics.select(F.inline(rows))


