"""Crops, sampling and outlier filters of clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_n
from .spatial import AXES, own_search, with_kth_distance, within

# The rules of the neighbourhood filters, one place each.
#: A statistical inlier's mean distance is above 0 and below the threshold.
SOR_KEEP = "m > 0 and m < thr"
#: A radius inlier has more neighbours, itself counted, than asked for.
ROR_KEEP = "n > {min_points}"


def bounds(cloud: DataFrame) -> DataFrame:
    """One row: lo_x, hi_x, .. of a cloud."""
    return cloud.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])


def crop(cloud: DataFrame, box: DataFrame) -> DataFrame:
    """The points inside a one-row box (bounds), borders included."""
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}"))
    return cloud.join(F.broadcast(box)).where(inside).select(cloud.columns)


def padded(box: DataFrame, pad: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """The box, larger by pad on both sides of the axes named."""
    return box.withColumns({f"{n}_{a}": F.col(f"{n}_{a}") + F.lit(float(s * pad)) for a in axes for n, s in (("lo", -1), ("hi", 1))})


def scaled(box: DataFrame, factor: float) -> DataFrame:
    """The box, scaled about its centre."""
    out = {}
    for a in AXES:
        c, h = (F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2, (F.col(f"hi_{a}") - F.col(f"lo_{a}")) / 2
        out |= {f"lo_{a}": c - F.lit(float(factor)) * h, f"hi_{a}": c + F.lit(float(factor)) * h}
    return box.withColumns(out)


def select_by_index(cloud: DataFrame, ids: DataFrame) -> DataFrame:
    """The points whose pid is in ids."""
    return cloud.join(ids.select("pid").distinct(), "pid", "left_semi").select(cloud.columns)


def draw(key: str, seed: int, what: int = 0) -> Column:
    """A number of 60 bits from an MD5, the same in every engine."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:{what}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sample(cloud: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n points without replacement (all if there are no more), the
    same for any partitioning.

    The n smallest draws are asked for. A cutoff that n draws stay under but
    for one case in 10^9 thins the cloud first; what is left is sorted by
    ranges, of which only the last is cut, so no task sees all of the sample.
    """
    size = cloud.count()
    if size <= n:
        return cloud
    (name,) = [f"__draw_{seed}"]
    drawn = cloud.withColumn(name, draw("pid", seed))
    few = (n + 6 * n**0.5 + 20) / size
    if few < 1:
        thin = drawn.where(F.col(name) < F.lit(int(few * (1 << 60))))
        got = first_n(thin, [name, "pid"], n)
        if got is not None:
            return got.drop(name)
    return first_n(drawn, [name, "pid"], n).drop(name)


def statistical_outliers(cloud: DataFrame, k: int = 25, std: float = 2.0) -> DataFrame:
    """Keep points whose mean distance to the k nearest points (itself counted
    as one, at 0) is below the mean plus std sample deviations of all."""
    total = F.aggregate("near", F.lit(0.0), lambda s, x: s + F.sqrt(x))
    mean = own_search(cloud, k).select(*AXES, (total / F.size("near")).alias("m"))
    each = cloud.join(mean, list(AXES)).select(*cloud.columns, "m")
    limit = each.agg((F.avg("m") + F.lit(float(std)) * F.stddev_samp("m")).alias("thr"))
    return each.join(F.broadcast(limit)).where(SOR_KEEP).select(cloud.columns)


def knn_percentile(cloud: DataFrame, k: int = 16, pct: float = 97.0, scale: float = 1.1, z_relax: bool = False, z_split: float = 2.0, z_scale_hi: float = 1.3) -> DataFrame:
    """Keep points whose k-th neighbour is within scale times the percentile of
    that distance. With z_relax, points above z_split have a threshold of their
    own, from their own percentile times z_scale_hi."""
    dk = with_kth_distance(cloud, k)
    high = F.col("z") > F.lit(float(z_split))
    limit = dk.agg(
        (F.percentile("dk", F.lit(pct / 100.0)) * F.lit(float(scale))).alias("thr"),
        (F.percentile(F.when(high, F.col("dk")), F.lit(pct / 100.0)) * F.lit(float(scale * z_scale_hi))).alias("thr_hi"),
    )
    allowed = F.when(high, F.coalesce("thr_hi", "thr")).otherwise(F.col("thr")) if z_relax else F.col("thr")
    return dk.join(F.broadcast(limit)).where(F.col("dk") <= allowed).select(cloud.columns)


def radius_outliers(cloud: DataFrame, min_points: int = 16, radius: float = 0.20) -> DataFrame:
    """Keep points with more than min_points points, itself counted, nearer
    than radius."""
    # as many as decide are counted, not all
    near = F.filter("near", lambda d: d < radius * radius)
    count = own_search(cloud, max(min_points + 1, 1), radius).select(*AXES, F.size(near).alias("n"))
    return cloud.join(count.where(ROR_KEEP.format(min_points=min_points)), list(AXES), "left_semi").select(cloud.columns)


def filter_outliers(cloud: DataFrame, k: int = 50, std: float = 0.5, radius: float = 0.2, min_points: int = 16) -> DataFrame:
    """Statistical, then radius filter."""
    return radius_outliers(statistical_outliers(cloud, k, std), min_points, radius)


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: n_before, n_after, n_removed, pct_kept."""
    a, b = before.agg(F.count(F.lit(1)).alias("n_before")), after.agg(F.count(F.lit(1)).alias("n_after"))
    share = F.lit(100.0) * F.col("n_after") / F.greatest(F.col("n_before"), F.lit(1))
    return a.crossJoin(b).withColumns({"n_removed": F.col("n_before") - F.col("n_after"), "pct_kept": share})


def near_target(cloud: DataFrame, target: DataFrame, radius: float = 0.1) -> DataFrame:
    """Points nearer than radius to a target, cropped to its padded box first."""
    return within(crop(cloud, padded(bounds(target), radius)), target, radius)
