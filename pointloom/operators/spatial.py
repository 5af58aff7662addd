"""Spatial joins of clouds on a lattice.

A distance predicate alone plans as a nested loop over all pairs. Here space is
covered by blocks of 2 x 2 x 2 cells, one around every lattice corner. A point
that asks belongs to the block of its nearest corner, which reaches at least
half its width to all sides; a point that may answer is copied to the eight
blocks its cell is part of. The join is an equality of corners with the squared
distance as a residual. All answers of a point meet in one block, so whatever
is computed for each asking point - the nearest, a count, the k best - needs no
shuffle beyond that of the join, and pairs never travel. The copied side's size
is not seen by the planner, so these joins ask for a sort-merge join instead of
being broadcast by mistake.

Neighbour searches work on sites: points at one place are one row with their
number and first ids, and asking points at one place ask once. They start at
cells that hold about two neighbourhoods. Sites with fewer than k points inside
their block's reach go on with larger blocks, by what they have found, until
they have them or, if the search has a radius, reach it. So a radius that holds
many points costs no more than the points asked for. Rounds after the first copy
only what the blocks still asked for can hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, stored

AXES = ("x", "y", "z")
CORNER = ("vx", "vy", "vz")
#: Guards block borders against rounding.
SLACK = 1 + 1e-9


def d2(a: str = "a", b: str = "b") -> Column:
    """Squared distance of columns a_x.. and b_x.."""
    return sum(((F.col(f"{a}_{c}") - F.col(f"{b}_{c}")) * (F.col(f"{a}_{c}") - F.col(f"{b}_{c}")) for c in AXES), F.lit(0.0))


def asking(cloud: DataFrame, prefix: str, size: Column) -> DataFrame:
    """Columns prefix_pid, prefix_x, .., the nearest lattice corner, and any
    other columns of cloud."""
    at = {n: F.floor(F.col(c) / size + 0.5).cast("long") for n, c in zip(CORNER, AXES)}
    return cloud.withColumns(at).withColumnsRenamed({c: f"{prefix}_{c}" for c in ("pid", *AXES)})


def answering(cloud: DataFrame, prefix: str, size: Column) -> DataFrame:
    """Columns as of `asking`, one copy for each of the eight corners of the
    point's cell."""
    at = {n: F.floor(F.col(c) / size).cast("long") for n, c in zip(CORNER, AXES)}
    points = cloud.withColumns(at).withColumnsRenamed({c: f"{prefix}_{c}" for c in ("pid", *AXES)})
    for n in CORNER:
        points = points.withColumn(n, F.explode(F.array(F.col(n), F.col(n) + 1)))
    return points


def _near(radius: float) -> Column:
    return d2() < radius * radius


def _width(radius: float) -> Column:
    """Blocks of this cell size reach `radius` around each of their points."""
    return F.lit(2.0 * radius * SLACK)


#: Grouping keys of pairs by asking point that need no shuffle of their own.
PER_POINT = (*CORNER, "a_pid")


def nearest_within(query: DataFrame, target: DataFrame, radius: float) -> DataFrame:
    """(pid, nid, d2): the nearest target nearer than radius of each query
    point that has one; ties go to the smallest nid."""
    best = search(stored(places(query), "asked"), stored(sites(target, 1), "sites"), 1, radius)
    best = best.select(*AXES, F.col("near")[0].alias("best")).where(F.col("best.d2") < radius * radius)
    return query.select("pid", *AXES).join(best, list(AXES)).select("pid", F.col("best.nid").alias("nid"), F.col("best.d2").alias("d2"))


def nn_truncated(reference: DataFrame, query: DataFrame, truncation: float, ignore_outlier: bool = True) -> DataFrame:
    """(pid, nid, dist): nearest reference point of each query point. Points
    with none nearer than truncation are dropped, or kept at the truncation
    distance with their nearest neighbour of any distance if ignore_outlier is
    false. An empty side gives no rows."""
    if ignore_outlier:
        return nearest_within(query, reference, truncation).select("pid", "nid", F.sqrt("d2").alias("dist"))
    near = nearest_within(query, reference, truncation)
    far = query.join(near, "pid", "left_anti")
    rest = nearest(far, reference).select("pid", "nid", F.lit(float(truncation)).alias("dist"))
    return near.select("pid", "nid", F.sqrt("d2").alias("dist")).union(rest)


def within(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """The points with another cloud's point nearer than radius: one semi-join
    that carries the points' columns along."""
    whole = points.select("pid", *AXES, F.struct(*points.columns).alias("a_row"))
    a, b = asking(whole, "a", _width(radius)), answering(others.select("pid", *AXES), "b", _width(radius)).hint("merge")
    same = [a[n] == b[n] for n in CORNER]
    near = sum(((a[f"a_{c}"] - b[f"b_{c}"]) * (a[f"a_{c}"] - b[f"b_{c}"]) for c in AXES), F.lit(0.0)) < radius * radius
    return a.join(b, [*same, near], "left_semi").select("a_row.*")


def within_all(points: DataFrame, clouds: DataFrame, radius: float, by: str = "cloud_id") -> DataFrame:
    """The points with a point nearer than radius in every cloud of `clouds`
    (told apart by a column): one join and a count of distinct clouds."""
    a = asking(points.select("pid", *AXES), "a", _width(radius))
    b = answering(clouds.select("pid", *AXES, F.col(by).alias("__cloud")), "b", _width(radius))
    met = a.join(b.hint("merge"), list(CORNER)).where(_near(radius)).groupBy(*PER_POINT).agg(F.countDistinct("__cloud").alias("met"))
    every = clouds.agg(F.countDistinct(by).alias("every"))
    hit = met.join(F.broadcast(every)).where("met = every").select(F.col("a_pid").alias("pid"))
    return points.join(hit, "pid", "left_semi").select(points.columns)


def places(cloud: DataFrame) -> DataFrame:
    """The distinct places of a cloud; rows without finite coordinates have none."""
    return cloud.where(_finite()).select(*AXES).distinct()


def _finite() -> Column:
    # NaN is above infinity
    return F.greatest(*[F.abs(c) for c in AXES]) < float("inf")


def sites(cloud: DataFrame, k: int, ids: bool = True) -> DataFrame:
    """(x, y, z, n, id, ids): the places of a cloud with their number of points
    (k stands for more), their smallest pid and, if asked for, the k smallest."""
    cloud = cloud.where(_finite()).select("pid", *AXES)
    if ids and k > 1:
        first = cloud.withColumn("rank", F.row_number().over(Window.partitionBy(*AXES).orderBy("pid"))).where(F.col("rank") <= k)
        some = first.groupBy(*AXES).agg(F.sort_array(F.collect_list("pid")).alias("ids"))
        return some.select(*AXES, F.size("ids").alias("n"), F.col("ids")[0].alias("id"), "ids")
    each = cloud.groupBy(*AXES).agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"), F.min("pid").alias("id"))
    return each.withColumn("ids", F.array("id")) if ids else each


def _cell(target: DataFrame, k: float, n: int, diagonal: float) -> float:
    """A cell size at which occupied cells hold about 2 k sites on average.
    Cells are counted with one sketch for each halving of the diagonal, from
    the first that can have as many cells, in batches until they are that many;
    between two halvings the size is interpolated."""
    if diagonal <= 0:
        return 1.0
    key = lambda s: F.xxhash64(*[F.floor(F.col(c) / F.lit(s)) for c in AXES])
    start = max(0, int(math.log(max(n / (2 * k), 1), 8)))
    sizes, held = [], []
    # a double has 52 bits of place
    while (not held or held[-1] >= 2 * k) and len(sizes) < 48:
        batch = [diagonal / 2**i for i in range(start + len(sizes), start + len(sizes) + 8)]
        cells = target.agg(*[F.approx_count_distinct(key(s)) for s in batch]).first()
        sizes, held = sizes + batch, held + [n / max(c, 1) for c in cells]
    best = max((i for i, h in enumerate(held) if h >= 2 * k), default=0)
    if best + 1 < len(sizes) and held[best] > 1.15 * held[best + 1]:
        # the cloud's dimension here: a power of the size
        power = math.log2(held[best] / held[best + 1])
        return sizes[best] * min(1.0, max(0.5, (2 * k / held[best]) ** (1 / power)))
    return sizes[best]


def search(query: DataFrame, target: DataFrame, k: int, radius: float | None = None) -> DataFrame:
    """(x, y, z, near): the k nearest target points of every place asked for
    (`places` or `sites`) as an array of (d2, nid) in this order, or of d2 alone
    where the target (`sites` with this k) has no ids; all of them where the
    target has fewer. An empty target gives no rows. Both tables are read
    several times.

    With a radius, only neighbours within it are sure to be found, and places
    without any may have no row.

    Only what is no farther than a place's block reaches is ranked, so a place
    is settled as soon as it has k. The others go on with larger blocks: the
    number found tells by how much, assuming a surface. Settled rows are
    written out round by round.
    """
    ids = "ids" in target.columns
    kind = "array<struct<d2: double, nid: bigint>>" if ids else "array<double>"
    both = query.select(F.lit(0).alias("t"), F.lit(0).alias("n"), *AXES).unionByName(target.select(F.lit(1).alias("t"), "n", *AXES))
    own = [F.when(F.col("t") > 0, F.col(c)) for c in AXES]
    ends = both.agg(F.sum("n"), F.sum("t"), *[f(c) for c in own for f in (F.min, F.max)]).first()
    if not ends[0] or (radius is not None and radius <= 0):
        return query.sparkSession.createDataFrame([], f"x double, y double, z double, near {kind}")
    n = ends[1]
    size = _cell(target, max(k * n / ends[0], 1.0), n, math.sqrt(sum((ends[2 * i + 3] - ends[2 * i + 2]) ** 2 for i in range(3))))
    want = min(k, ends[0])
    # levels are half doublings of the size; the last one reaches the radius
    widest = None if radius is None else 2 * radius * SLACK * SLACK
    last = None
    if widest is not None:
        size = min(size, widest)
        last = max(0, math.ceil(2 * math.log2(widest / size)))
    width = F.lit(size) * F.pow(F.lit(2.0), F.col("lv") / 2)
    if widest is not None:
        width = F.least(width, F.lit(widest))
    left, levels, done = query.select(*AXES, F.lit(0).alias("lv")), [0], []
    keys = ["lv", *CORNER]
    place = [F.col(f"a_{c}").alias(c) for c in AXES]
    mine = [*keys, "reach", *[f"a_{c}" for c in AXES]]
    held = ["b_n", "b_id", *(["b_ids"] if ids else [])]
    while levels:
        a = asking(left, "a", width)
        a = a.withColumn("reach", F.least(*[width - F.abs(F.col(f"a_{c}") - F.col(v) * width) for c, v in zip(AXES, CORNER)]) / SLACK)
        b = target.withColumnsRenamed({h[2:]: h for h in held}).withColumn("lv", F.explode(F.array(*map(F.lit, levels))))
        b = answering(b, "b", width)
        if done or query is not target:  # where blocks are few, Catalyst broadcasts them and little is copied
            b = b.join(a.select(*keys).distinct(), keys, "left_semi")
        met = a.join(b.hint("merge"), keys).withColumn("d2", d2()).where(F.col("d2") <= F.col("reach") * F.col("reach")).select(*mine, "d2", *held)
        if want == 1:
            one = F.col("one.d2") if not ids else F.struct("one.d2", F.col("one.b_id").alias("nid"))
            best = met.groupBy(*mine).agg(F.min(F.struct("d2", "b_id")).alias("one")).select(*mine, F.array(one).alias("near"), F.lit(1).alias("n"))
        else:
            rank = F.row_number().over(Window.partitionBy(*mine).orderBy("d2", "b_id"))
            best = met.withColumn("rank", rank).where(F.col("rank") <= want).groupBy(*mine).agg(F.sort_array(F.collect_list(F.struct("d2", *reversed(held)))).alias("met"))
            # places farther than where the number is full hold none of the k nearest
            full = f"aggregate(met, named_struct('n', 0, 'd2', -1D), (s, m) -> named_struct('n', s.n + m.b_n, 'd2', if(s.n < {want}, m.d2, s.d2)))"
            each = "transform(m.b_ids, i -> named_struct('d2', m.d2, 'nid', i))" if ids else "array_repeat(m.d2, m.b_n)"
            best = best.withColumn("full", F.expr(full))
            best = best.withColumn("near", F.expr(f"slice(sort_array(flatten(transform(filter(met, m -> m.d2 <= full.d2), m -> {each}))), 1, {want})")).withColumn("n", F.least("full.n", F.lit(want)))
        found = stored(best.select(*place, "near", "reach", "n", "lv"), "near")
        settled = F.col("n") == want
        if last is not None:
            settled = settled | (F.col("lv") >= last)
        done.append(found.where(settled).select(*AXES, "near"))
        # the radius that should hold a fifth more than asked, on a surface
        more = F.col("reach") * F.sqrt(F.lit(1.2 * want) / F.col("n"))
        enough = F.round(F.log2(more * (2.0 / size)) * 2).cast("int")
        more = F.greatest(F.col("lv") + 1, F.coalesce(enough, F.col("lv") + 2))
        before = left
        left = left.join(found.select(*AXES, "reach", "n"), list(AXES), "left").where(F.coalesce(F.col("n"), F.lit(0)) < want)
        if last is not None:
            left, more = left.where(F.col("lv") < last), F.least(more, F.lit(last))
        left = stored(left.select(*AXES, more.alias("lv")), "left")
        levels = [r.lv for r in left.select("lv").distinct().collect()]
        discard(before)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def own_search(cloud: DataFrame, k: int, radius: float | None = None) -> DataFrame:
    """(x, y, z, near): `search` of a cloud in itself, without ids."""
    own = stored(sites(cloud, k, ids=False), "sites")
    return search(own, own, k, radius)


def neighbours(query: DataFrame, target: DataFrame, k: int) -> DataFrame:
    """(pid, near): the k nearest target points of every query point as an array
    of (d2, nid) in this order; all of them where the target has fewer. An
    empty target gives no rows."""
    there = stored(sites(target, k), "sites")
    asked = there if query is target else stored(places(query), "asked")
    return query.select("pid", *AXES).join(search(asked, there, k), list(AXES)).select("pid", "near")


def knn(query: DataFrame, target: DataFrame, k: int) -> DataFrame:
    """(pid, rank, nid, d2): neighbours by rows, rank from 1, ties by nid."""
    rows = neighbours(query, target, k).select("pid", F.posexplode("near").alias("rank", "n"))
    return rows.select("pid", (F.col("rank") + 1).alias("rank"), "n.nid", "n.d2")


def nearest(query: DataFrame, target: DataFrame) -> DataFrame:
    """(pid, nid, dist): the nearest target point at any distance. An empty
    target gives no rows."""
    first = F.col("near")[0]
    return neighbours(query, target, 1).select("pid", first["nid"].alias("nid"), F.sqrt(first["d2"]).alias("dist"))


def with_kth_distance(cloud: DataFrame, k: int) -> DataFrame:
    """cloud with dk: distance to the k-th neighbour, or the farthest where
    there are fewer, the point itself not counted."""
    far = own_search(cloud, k + 1).select(*AXES, F.sqrt(F.element_at("near", -1)).alias("dk"))
    return cloud.join(far, list(AXES)).select(*cloud.columns, "dk")


def kth_distance(cloud: DataFrame, k: int) -> DataFrame:
    """(pid, dk) of `with_kth_distance`."""
    return with_kth_distance(cloud, k).select("pid", "dk")
