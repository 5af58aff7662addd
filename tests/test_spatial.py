import numpy as np
import pytest

from pointloom.operators import filters, metrics, spatial

from .clouds import cloud, distances, pids, points, random_points


@pytest.mark.parametrize("clumps", [False, True])
def test_nearest_like_brute_force(spark, clumps):
    a, b = random_points(120, 1, clumps), random_points(90, 2, clumps) * 3
    d = distances(a, b)
    got = spatial.nearest(cloud(spark, a), cloud(spark, b)).toPandas().sort_values("pid")
    assert np.allclose(got.dist, d.min(1)) and (got.nid == d.argmin(1)).all()


@pytest.mark.parametrize("k", [1, 4, 200])
def test_knn_like_brute_force(spark, k):
    a, b = random_points(80, 3), random_points(60, 4, True)
    d = distances(a, b)
    got = spatial.knn(cloud(spark, a), cloud(spark, b), k).toPandas()
    n = min(k, 60)
    assert len(got) == 80 * n
    got = got.sort_values(["pid", "rank"])
    assert np.allclose(np.sqrt(got.d2.to_numpy()).reshape(80, n), np.sort(d, 1)[:, :n])


def test_truncation_is_strict(spark):
    ref, query = cloud(spark, [[0, 0, 0]]), cloud(spark, [[0.5, 0, 0], [0.25, 0, 0], [3, 0, 0]])
    got = spatial.nn_truncated(ref, query, 0.5)
    assert [(r.pid, r.dist) for r in got.collect()] == [(1, 0.25)]
    got = spatial.nn_truncated(ref, query, 0.5, ignore_outlier=False)
    assert sorted((r.pid, r.nid, r.dist) for r in got.collect()) == [(0, 0, 0.5), (1, 0, 0.25), (2, 0, 0.5)]


def test_empty_sides(spark):
    none, some = cloud(spark, []), cloud(spark, [[0, 0, 0]])
    for a, b in ((none, some), (some, none), (none, none)):
        for keep in (True, False):
            assert spatial.nn_truncated(a, b, 1.0, keep).count() == 0
        assert spatial.nearest(a, b).count() == 0
        assert spatial.within(a, b, 1.0).count() == 0
    m = metrics.recon_metrics(none, some).first()
    assert m.mae_acc is None and m.f_score_pct is None


def test_within_and_intersection(spark):
    gt, p = random_points(80, 5), random_points(90, 6)
    q = random_points(70, 7)
    d, e = distances(gt, p), distances(gt, q)
    assert pids(spatial.within(cloud(spark, gt), cloud(spark, p), 0.5)) == np.flatnonzero(d.min(1) < 0.5).tolist()
    both = cloud(spark, p).selectExpr("*", "'p' as cloud_id").union(cloud(spark, q).selectExpr("*", "'q' as cloud_id"))
    want = np.flatnonzero((d.min(1) < 0.6) & (e.min(1) < 0.6)).tolist()
    assert pids(spatial.within_all(cloud(spark, gt), both, 0.6)) == want


def test_same_for_any_partitioning(spark):
    p = cloud(spark, random_points(100, 8))
    one = filters.statistical_outliers(p.coalesce(1), 8, 1.0)
    many = filters.statistical_outliers(p.repartition(9), 8, 1.0)
    assert pids(one) == pids(many)
    assert pids(filters.sample(p.coalesce(1), 20)) == pids(filters.sample(p.repartition(7), 20))
    assert filters.sample(p, 500).count() == 100


def test_outlier_filters_like_brute_force(spark):
    p = random_points(150, 9)
    c = cloud(spark, p)
    d = np.sort(distances(p, p), 1)
    m = d[:, :10].mean(1)
    assert pids(filters.statistical_outliers(c, 10, 1.0)) == np.flatnonzero((m > 0) & (m < m.mean() + m.std(ddof=1))).tolist()
    assert pids(filters.radius_outliers(c, 5, 0.5)) == np.flatnonzero((d < 0.5).sum(1) > 5).tolist()
    dk = d[:, 6]
    assert pids(filters.knn_percentile(c, 6, 90.0, 1.0)) == np.flatnonzero(dk <= np.percentile(dk, 90)).tolist()
    hi = p[:, 2] > 0.5
    thr = np.where(hi, np.percentile(dk[hi], 90) * 1.3, np.percentile(dk, 90))
    assert pids(filters.knn_percentile(c, 6, 90.0, 1.0, True, 0.5)) == np.flatnonzero(dk <= thr).tolist()
    far = filters.knn_percentile(c, 6, 90.0, 1.0, True, 99.0)
    assert pids(far) == pids(filters.knn_percentile(c, 6, 90.0, 1.0))


def test_identical_points_are_no_inliers(spark):
    c = cloud(spark, [[1, 1, 1]] * 30)
    assert filters.statistical_outliers(c, 5, 1.0).count() == 0
    assert filters.radius_outliers(c, 16, 0.1).count() == 30


def test_crops(spark):
    p = cloud(spark, [[0, 0, 0], [1, 1, 1], [1, 1, 1.05], [1.05, 1, 1], [2, 2, 2]])
    box = filters.bounds(p.where("pid < 2"))
    assert pids(filters.crop(p, box)) == [0, 1]
    assert pids(filters.crop(p, filters.padded(box, 0.1, ("z",)))) == [0, 1, 2]
    assert pids(filters.crop(p, filters.padded(box, 0.1))) == [0, 1, 2, 3]
    assert pids(filters.crop(p, filters.scaled(box, 4.0))) == [0, 1, 2, 3, 4]
    once = filters.crop(p, box)
    assert pids(filters.crop(once, box)) == pids(once)
    assert filters.crop(p, filters.bounds(p.limit(0))).count() == 0


def test_voxels(spark):
    p = random_points(200, 10)
    out = metrics.voxel_downsample(cloud(spark, p), 0.5)
    cells = np.floor((p - (p.min(0) - 0.25)) / 0.5).astype(int)
    _, inverse = np.unique(cells, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    want = np.array([p[inverse == k].mean(0) for k in range(inverse.max() + 1)])
    got = points(out)
    assert np.allclose(got[np.lexsort(got.T)], want[np.lexsort(want.T)])
    c = cloud(spark, p)
    assert metrics.voxel_downsample(c, 0) is c


def test_metrics_survive_a_common_motion(spark):
    from pointloom.functions.geometry import compose, rotation, transform, translation

    a, b = cloud(spark, random_points(80, 11)), cloud(spark, random_points(80, 12))
    t = compose(rotation((1, 0, 2), 0.5), translation(3, 2, 1))
    one = metrics.recon_metrics(a, b, 0.3, 1.0, 1.0).first()
    two = metrics.recon_metrics(transform(a, t), transform(b, t), 0.3, 1.0, 1.0).first()
    assert np.allclose(list(one), list(two))


def test_depth(spark):
    df = spark.createDataFrame([(2.0, 1.0), (0.0, 1.0), (1.0, 10.0), (1.0, 0.0), (3.0, 3.0)], "pred double, trgt double")
    m = metrics.depth_metrics(df).first()
    assert m.complete == 0.8 and m.abs_rel == 0.5 and m.abs_diff == 0.5 and m.r1 == 0.5
    none = metrics.depth_metrics(df.limit(0)).first()
    assert none.complete is None and none.abs_rel is None
    by = metrics.depth_metrics(df.selectExpr("*", "1 as img"), ("img",)).first()
    assert by.rmse == m.rmse


def test_yaw():
    assert metrics.yaw(None, None, None) == 0.0
    assert abs(abs(metrics.yaw(1.0, 1.0, 1.0)) % np.pi - np.pi / 4) < 1e-9 or abs(abs(metrics.yaw(1.0, 1.0, 1.0)) - 3 * np.pi / 4) < 1e-9


def test_a_radius_that_holds_everything(spark, monkeypatch):
    """The pairs of a dense cloud within a radius are never joined."""
    from pyspark.sql import functions as F

    widths, whole = [], spatial.answering

    def watched(cloud, prefix, size):
        widths.append(cloud.select(F.max(size)).first()[0])
        return whole(cloud, prefix, size)

    monkeypatch.setattr(spatial, "answering", watched)
    p = np.repeat(np.random.default_rng(13).random((60, 3)), 5, 0)
    d = distances(p, p[::2])
    got = spatial.nearest_within(cloud(spark, p), cloud(spark, p[::2]), 50.0).toPandas().sort_values("pid")
    assert np.allclose(np.sqrt(got.d2), d.min(1)) and (got.nid == d.argmin(1)).all()
    assert pids(filters.radius_outliers(cloud(spark, p), 16, 50.0)) == list(range(300))
    assert widths and max(widths) < 50.0


def test_points_at_one_place(spark, monkeypatch):
    """Many points at few places take few rounds and keep ties by id."""
    rounds, kept = [], spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, name: rounds.append(name) or kept(df, name))
    p = np.repeat(random_points(20, 14), 40, 0)
    q = random_points(15, 15)
    d = distances(q, p)
    got = spatial.knn(cloud(spark, q), cloud(spark, p), 50).toPandas().sort_values(["pid", "rank"])
    want = np.array([sorted(range(len(p)), key=lambda j: (round(row[j], 9), j))[:50] for row in d])
    assert (got.nid.to_numpy().reshape(15, 50) == want).all()
    assert rounds.count("left") < 12
