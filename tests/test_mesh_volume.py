import numpy as np
import pytest

from pointloom.operators import mesh, volume
from pointloom.plans import pipelines

from .clouds import cloud, random_points

CUBE = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
QUADS = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]


def cube(spark):
    faces = [(a, b, c) for q in QUADS for a, b, c in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]
    v = spark.createDataFrame(CUBE, "vid bigint, x double, y double, z double")
    f = spark.createDataFrame([(k, *t) for k, t in enumerate(faces)], "fid bigint, i0 bigint, i1 bigint, i2 bigint")
    return v, f


def test_area_and_normals(spark):
    v, f = cube(spark)
    assert np.isclose(mesh.surface_area(v, f).first()[0], 6)
    n = mesh.vertex_normals(v, f).toPandas()
    out = n[["x", "y", "z"]].to_numpy() - 0.5
    assert ((n[["nx", "ny", "nz"]].to_numpy() * out).sum(1) > 0).all()
    assert mesh.sample_budget(mesh.surface_area(v, f), 0.01).first()[0] == 600_000


def test_cleaning(spark):
    v, f = cube(spark)
    doubled = v.union(v.selectExpr("vid + 8", "x", "y", "z"))
    extra = [(100, 2, 3, 0), (101, 0, 3, 2), (102, 0, 0, 1), (103, 0, 2, 3), (104, 8, 10, 11)]
    dirty = f.union(spark.createDataFrame(extra, f.schema))
    cv, cf = mesh.clean(doubled, dirty)
    assert cv.count() == 8
    rows = {r.fid: {r.i0, r.i1, r.i2} for r in cf.collect()}
    assert 102 not in rows and 103 not in rows and 104 not in rows and 100 not in rows
    assert all(x < 8 for s in rows.values() for x in s)
    edges = [tuple(sorted(e)) for r in cf.collect() for e in ((r.i0, r.i1), (r.i1, r.i2), (r.i2, r.i0))]
    assert max(edges.count(e) for e in edges) <= 2


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_surface_sample(spark, n):
    v, f = cube(spark)
    p = mesh.sample_surface(v, f, n).toPandas()
    assert len(p) == n and sorted(p.pid) == list(range(n))
    q = p[["x", "y", "z"]].to_numpy()
    assert (np.minimum(abs(q), abs(q - 1)).min(1) < 1e-12).all() and (q > -1e-9).all() and (q < 1 + 1e-9).all()
    if n == 1000:
        assert p.groupby("fid").size().between(82, 85).all()
        again = mesh.sample_surface(v, f.repartition(5), n).toPandas()
        assert np.allclose(np.sort(again.x), np.sort(p.x))
    assert mesh.sample_surface(v, f.limit(0), n).count() == 0


def test_distance_transform(spark):
    rng = np.random.default_rng(1)
    occ = rng.random((5, 4, 6)) < 0.1
    occ[2, 2, 2] = True
    rows = [(int(i), int(j), int(k), bool(occ[i, j, k])) for i, j, k in np.ndindex(occ.shape)]
    grid = spark.createDataFrame(rows, "ix int, iy int, iz int, occ boolean")
    got = volume.distance_transform(grid, 0.5).toPandas()
    seeds = np.argwhere(occ)
    for r in got.itertuples():
        want = 0.5 * np.sqrt(((seeds - [r.ix, r.iy, r.iz]) ** 2).sum(1).min())
        assert np.isclose(r.dist, want)
    sdf = volume.signed_distance(grid, 0.5).toPandas()
    assert (sdf.sdf[sdf.occ] < 0).all() and (sdf.sdf[~sdf.occ] > 0).all()
    flat = volume.gaussian(grid.selectExpr("ix", "iy", "iz", "occ", "2.0D as sdf"), 1.0)
    assert np.allclose(flat.toPandas().sdf, 2.0)


def test_all_cases_are_closed():
    """Every triangle edge inside a cube is shared by two triangles in opposite
    directions or lies on a side of the cube."""
    for k, tris in enumerate(volume.cases()):
        assert bool(tris) == (k not in (0, 255))
        cut = {e for e, (a, b) in enumerate(volume.EDGES) if (k >> a & 1) != (k >> b & 1)}
        assert {e for t in tris for e in t} == cut
        edges = [(t[i], t[(i + 1) % 3]) for t in tris for i in range(3)]
        assert len(edges) == len(set(edges))


def test_surface_is_watertight(spark):
    p = random_points(400, 30) * 0.3
    v, f = pipelines.cloud_to_mesh(cloud(spark, p), 0.2, 0.4)
    v, f = v.toPandas(), f.toPandas()
    assert sorted(v.vid) == list(range(len(v))) and sorted(f.fid) == list(range(len(f)))
    edges = {}
    for t in f[["i0", "i1", "i2"]].to_numpy():
        for i in range(3):
            e = (t[i], t[(i + 1) % 3])
            edges[e] = edges.get(e, 0) + 1
    # two cubes may cut the same diagonal of a side between them; it stays balanced
    assert all(edges.get(e[::-1]) == n for e, n in edges.items())
    at = v.set_index("vid")[["x", "y", "z"]]
    a, b, c = (at.loc[f[i]].to_numpy() for i in ("i0", "i1", "i2"))
    assert np.einsum("ij,ij->i", a, np.cross(b, c)).sum() > 0  # normals point outwards


def test_too_few_points(spark):
    with pytest.raises(ValueError):
        pipelines.cloud_to_mesh(cloud(spark, random_points(49)), 0.2)


def test_midpoints_are_surface_vertices(spark):
    from pointloom.functions.geometry import grid_dims

    c = cloud(spark, random_points(200, 31) * 0.3)
    dims = grid_dims(c, 0.2, 0.4)
    mid = volume.boundary_midpoints(volume.occupancy(c, 0.2, 0.4), dims).count()
    assert pipelines.cloud_to_mesh(c, 0.2, 0.4)[0].count() == mid


def test_mesh_to_cloud(spark):
    v, f = cube(spark)
    cv, cf, points = pipelines.mesh_to_cloud(v, f, voxel=0.2, low=2000, high=4000)
    assert cf.count() == 12 and cv.where("nx is not null").count() == 8
    p = points.toPandas()
    inside = p[(abs(p.z) < 1e-9) & p.x.between(0.3, 0.7) & p.y.between(0.3, 0.7)]
    assert len(inside) and (abs(inside.nz) > 0.9).all()
