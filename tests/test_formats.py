import numpy as np
import pytest

from pointloom.operators import mesh
from pointloom.plans import pipelines
from pointloom.sources import formats

from .clouds import cloud, points, random_points
from .test_mesh_volume import cube


@pytest.mark.parametrize("kind", ["ply", "pcd"])
@pytest.mark.parametrize("text", [False, True])
def test_round_trip(spark, tmp_path, kind, text):
    formats.register(spark)
    p = random_points(300, 50)
    df = cloud(spark, p).selectExpr("*", "cast(pid as int) as ring", "cast(x as float) as intensity", "z as nx")
    path = str(tmp_path / "deep" / f"a.{kind}")
    df.sort("pid").write.format(kind).option("ascii", str(text)).mode("overwrite").save(path)
    got = spark.read.format(kind).load(path)
    assert got.columns == df.columns
    a, b = got.sort("pid").toPandas(), df.sort("pid").toPandas()
    assert (a.pid == b.pid).all() and np.allclose(a.drop(columns="pid"), b.drop(columns="pid"))
    assert list((tmp_path / "deep").iterdir()) == [tmp_path / "deep" / f"a.{kind}"]


def test_parallel_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "SPLIT", 64)
    path = str(tmp_path / "a.ply")
    formats.write_cloud(cloud(spark, random_points(300, 51)), path)
    reader = formats.RecordReader(formats.ply_vertices(path), formats.ply_vertices(path).schema())
    parts = reader.partitions()
    assert len(parts) == 5
    assert sum(b.num_rows for q in parts for b in reader.read(q)) == 300


def test_foreign_headers(spark, tmp_path):
    formats.register(spark)
    text = "ply\nformat ascii 1.0\ncomment made by hand\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n1 2 3 255\n4 5 6 0\n4 0 1 0 1\n"
    (tmp_path / "a.ply").write_text(text)
    got = spark.read.format("ply").load(str(tmp_path / "a.ply")).sort("pid").collect()
    assert [tuple(r) for r in got] == [(0, 1.0, 2.0, 3.0, 255), (1, 4.0, 5.0, 6.0, 0)]
    faces = spark.read.format("ply").option("element", "face").load(str(tmp_path / "a.ply")).collect()
    assert [tuple(r) for r in faces] == [(0, 0, 1, 0), (1, 0, 0, 1)]
    pcd = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z rgb\nSIZE 4 4 4 2\nTYPE F F F U\nCOUNT 1 1 1 2\nWIDTH 1\nHEIGHT 1\nDATA ascii\n1 2 3 7 8\n"
    (tmp_path / "a.pcd").write_text(pcd)
    row = spark.read.format("pcd").load(str(tmp_path / "a.pcd")).first()
    assert row.rgb == [7, 8] and row.z == 3.0


def test_stl(spark, tmp_path):
    v, f = cube(spark)
    path = str(tmp_path / "cube.stl")
    formats.write_stl(v, f, path)
    assert (tmp_path / "cube.stl").stat().st_size == 84 + 50 * 12
    rv, rf = formats.read_mesh(spark, path)
    assert rv.count() == 36 and rf.count() == 12
    assert np.isclose(mesh.surface_area(rv, rf).first()[0], 6)
    mv, mf = mesh.merge_vertices(rv, rf)
    assert mv.count() == 8 and mf.count() == 12
    text = "solid t\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid t\n"
    (tmp_path / "t.stl").write_text(text)
    assert np.isclose(mesh.surface_area(*formats.read_mesh(spark, str(tmp_path / "t.stl"))).first()[0], 0.5)


def test_mesh_ply(spark, tmp_path):
    v, f = cube(spark)
    path = str(tmp_path / "cube.ply")
    formats.write_mesh_ply(v.selectExpr("vid * 10 as vid", "x", "y", "z"), f.selectExpr("fid", "i0 * 10 as i0", "i1 * 10 as i1", "i2 * 10 as i2"), path)
    rv, rf = formats.read_mesh(spark, path)
    assert rv.count() == 8 and {(r.i0, r.i1, r.i2) for r in rf.collect()} == {(r.i0, r.i1, r.i2) for r in f.collect()}
    assert [p.name for p in tmp_path.iterdir()] == ["cube.ply"]


def test_cloud_or_mesh(spark, tmp_path):
    v, f = cube(spark)
    stl, ply = str(tmp_path / "a.stl"), str(tmp_path / "a.ply")
    formats.write_stl(v, f, stl)
    assert formats.read_cloud_or_mesh(spark, stl, 50).count() == 50
    formats.write_cloud(cloud(spark, random_points(5)), ply)
    assert formats.read_cloud_or_mesh(spark, ply, 50).count() == 5
    formats.write_cloud(cloud(spark, []), ply)
    with pytest.raises(ValueError):
        formats.read_cloud_or_mesh(spark, ply, 50)


def test_missing_files(spark, tmp_path):
    formats.register(spark)
    for kind in ("ply", "pcd", "stl"):
        with pytest.raises(Exception, match="(?i)no such file|FileNotFound|a\\." + kind):
            spark.read.format(kind).load(str(tmp_path / f"a.{kind}"))


def test_programs(spark, tmp_path):
    p = random_points(200, 52) * 0.3
    source = str(tmp_path / "c.pcd")
    formats.write_both(cloud(spark, p).selectExpr("*", "x as reflectance"), source)
    assert np.allclose(points(formats.read_cloud(spark, str(tmp_path / "c.ply"))), p)
    pipelines.pcd_to_ply(spark, source, str(tmp_path / "d.ply"))
    assert dict(formats.read_cloud(spark, str(tmp_path / "d.ply")).dtypes)["intensity"] == "float"
    pipelines.cloud_to_stl(spark, source, str(tmp_path / "s.stl"), voxel=0.2, margin=0.4)
    pipelines.stl_to_cloud(spark, str(tmp_path / "s.stl"), str(tmp_path / "out"), voxel=0.1, low=1000, high=2000)
    assert sorted(q.name for q in (tmp_path / "out").iterdir()) == ["cloud_10cm.pcd", "cloud_10cm.ply", "mesh.ply"]


def test_uris_and_ranges_of_faces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "SPLIT", 7)
    c = cloud(spark, random_points(60, 50)).withColumnRenamed("pid", "vid")
    f = spark.range(20).selectExpr("id as fid", "3 * id as i0", "3 * id + 1 as i1", "3 * id + 2 as i2")
    path = f"file://{tmp_path}/sub/mesh.ply"
    formats.write_mesh_ply(c, f, path)
    assert formats.ply_triangles(path).count == 20
    v, g = formats.read_mesh(spark, path)
    assert sorted(map(tuple, g.collect())) == sorted(map(tuple, f.collect())) and v.count() == 60
    formats.write_stl(v, g, f"file://{tmp_path}/mesh.stl")
    assert formats.read_mesh(spark, f"file://{tmp_path}/mesh.stl")[1].count() == 20
    with pytest.raises(Exception, match="No such file|missing.ply|FileNotFound"):
        formats.read_cloud(spark, f"file://{tmp_path}/missing.ply")
