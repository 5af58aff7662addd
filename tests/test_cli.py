from pointloom.__main__ import main
from pointloom.sources import formats

from .clouds import cloud, random_points


def test_programs_from_the_command_line(spark, tmp_path, capsys):
    truth = random_points(120, 40)
    formats.write_cloud(cloud(spark, truth), f"{tmp_path}/truth.ply")
    formats.write_cloud(cloud(spark, list(truth[:80] + 0.01) + [[9, 9, 9]]), f"{tmp_path}/map.pcd")
    main(["evaluate", f"{tmp_path}/map.pcd", f"{tmp_path}/truth.ply", "--no-align", "--down-sample", "0"], spark)
    said = capsys.readouterr().out
    assert "Chamfer_L1" in said and "F-score" in said
    main(["clean-near-truth", f"{tmp_path}/map.pcd", f"{tmp_path}/truth.ply", f"{tmp_path}/near.pcd", "--threshold", "0.1"], spark)
    assert "kept 80 of 81" in capsys.readouterr().out
    assert formats.read_cloud(spark, f"{tmp_path}/near.ply").count() == 80
    main(["pcd-to-ply", f"{tmp_path}/map.pcd", f"{tmp_path}/map.ply"], spark)
    assert formats.read_cloud(spark, f"{tmp_path}/map.ply").count() == 81
