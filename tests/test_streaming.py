from pointloom.streaming.occupancy import new_cells

from .clouds import POINT, cloud, random_points


def test_stream_equals_batch(spark, tmp_path):
    p = random_points(200, 60)
    source = str(tmp_path / "in")
    for k in range(3):
        cloud(spark, p[k * 60 : k * 60 + 80], k * 100).write.mode("append").parquet(source)
    stream = new_cells(spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(source), 0.5)
    run = stream.writeStream.format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = {tuple(r) for r in new_cells(spark.read.parquet(source), 0.5).collect()}
    got = [tuple(r) for r in spark.table("cells").collect()]
    assert len(got) == len(set(got)) and set(got) == want
