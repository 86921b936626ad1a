import pytest

from pointmill.plans.points import points
from pointmill.sources import blobs
from pointmill.sources.las import LasSource
from pointmill.streaming import ingest

SF = "/root/testdata/sf0.001"


def put(spark, folder, name, where, **options):
    rows = points(spark, SF).where(where).orderBy("point_index").coalesce(1)
    rows.write.format("las").options(format="1", **options).mode("overwrite").save(f"{folder}/{name}")


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(LasSource)
    (tmp_path / "in").mkdir()
    put(spark, tmp_path / "in", "a.las", "point_index < 300")
    put(spark, tmp_path / "in", "b.laz", "point_index >= 300 AND point_index < 700", compressed="true", chunk_size="150")
    return tmp_path


def test_files_of_any_store(spark, folder):
    got = blobs.read(spark, f"file://{folder}/in", 1)
    want = points(spark, SF).where("point_index < 700")
    fields = ["x", "y", "z", "gps_time", "intensity", "return_number"]
    assert sorted(map(tuple, got.select(fields).collect())) == sorted(map(tuple, want.select(fields).collect()))
    assert {(r.path[-5:], r.n) for r in got.groupBy("path").agg({"point_index": "max"}).toDF("path", "n").collect()} == {("a.las", 299), ("b.laz", 399)}
    with pytest.raises(Exception, match="format 1"):
        blobs.read(spark, f"file://{folder}/in", 3).count()


def test_arriving_files(spark, folder):
    """A file is read once, whatever comes later."""
    run = lambda: ingest.ingest(ingest.arriving(spark, f"{folder}/in", 1, files_at_once=1), f"{folder}/out", f"{folder}/state").awaitTermination(120)
    run()
    assert spark.read.parquet(f"{folder}/out").count() == 700
    put(spark, folder / "in", "c.las", "point_index >= 700")
    run()
    out = spark.read.parquet(f"{folder}/out")
    assert out.count() == 1000 and out.select("gps_time").distinct().count() == 1000


def test_windows_of_time(spark, folder):
    one = {r.start.timestamp(): r.n_points for r in ingest.by_time(blobs.read(spark, f"{folder}/in", 1), "100 milliseconds").collect()}
    assert sum(one.values()) == 700 and set(one.values()) == {100}
