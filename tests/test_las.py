import pytest

from pointmill.plans.points import points
from pointmill.sources import layout
from pointmill.sources.las import LasSource

SF = "/root/testdata/sf0.001"
SIZES = [20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67]


@pytest.fixture(scope="module")
def las(spark):
    spark.dataSource.register(LasSource)
    return spark


@pytest.mark.parametrize("fmt", range(11))
def test_round_trip(las, tmp_path, fmt):
    assert layout.record(fmt).itemsize == SIZES[fmt]
    df, path = points(las, SF), f"{tmp_path}/a.las"
    df.orderBy("point_index").write.format("las").option("format", fmt).option("scale_x", -0.5).option("wkt", "TEST WKT").mode("overwrite").save(path)
    back = las.read.format("las").load(path)
    shared = [c for c in df.columns if c in back.columns]
    assert {"x", "y", "z", "return_number", "classification", "point_source_id"} <= set(shared)
    assert sorted(map(tuple, back.select(shared).collect())) == sorted(map(tuple, df.select(shared).collect()))
    head = las.read.format("las").option("table", "header").load(path).first()
    ends = df.selectExpr("min(x)", "max(x)", "count(*)").first()
    assert (head.format, head.n_points, head.min_x, head.max_x) == (fmt, ends[2], ends[1] * -0.5, ends[0] * -0.5)
    assert head.by_return[:5] == [200] * 5
    record = las.read.format("las").option("table", "vlr").load(path).first()
    assert (record.user_id, record.record_id, bytes(record.payload)) == ("LASF_Projection", 2112, b"TEST WKT\0")


def test_extra_bytes_and_nothing(las, tmp_path):
    path = f"{tmp_path}/a.las"
    df = las.createDataFrame([(1, 2, 3, b"abcd"), (4, 5, 6, b"wxyz")], "x int, y int, z int, extra_bytes binary").coalesce(1)
    df.write.format("las").option("format", 7).option("extrabytes", 4).mode("overwrite").save(path)
    assert [(r.x, bytes(r.extra_bytes)) for r in las.read.format("las").load(path).orderBy("point_index").collect()] == [(1, b"abcd"), (4, b"wxyz")]
    df.limit(0).write.format("las").option("format", 1).mode("overwrite").save(path)
    assert las.read.format("las").load(path).count() == 0


def test_bad_input(tmp_path):
    with pytest.raises(ValueError):
        layout.record(11)
    with pytest.raises(ValueError):
        layout.encode({"x": [1], "return_number": [9]}, 0, 20)
    (tmp_path / "x.las").write_bytes(b"nothing")
    with open(tmp_path / "x.las", "rb") as f, pytest.raises(ValueError):
        layout.read_header(f)
