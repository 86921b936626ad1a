import pytest

from pointmill.plans import convert, programs
from pointmill.plans.points import points
from pointmill.sources.las import LasSource

SF = "/root/testdata/sf0.001"


def test_programs(spark, tmp_path):
    """Look into a file, check its index, compare it with its source and with another one."""
    spark.dataSource.register(LasSource)
    a, b, c = (f"{tmp_path}/{n}" for n in ("a.las", "b.laz", "c.las"))
    rows = points(spark, SF).orderBy("point_index")
    rows.write.format("las").options(format="1", wkt="W").mode("overwrite").save(a)
    convert.convert(spark, a, b, add_index=True, chunk_size=100, tile=2.0)
    rows.where("point_index <> 5").selectExpr("*").withColumn("intensity", rows["intensity"] * 0 + 1).coalesce(1).orderBy("point_index").write.format("las").option("format", 1).mode("overwrite").save(c)
    text = programs.inspect(spark, b)
    assert "1000 points of 28 bytes" in text and "projection/coordinate_wkt" in text and "index (evlr)" in text and "more" in text.splitlines()[-1]
    assert programs.inspect(spark, a).endswith("no index")
    report = programs.validate_index(spark, b)
    assert (report["n_points"], report["in_intervals"], report["missing"], report["unused"], report["efficiency"]) == (1000, 1000, [], [], 1.0)
    with pytest.raises(ValueError):
        programs.validate_index(spark, a)
    assert programs.compare(spark, a, a) == {"mismatches": 0, "first": []}
    odd = programs.compare(spark, a, c)
    assert odd["mismatches"] >= 990 and len(odd["first"]) == 10
    assert programs.read_bytes(spark, a) == 375 + 54 + 2 + 28 * 1000
