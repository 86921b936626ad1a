"""File queries in a session that has no pushdown of conditions to data sources, as Spark starts by default."""

import duckdb
import pytest

from pointmill.plans import convert, files
from pointmill.sources.las import LasSource

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plain(spark):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", sorted(files.ORACLES))
def test_query_without_pushdown(plain, name):
    df = files.QUERIES[name](plain, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    cols = ", ".join(sorted(df.columns))
    want = con.sql(f"SELECT {cols} FROM ({files.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect()))) == sorted(map(repr, want))


def test_conditions_without_pushdown(plain, tmp_path):
    """Conditions hold with every partition read, by the helper and by the plain data source."""
    plain.dataSource.register(LasSource)
    path = f"{tmp_path}/a.laz"
    rows = convert.generated(plain, 1000).orderBy("point_index").coalesce(1)
    rows.write.format("las").options(format="1", compressed="true", chunk_size="300").mode("overwrite").save(path)
    for df in (convert.reader(plain, path), plain.read.format("las").load(path)):
        some = df.where("point_index IN (1, 999)")
        assert sorted(r.point_index for r in some.collect()) == [1, 999] and some.rdd.getNumPartitions() == 4
