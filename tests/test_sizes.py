"""Tables of more users and points than sf0.1 has: numbers that fields and 64-bit sums don't hold."""

import duckdb
import pytest

from pointmill.operators import intervals as I
from pointmill.operators import quadtree as Q
from pointmill.plans import files, spatial

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_users(tmp_path_factory):
    """The events of sf0.001 three times, of users up to 132,014."""
    folder = str(tmp_path_factory.mktemp("users"))
    duckdb.sql(f"COPY (SELECT event_id + k * 1000 AS event_id, ts, user_id + k * 66000 AS user_id, event_type, value, props FROM '{SF}/events.parquet', range(3) t(k) ORDER BY 1) TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


def equal(spark, folder, query, sql):
    df = query(spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    return sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_sums_beyond_64_bits(spark, many_users):
    """The squares of y in a batch are more than 2^63."""
    assert equal(spark, many_users, spatial.covariance_xyz, spatial.ORACLES["covariance_xyz"])


@pytest.mark.parametrize("name", sorted(set(files.QUERIES) - {"foreign_points"}))
def test_users_beyond_16_bits(spark, many_users, name):
    assert equal(spark, many_users, files.QUERIES[name], files.ORACLES[name])


def test_users_below_zero(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT * REPLACE (user_id * 100000 - 700000 AS user_id) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert equal(spark, str(tmp_path), files.QUERIES["las_roundtrip_pf6"], files.ORACLES["las_roundtrip_pf6"])


def test_bounds_beyond_24_bits(spark, many_users):
    """Bounds are 32-bit floats for whole numbers too, so that points at the edge may lie outside."""
    rows = spark.createDataFrame([(0, 13), (5, 89_999_986)], "x long, y long")
    assert Q.box_of(rows) == Q.Box(0.0, 13.0, 5.0, 89_999_984.0)
    for name in ("index_validation", "quadtree_cell", "cell_bounds"):
        assert equal(spark, many_users, spatial.QUERIES[name], spatial.ORACLES[name])


def test_points_in_intervals(spark):
    """Overlapping intervals, some over borders of blocks, one empty, points without a cell, points that occur twice."""
    spans = [(0, 2, 9), (0, 4, 5), (0, 14, 17), (1, 3, 3), (1, 8, 7), (2, 0, 40), (None, 0, 40)]
    places = [(c, i) for c in (0, 1, 2, 3, None) for i in range(45)] + [(0, 4)]
    points = spark.createDataFrame(places, "cell long, point_index long")
    got = I.within(points, spark.createDataFrame(spans, "cell long, start long, end long"), block=8)
    assert got.columns == points.columns
    want = [(c, i) for c, i in places if c is not None and any(c == d and a <= i <= b for d, a, b in spans)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
