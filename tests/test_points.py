import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.functions import columns
from pointmill.operators import intervals, quadtree
from pointmill.plans import files, points, spatial

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = {**points.QUERIES, **spatial.QUERIES, **files.QUERIES}, {**points.ORACLES, **spatial.ORACLES, **files.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    cols = ", ".join(sorted(df.columns))
    want = con.sql(f"SELECT {cols} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect()))) == sorted(map(repr, want))


MEDIANS = [  # fixed values: numbers in order and the median after each
    (list(range(1, 11)), [0, 0, 1, 2, 3, 4, 5, 6, 7, 8]),
    (list(range(10, 0, -1)), [0, 0, 8, 8, 7, 6, 5, 4, 3, 2]),
    ([3] * 10, [0, 0] + [3] * 8),
    ([-1, -2, -3, -4, -5, -6, -7, -8, -9, -10], [0, 0, -1, -2, -3, -4, -5, -6, -7, -8]),
    ([-1, -2, -3, -4, -5, -6, -7, 8, 9, 10], [0, 0, -1, -2, -3, -4, -5, -5, -4, 8]),
]


def test_streaming_median(spark):
    rows = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(MEDIANS)], "k int, v array<long>")
    got = {r.k: r.m for r in rows.select("k", columns.streaming_median("v").alias("m")).collect()}
    assert [got[k] for k in range(len(MEDIANS))] == [w for _, w in MEDIANS]
    flat = spark.createDataFrame([(k, i, x) for k, (v, _) in enumerate(MEDIANS) for i, x in enumerate(v)], "k long, i long, x long").repartition(3)
    medians = columns.streaming_medians(flat, "k", "i", "x").orderBy("k", "i").collect()
    assert [r.median for r in medians] == [x for _, w in MEDIANS for x in w]


def test_runs_over_block_borders(spark):
    rows = [(i, c) for i, c in enumerate([1, 1, 1, 2, 2, 1, 1, 1, 1, 1, 3, 1])]
    found = intervals.runs(spark.createDataFrame(rows, "point_index long, cell long"), block=4)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2), (1, 5, 9), (1, 11, 11), (2, 3, 4), (3, 10, 10)]


def test_cells_and_bounds(spark):
    box = quadtree.Box(0.0, 0.0, 40.0, 40.0)
    rows = spark.createDataFrame([(30.0, 10.0), (10.0, 30.0), (-5.0, 50.0)], "x double, y double")
    assert [r.c for r in rows.select(quadtree.cell("x", "y", box, 1).alias("c")).collect()] == [2, 3, 3]
    assert quadtree.levels_for(box, 10.0) == 2 and quadtree.levels_for(None) == 4
    top = spark.range(3, 4).select(quadtree.cell_bounds("id", box).alias("b")).first().b
    assert tuple(top) == (0.0, 20.0, 20.0, 40.0)


def test_labels(spark):
    labels = [r.v for r in spark.range(25).select(columns.class_label("id").alias("v")).collect()]
    assert (labels[8], labels[12], labels[16], labels[22], labels[23:]) == ("Model key point", "Overlap points", "Wire structure connector", "Temporal exclusion", [None, None])
    texts = spark.createDataFrame([(0,), (1,), (17,)], "f int").select(columns.encoding_text("f").alias("v")).collect()
    assert [r.v for r in texts] == ["", "GPS time", "GPS time, WKT"]


def test_borders_by_added_halves(spark):
    """Middle lines lie at the lower border plus halved sizes, whatever averages of borders would give."""
    rng = np.random.default_rng(4)
    box = quadtree.Box(*(float(np.float32(v)) for v in (0.1, -3.3, 1234.7, 88.9)))

    def by_hand(x, y, levels):
        lx, ly, sx, sy, path = box.min_x, box.min_y, box.max_x - box.min_x, box.max_y - box.min_y, 0
        for _ in range(levels):
            sx, sy = sx / 2, sy / 2
            right, top = x >= lx + sx, y >= ly + sy
            lx, ly, path = lx + sx * right, ly + sy * top, path * 4 + right + 2 * top
        return path + quadtree.offset(levels), (lx, lx + sx, ly, ly + sy)

    places = [(float(x), float(y)) for x, y in zip(rng.uniform(0, 1300, 200), rng.uniform(-5, 90, 200), strict=True)]
    places += [(by_hand(x, y, 16)[1][0], by_hand(x, y, 12)[1][2]) for x, y in places]
    rows = spark.createDataFrame(places, "x double, y double").select("x", "y", quadtree.cell("x", "y", box, 15).alias("c")).withColumn("b", quadtree.cell_bounds("c", box)).collect()
    assert [(r.c, tuple(r.b)) for r in rows] == [by_hand(r.x, r.y, 15) for r in rows]
    assert rows[0].c != 0 and spark.range(1).select(quadtree.cell(F.lit(1.0), F.lit(1.0), box, 9, 2).alias("c")).first().c == by_hand(1.0, 1.0, 2)[0]


def test_running_sums(spark):
    rows = spark.createDataFrame([(i * i, i % 5) for i in range(50)], "k long, v long").repartition(4)
    got = intervals.previous(intervals.running(rows, "k", "v", "before", 100), "k", "v", "last", 100).orderBy("k").collect()
    assert [r.before for r in got] == [sum(j % 5 for j in range(i)) for i in range(50)] and [r.last for r in got] == [(i - 1) % 5 if i else 0 for i in range(50)]
    chunks = spark.createDataFrame([(0, 0, 10), (1, 10, 5), (2, 15, 0), (3, 15, 85)], "chunk_id long, first_point long, n_points long")
    wanted = spark.createDataFrame([(9, 10), (14, 14), (200, 300)], "start long, end long")
    assert sorted(r.chunk_id for r in intervals.chunks_meeting(wanted, chunks, 8).collect()) == [0, 1]


def test_empty_index(spark):
    none = spark.createDataFrame([], "point_index long, cell long")
    assert intervals.runs(none).count() == intervals.reordered(none).count() == 0
