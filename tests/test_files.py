"""Files: compressed ones, folders, indexes, conversion; the queries' results are in test_points."""

import dataclasses
import json
import os

import pytest
from pyspark.sql import functions as F

from pointmill.plans import convert
from pointmill.plans.points import points
from pointmill.sources import index as spatial
from pointmill.sources import las as source
from pointmill.sources import layout

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def las(spark):
    spark.dataSource.register(source.LasSource)
    return spark


def write(df, path, **options):
    df.write.format("las").options(**options).mode("overwrite").save(path)
    return path


@pytest.fixture(scope="module")
def laz(las, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('files')}/a.laz"
    return write(points(las, SF).orderBy("point_index").coalesce(1), path, format="1", compressed="true", chunk_size="300")


def test_partitions_are_pruned(las, laz):
    """Conditions on point_index and lists of chunks leave partitions unread."""
    table = convert.reader(las, laz, table="chunks").orderBy("chunk_id").collect()
    assert [(r.n_points, r.first_point) for r in table] == [(300, 0), (300, 300), (300, 600), (100, 900)]
    assert [r.compressed_offset for r in table][1:] == [r.compressed_offset + r.compressed_size for r in table][:-1]
    count = lambda df: df.rdd.getNumPartitions()
    whole = convert.reader(las, laz)
    assert (count(whole), count(whole.where("point_index = 650")), count(whole.where("point_index >= 299 AND point_index < 301")), count(whole.where("point_index IN (1, 999)"))) == (4, 1, 2, 2)
    assert [r.point_index for r in whole.where("point_index IN (1, 999)").orderBy("point_index").collect()] == [1, 999]
    assert count(convert.reader(las, laz, chunks="1")) == 1 and convert.reader(las, laz, chunks="9").count() == 0
    few = convert.reader(las, laz, columns="gps_time,x")
    assert few.columns == ["gps_time", "x"] and few.count() == 1000


def test_small_chunks_share_partitions(las, tmp_path):
    """A file of very many chunks has no more partitions than one of few; conditions and lists choose among its chunks as before."""
    path = write(points(las, SF).orderBy("point_index").coalesce(1), f"{tmp_path}/a.laz", format="1", compressed="true", chunk_size="2")
    whole = convert.reader(las, path)
    assert whole.rdd.getNumPartitions() == 250
    assert sorted(map(tuple, whole.select("point_index", "x", "gps_time").collect())) == sorted(map(tuple, points(las, SF).select("point_index", "x", "gps_time").collect()))
    few = whole.where("point_index >= 101 AND point_index < 105")
    assert few.rdd.getNumPartitions() == 3 and sorted(r.point_index for r in few.collect()) == [101, 102, 103, 104]
    listed = [k * 7 % 500 for k in range(600)]
    some = convert.reader(las, path, chunk_list=",".join(map(str, listed)))
    assert some.rdd.getNumPartitions() == 200
    assert sorted((r.position, r.point_index) for r in some.collect()) == [(2 * k + i, 2 * c + i) for k, c in enumerate(listed) for i in (0, 1)]


def test_converted_file_of_small_chunks(las, tmp_path):
    """A converted file of very many chunks holds the same points and is read by few partitions."""
    raw, packed = write(points(las, SF).orderBy("point_index").coalesce(1), f"{tmp_path}/a.las", format="1"), f"{tmp_path}/b.laz"
    convert.convert(las, raw, packed, chunk_size=2)
    read = convert.reader(las, packed)
    assert read.rdd.getNumPartitions() <= 256 and convert.reader(las, packed, table="chunks").count() >= 500
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, convert.reader(las, raw).collect()))


def test_shared_partitions():
    """In order, of one file, of CHUNK points at most; a larger one stays alone."""
    sizes = [(("a", "b")[k >= 700], 20_000 if k % 10 else 200_000) for k in range(1000)]
    got = source.shared([source.Range(p, 0, k, k + n) for k, (p, n) in enumerate(sizes)])
    assert [(r.path, r.last - r.first) for g in got for r in g.own] == sizes
    assert all({r.path for r in g.own} == {g.path} and (len(g.own) == 1 or sum(r.last - r.first for r in g.own) <= source.CHUNK) for g in got)
    assert max(len(g.own) for g in got) == 2 and [g.own for g in source.shared([])] == [[]]


def test_empty_and_bad_writes(las, tmp_path):
    path = f"{tmp_path}/e.laz"
    none = points(las, SF).limit(0)
    for options in ({"compressed": "true"}, {"compressed": "true", "parts": "true"}):
        write(none, path, format="6", **options)
        assert convert.reader(las, path).count() == 0 == convert.reader(las, path, table="chunks").count()
        assert convert.reader(las, path, table="header").first().n_points == 0
    nulls = las.createDataFrame([(1, None)], "x int, y int")
    for bad in ({"format": "4", "compressed": "true"}, {"format": "11"}):
        with pytest.raises(Exception):  # noqa: B017
            write(points(las, SF), f"{tmp_path}/b.laz", **bad)
    with pytest.raises(Exception, match="nulls"):
        write(nulls, f"{tmp_path}/n.las", format="0")
    assert not [f for f in os.listdir(tmp_path) if "parts-" in f and f.endswith(".las")]


def test_conversion(las, tmp_path):
    """Facts, records and points are kept; a new index replaces the old one; the order is that of cells."""
    a, b, c = (f"{tmp_path}/{n}" for n in ("a.las", "b.laz", "c.las"))
    head = {"source_id": 7, "global_encoding": 17, "project_id": "00112233445566778899aabbccddeeff", "system_id": "made up"}
    records = [{"user_id": "own", "record_id": 1, "payload": "YWI="}, {"user_id": "own", "record_id": 2, "payload": "eHl6", "extended": True}]
    rows = points(las, SF).orderBy("point_index")
    write(rows, a, format="1", header=json.dumps(head), records=json.dumps(records), scale_x="0.5", offset_y="10", wkt="W", wkt_math="M")
    convert.convert(las, a, b, add_index=True, chunk_size=100, tile=500.0)
    new = convert.convert(las, b, c, add_index=True)
    assert {k: new[k] for k in head} == head and new["n_evlrs"] == 2 and not new["compressed"]
    found = convert.reader(las, c, table="vlr").collect()
    assert [(r.kind, r.user_id, bytes(r.payload)) for r in found if r.user_id == "own"] == [("vlr", "own", b"ab"), ("evlr", "own", b"xyz")]
    assert [r.user_id for r in found].count(spatial.USER) == 1
    assert tuple(convert.reader(las, c, table="wkt").select("math", "coordinate").first()) == ("M", "W")
    fields = ["x", "y", "z", "gps_time", "intensity"]
    key = lambda df: sorted(map(tuple, df.select(fields).collect()))
    assert key(convert.reader(las, b)) == key(convert.reader(las, c)) == key(rows)
    index = convert.reader(las, b, table="index").orderBy("cell").collect()
    assert sum(r.number_points for r in index) == 1000 and [r.intervals[0].start for r in index] == sorted(r.intervals[0].start for r in index)
    world = (500.0, 0.0, 3000.0, 90000.0)
    want = sum(world[0] <= r.x * 0.5 <= world[2] and world[1] <= r.y * 0.001 + 10 <= world[3] for r in rows.collect())
    got = convert.box_query(las, b, world)
    assert got.count() == want > 0 and got.rdd.getNumPartitions() <= 10


INDEX = spatial.Index(5, 1.0, 3.0, 2.0, 4.0, {341: [(0, 4), (9, 9)], 400: [(5, 8)]})


def test_index_bytes():
    assert spatial.parsed(INDEX.payload()) == INDEX
    assert len(INDEX.payload()) == 4 + 4 + 44 + 12 + 2 * 12 + 3 * 8
    good = INDEX.payload()
    for bad in (dataclasses.replace(INDEX, levels=17), dataclasses.replace(INDEX, min_x=9.0), dataclasses.replace(INDEX, min_y=9.0), dataclasses.replace(INDEX, cells={341: [(4, 3)]})):
        with pytest.raises(ValueError):
            spatial.parsed(bad.payload() if bad.cells.get(341) != [(4, 3)] else good[:64] + b"\x55\x01\0\0\1\0\0\0\0\0\0\0\4\0\0\0\3\0\0\0")
    points_off = bytearray(good)
    points_off[64 + 8] += 1
    twice = bytearray(good)
    twice[64 + 12 + 16 : 64 + 12 + 16 + 4] = good[64:68]
    for bad in (b"", good[:-1], b"X" + good[1:], bytes(points_off), bytes(twice)):
        with pytest.raises(ValueError):
            spatial.parsed(bad)


def test_index_in_sidecar(las, tmp_path):
    """An index in the file comes before a sidecar; a damaged one of either kind counts as none."""
    path, other = f"{tmp_path}/s.las", dataclasses.replace(INDEX, levels=3)
    rows = points(las, SF).limit(20)
    table = lambda: {(r.source, r.levels) for r in convert.reader(las, path, table="index").collect()}
    write(rows, path, format="0")
    assert table() == set()
    (tmp_path / "s.lax").write_bytes(other.payload())
    assert table() == {("sidecar", 3)}
    import base64

    own = lambda p: json.dumps([{"user_id": spatial.USER, "record_id": spatial.NUMBER, "payload": base64.b64encode(p).decode(), "extended": True}])
    write(rows, path, format="0", records=own(INDEX.payload()))
    assert table() == {("evlr", 5)}
    write(rows, path, format="0", records=own(b"damaged"))
    assert table() == {("sidecar", 3)}
    (tmp_path / "s.lax").write_bytes(b"damaged")
    assert table() == set()


def test_records():
    with pytest.raises(ValueError):
        layout.geo_keys(b"\1\0\1\0\0\0\2\0" + bytes(8))
    with pytest.raises(ValueError):
        layout.geo_keys(b"\1\0\1\0\0\0\1\0" + b"\1\4\xb0\x87\5\0\0\0", b"", b"")
    two = [{"user_id": layout.PROJECTION, "record_id": layout.MATH_WKT, "payload": b"x"}] * 2
    with pytest.raises(ValueError):
        source.wkt_of(two)
    assert source.wkt_of([{"user_id": layout.PROJECTION, "record_id": layout.COORDINATE_WKT, "payload": b"abc"}]) == (None, "abc")


def test_generated(las, tmp_path):
    rows = convert.generated(las, 5000)
    assert rows.count() == 5000 and rows.where("return_number > number_of_returns OR return_number < 1 OR number_of_returns > 5").count() == 0
    assert convert.generated(las, 5000).exceptAll(rows).count() == 0
    path = write(rows.orderBy("point_index"), f"{tmp_path}/g.laz", format="1", compressed="true", chunk_size="1000", scale_x="0.01")
    assert convert.reader(las, path).join(rows.select("point_index", F.col("x").alias("wx")), "point_index").where("x <> wx").count() == 0
