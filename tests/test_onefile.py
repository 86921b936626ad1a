"""One file placed by tasks: the same bytes as joined on the driver, stage order, a stop in between; files by URI; ordered chunk lists."""

import base64
import io
import json
import os

import pytest
from pyspark.sql.datasource import EqualTo, In

from pointmill.plans import convert
from pointmill.plans.points import points
from pointmill.sources import las as source
from pointmill.sources import layout, onefile

SF = "/root/testdata/sf0.001"
KINDS = [{"format": "3"}, {"format": "7", "compressed": "true", "chunk_size": "90", "wkt": "W"}]


@pytest.fixture(scope="module")
def las(spark):
    spark.dataSource.register(source.LasSource)
    return spark


def rows(las):
    return points(las, SF).repartitionByRange(5, "point_index").sortWithinPartitions("point_index")


@pytest.mark.parametrize("options", KINDS)
def test_same_bytes(las, tmp_path, options, monkeypatch):
    """Many small pieces, and what was there before gives way, a folder too."""
    monkeypatch.setattr(onefile, "PIECE", 1000)
    a, b = f"{tmp_path}/a.las", f"{tmp_path}/b.las"
    rows(las).write.format("las").options(**options).mode("overwrite").save(a)
    os.makedirs(f"{b}/old")
    for _ in range(2):
        one = onefile.write(rows(las), f"file://{b}", **options)
        with open(a, "rb") as x, open(b, "rb") as y:
            assert x.read() == y.read()
    assert len(one.pieces) > 20 and sorted(os.listdir(tmp_path)) == ["a.las", "b.las"]


def test_the_driver_writes_the_frame_only(las, tmp_path):
    few, many = (onefile.write(rows(las).limit(n), f"{tmp_path}/{n}.las", format="3") for n in (10, 1000))
    assert few.framed == many.framed < 500 < 34 * 1000


def test_no_points(las, tmp_path):
    for k, options in enumerate(KINDS):
        path = f"{tmp_path}/{k}.las"
        onefile.write(rows(las).limit(0), path, **options)
        assert convert.reader(las, path).count() == 0 == convert.reader(las, path, table="header").first().n_points


def test_order_of_stages(las, tmp_path):
    one = onefile.OneFile(f"{tmp_path}/a.las", format="1")
    for early in (one.reserve, lambda: one.place(las), one.finish):
        with pytest.raises(ValueError, match="new"):
            early()
    one.stage(rows(las))
    with pytest.raises(ValueError, match="staged"):
        one.stage(rows(las))
    with pytest.raises(ValueError, match="staged"):
        one.finish()
    one.reserve()
    with pytest.raises(ValueError, match="reserved"):
        one.finish()
    assert not os.path.exists(f"{tmp_path}/a.las")
    one.place(las).finish()
    assert convert.reader(las, f"{tmp_path}/a.las").count() == 1000
    with pytest.raises(ValueError, match="finished"):
        one.finish()


def test_a_stop_in_between(las, tmp_path, monkeypatch):
    """The old file stays and nothing else is left; a part that was cut short is noticed."""
    path = f"{tmp_path}/a.las"
    onefile.write(rows(las).limit(7), path, format="1")

    def cut(self):
        with open(self.parts[1].path, "r+b") as f:
            f.truncate(10)
        return self.place_all(las)

    monkeypatch.setattr(onefile.OneFile, "place_all", onefile.OneFile.place, raising=False)
    monkeypatch.setattr(onefile.OneFile, "place", lambda self, spark: cut(self))
    with pytest.raises(Exception, match="ends before its size"):
        onefile.write(rows(las), path, format="1")
    assert convert.reader(las, path).count() == 7 and os.listdir(tmp_path) == ["a.las"]
    with pytest.raises(Exception, match="nulls"):
        onefile.write(las.sql("SELECT 1 AS x, cast(NULL AS int) AS y"), path, format="1")
    assert convert.reader(las, path).count() == 7 and os.listdir(tmp_path) == ["a.las"]


@pytest.mark.parametrize("options", KINDS)
def test_uris(las, tmp_path, options):
    """A file and a folder by URI: points, facts, pruned chunks, a sidecar's index; a place without a file raises."""
    path = f"{tmp_path}/a.laz"
    onefile.write(rows(las), path, **options)
    for at in (f"file://{path}", f"file://{tmp_path}"):
        read = convert.reader(las, at)
        assert sorted(r.point_index for r in read.select("point_index").collect()) == list(range(1000))
        assert convert.reader(las, at, table="header").first().n_points == 1000
    assert convert.reader(las, f"file://{path}").rdd.getNumPartitions() == (15 if "compressed" in options else 1)
    with open(f"{tmp_path}/a.lax", "wb") as f:
        f.write(source.spatial.Index(2, 0.0, 1.0, 0.0, 1.0, {5: [(0, 999)]}).payload())
    assert convert.reader(las, f"file://{path}", table="index").first().cell == 5
    with pytest.raises(Exception):  # noqa: B017
        convert.reader(las, f"file://{tmp_path}/none.las").count()


def test_chunk_lists(las, tmp_path):
    """Positions follow the list; a raw file is one chunk; a number beyond the table raises; an empty list gives nothing."""
    path, raw = f"{tmp_path}/a.laz", f"{tmp_path}/a.las"
    onefile.write(rows(las).coalesce(1), path, format="1", compressed="true", chunk_size="300")
    onefile.write(rows(las), raw, format="1")
    got = convert.reader(las, path, chunk_list="3,0,3", columns="point_index").collect()
    assert [(r.position, r.point_index) for r in got] == list(enumerate([*range(900, 1000), *range(300), *range(900, 1000)]))
    twice = convert.reader(las, raw, chunk_list="0,0", columns="x,point_index").where("position >= 1000").collect()
    assert [r.position - r.point_index for r in twice] == [1000] * 1000
    assert convert.reader(las, path, chunk_list="").count() == 0
    for bad in ("4", "0,-1"):
        with pytest.raises(Exception, match="chunk"):
            convert.reader(las, path, chunk_list=bad).count()


class Counted(io.BytesIO):
    done = 0

    def read(self, n=-1):
        out = super().read(n)
        self.done += len(out)
        return out


def test_payloads_are_left_unread(las, tmp_path):
    """Bytes read don't grow with payloads that nothing asks for; pushed conditions choose the payloads."""
    path = f"{tmp_path}/a.las"
    big = base64.b64encode(bytes(60_000)).decode()
    records = [{"user_id": "own", "record_id": k, "payload": big, "extended": k > 1} for k in range(4)]
    onefile.write(rows(las), path, format="1", wkt="W", records=json.dumps(records))
    with open(path, "rb") as f:
        file = Counted(f.read())
    head = layout.read_header(file)
    file.done = 0
    got = layout.read_vlrs(file, head, lambda r: r["user_id"] != "own")
    assert file.done < 500 and [r["payload"] and len(r["payload"]) for r in got] == [2, None, None, None, None] and len({r["payload_offset"] for r in got}) == 5
    table = lambda **options: convert.reader(las, path, table="vlr", **options)
    assert [r.payload for r in table(payloads="false").collect()] == [None] * 5
    some = table().where("user_id = 'own' AND record_id IN (1, 3)").collect()
    assert [(r.kind, r.record_id, len(r.payload)) for r in some] == [("vlr", 1, 60_000), ("evlr", 3, 60_000)]
    facts = source.PrunedFacts(path, "vlr", source.T.StructType(), True)
    list(facts.pushFilters([EqualTo(("user_id",), "own"), In(("record_id",), (1, 3))]))
    assert [facts._wants(r) for r in got] == [False, False, True, False, True]
    assert table().count() == 5 == len([r for r in table(pushdown="false").collect() if r.payload])
