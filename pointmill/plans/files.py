"""Queries that write the `points` view as a file and read it again; their SQL is the view itself."""

from __future__ import annotations

import base64
import json
import re
import struct
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions import records
from pointmill.operators.intervals import largest_batch as largest
from pointmill.plans import convert, spatial
from pointmill.plans.points import CHUNK, POINTS_SQL, points
from pointmill.sources import blobs, layout, onefile
from pointmill.sources.las import LasSource


def _path(spark: SparkSession, end: str = "las") -> str:
    """A new file in the folder that driver and executors share; a temporary one where none is set and one machine does all (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pointmill-")
    return f"{folder.removeprefix('file://').removeprefix('file:').rstrip('/')}/{uuid.uuid4().hex}.{end}"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as records hold them: a user's number is wider than the 16 bits of point_source_id, the rest goes into user_data.

    Both have 24 bits with a sign; users whose y fits its field need 23.
    """
    user = F.col("point_source_id")
    return points(spark, sf_dir).withColumns({"point_source_id": user.bitwiseAND(0xFFFF), "user_data": F.shiftright(user, 16).bitwiseAND(0xFF)})


def _whole(stored: DataFrame, fmt: int) -> DataFrame:
    """The columns that points and a format share, users' numbers joined again."""
    high = F.when(F.col("user_data") < 128, F.col("user_data")).otherwise(F.col("user_data") - 256)
    return stored.select(*((high * 65536 + F.col(c)).alias(c) if c == "point_source_id" else c for c in shared_columns(fmt)))


def written(spark: SparkSession, sf_dir: str, fmt: int, end: str = "las", **options: str) -> str:
    spark.dataSource.register(LasSource)
    path = _path(spark, end)
    onefile.write(_stored(spark, sf_dir).orderBy("point_index"), path, **{"format": str(fmt), "wkt": "TEST WKT"} | options)
    return path


def _compressed(spark: SparkSession, sf_dir: str, fmt: int, **options: str) -> str:
    return written(spark, sf_dir, fmt, "laz", compressed="true", chunk_size=str(CHUNK), **options)


def shared_columns(fmt: int) -> list[str]:
    own = ["point_index", "x", "y", "z", "intensity", "return_number", "number_of_returns", "classification", "point_source_id", "gps_time", "red", "green", "blue", "nir"]
    return [c for c in own if c in layout.schema(fmt).names]


def _round_trip(fmt: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _whole(convert.reader(spark, written(spark, sf_dir, fmt)), fmt)

    return query


def header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written(spark, sf_dir, 1)
    table = spark.read.format("las").option("table", "header").load(path)
    return table.selectExpr("version", "format", "record_length", "n_points", "n_vlrs", "by_return[0] AS first_returns")


def wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coordinate system's text: of record 2112, without its closing zeros."""
    table = spark.read.format("las").option("table", "vlr").load(written(spark, sf_dir, 0))
    return table.where("user_id = 'LASF_Projection' AND record_id = 2112").selectExpr("rtrim(char(0), decode(payload, 'UTF-8')) AS wkt")


def _compressed_round_trip(fmt: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _whole(convert.reader(spark, _compressed(spark, sf_dir, fmt)), fmt)

    return query


def folder_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of compressed files, one of each writing task, whose points count on from file to file."""
    path = _path(spark, "parts")
    p = _stored(spark, sf_dir).repartitionByRange(4, "point_index").sortWithinPartitions("point_index")
    spark.dataSource.register(LasSource)
    p.write.format("las").option("format", 3).option("compressed", "true").option("chunk_size", str(CHUNK)).option("parts", "true").mode("overwrite").save(path)
    return _whole(convert.reader(spark, path), 3)


def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of listed chunks only; no other partition is made."""
    return convert.reader(spark, _compressed(spark, sf_dir, 1), chunks="0,1").select("point_index", "x", "gps_time")


def chunk_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of chunks as stored: places follow from sizes."""
    path = written(spark, sf_dir, 0)
    return convert.reader(spark, path, table="chunks").select("chunk_id", "n_points", "first_point", "compressed_size")


def codec_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _compressed(spark, sf_dir, 3)
    return convert.reader(spark, path, table="items").select("compressor", "ordinal", "item_type", "item_size", "item_version")


def _records(*rows: tuple[str, int, bytes, bool]) -> str:
    return json.dumps([{"user_id": u, "record_id": n, "description": f"record {n}", "payload": base64.b64encode(p).decode(), "extended": e} for u, n, p, e in rows])


def vlr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and extended records with their kinds."""
    path = written(spark, sf_dir, 1, records=_records(("LASF_Spec", 3, b"some text", False), ("LASF_Spec", 100, b"", False), ("own", 7, b"long", True), ("LASF_Spec", 65535, b"wave", True)))
    table = convert.reader(spark, path, table="vlr").withColumn("kinds", F.array_join(convert.record_kinds(), ","))
    return table.select("kind", "ordinal", "user_id", "record_id", "length", "description", F.rtrim(F.decode("payload", "UTF-8"), F.char(F.lit(0))).alias("payload"), "kinds")


def geo_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 2, 2057, layout.DOUBLES, 2, 1, 1026, layout.TEXT, 5, 3)
    own = _records(*((layout.PROJECTION, n, p, False) for n, p in ((layout.DIRECTORY, directory), (layout.DOUBLES, struct.pack("<3d", 0.5, 6378137.0, 2.25)), (layout.TEXT, b"ab|WGS84|"))))
    table = convert.reader(spark, written(spark, sf_dir, 0, records=own), table="geo_keys")
    return table.select("key", "short_value", F.get("double_values", F.lit(0)).alias("first_double"), F.size(F.coalesce("double_values", F.array())).alias("n_doubles"), "ascii_value")


def extra_bytes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 16-bit values as extra bytes of compressed records."""
    spark.dataSource.register(LasSource)
    path = _path(spark, "laz")
    two = lambda c: F.concat(F.lpad(F.hex(F.col(c) % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col(c) / 256)), 2, "0"))
    p = _stored(spark, sf_dir).withColumn("extra_bytes", F.unhex(F.concat(two("red"), two("nir"))))
    onefile.write(p.orderBy("point_index"), path, format="6", extrabytes="4", compressed="true", chunk_size=str(CHUNK))
    value = lambda at: F.conv(F.concat(F.hex(F.substring("extra_bytes", at + 1, 1)), F.hex(F.substring("extra_bytes", at, 1))), 16, 10).cast("long")
    return convert.reader(spark, path).select("point_index", value(1).alias("red"), value(3).alias("nir"))


def _indexed(spark: SparkSession, sf_dir: str) -> str:
    """The points in the order of their cells, with an index; raw units are the world's."""
    source, target = written(spark, sf_dir, 1, scale_x="1", scale_y="1", scale_z="1"), _path(spark, "laz")
    convert.convert(spark, source, target, add_index=True, chunk_size=CHUNK, levels=spatial.LEVEL)
    return target


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and runs of the index that a converted file carries."""
    table = convert.reader(spark, _indexed(spark, sf_dir), table="index")
    return table.select("cell", "number_points", F.explode("intervals").alias("i")).select("cell", "number_points", F.col("i.start").alias("first_point"), F.col("i.end").alias("last_point"))


def box_query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box query on a file: only chunks that the index lists are read."""
    return convert.box_query(spark, _indexed(spark, sf_dir), spatial.QUERY_BOX).select("x", "y", "z", "gps_time")


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed file made of a raw one: the same points in the same order."""
    source, target = written(spark, sf_dir, 3), _path(spark, "laz")
    convert.convert(spark, source, target, chunk_size=CHUNK)
    return _whole(convert.reader(spark, target), 3)


def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed file read as bytes by Spark, as from a store that only Spark reads."""
    return _whole(blobs.read(spark, f"file://{_compressed(spark, sf_dir, 1)}", 1), 1)


def store_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed file by its URI: header, records and table of chunks first, then one range of bytes a partition."""
    return _whole(convert.reader(spark, f"file://{_compressed(spark, sf_dir, 6)}"), 6)


LISTED, LISTED_CHUNK = (7, 0, 7), 100


def chunk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed chunks in the list's order, one of them twice, with each point's place in the output."""
    path = written(spark, sf_dir, 1, "laz", compressed="true", chunk_size=str(LISTED_CHUNK))
    return convert.reader(spark, path, chunk_list=",".join(map(str, LISTED))).select("position", "point_index", "x", "gps_time")


#: Takes core10 as it is, GPS time under another name, and of the colours what its hook makes of them.
GRADED = records.UserRecord("graded", {"measured": ("f8", 0.0), "shade": ("u2", 9)}, ("core10", "gps"), {"gps": {"measured": "gps_time"}}, {"rgb": lambda p: {"shade": p["red"] % 1000}})


def user_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of format 3 as records of format 1 and two fields of their own, written and read again by their description."""
    rows = records.stored(records.mapped(convert.reader(spark, written(spark, sf_dir, 3)), GRADED).orderBy("point_index"), GRADED)
    path = _path(spark)
    onefile.write(rows, path, format="1", extrabytes=str(records.size(GRADED)), records=_records(("LASF_Spec", 4, records.description(GRADED), False)))
    payload = convert.reader(spark, path, table="vlr").where(convert.RECORD_KINDS["extra_bytes"]).select("payload").first()[0]
    return records.unpacked(convert.reader(spark, path), records.described(bytes(payload))).select("point_index", "x", "y", "z", "intensity", "return_number", "classification", "gps_time", "measured", "shade")


BATCH_CHUNKS = 3


def largest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of consecutive chunks that needs the largest buffer."""
    path = written(spark, sf_dir, 1, "laz", compressed="true", chunk_size="170")
    return largest(convert.reader(spark, path, table="chunks"), BATCH_CHUNKS)


def foreign_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of another program's interface, with values wider than their fields, as records of format 7, written and read again."""
    e = F.col("point_index")
    wide = points(spark, sf_dir).select(
        e, F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"), "intensity", (e % 300).alias("extended_return_number"), (e % 77).alias("extended_number_of_returns"), (e % 40).alias("extended_classification_flags"),
        (e % 9).alias("extended_scanner_channel"), (e % 2).alias("scan_direction_flag"), (e % 3 % 2).alias("edge_of_flight_line"), F.col("classification").alias("extended_classification"), (e % 1000).alias("user_data"),
        (e * 3 - 40000).alias("extended_scan_angle"), F.col("point_source_id").alias("point_source_ID"), "gps_time", F.array("red", "green", "blue").alias("rgb"),
    )
    path = _path(spark)
    onefile.write(records.from_foreign(wide, 7).orderBy("point_index"), path, format="7")
    return convert.reader(spark, path).select("point_index", "x", "y", "z", "return_number", "number_of_returns", "classification_flags", "scanner_channel", "classification", "user_data", "scan_angle", "point_source_id", "gps_time", "blue")


QUERIES = {**{f"las_roundtrip_pf{k}": _round_trip(k) for k in range(11)}, "header_scan": header_scan, "wkt": wkt}
COMPRESSED = (0, 1, 2, 3, 6, 7, 8)
QUERIES |= {f"laz_roundtrip_pf{k}": _compressed_round_trip(k) for k in COMPRESSED}
QUERIES |= {f.__name__: f for f in (folder_roundtrip, chunk_scan, chunk_facts, codec_items, vlr_roundtrip, geo_keys, extra_bytes_roundtrip, index_roundtrip, box_query_file, converted, store_scan, store_ranges, chunk_list, user_record, largest_batch, foreign_points)}
ORACLES = {f"las_roundtrip_pf{k}": POINTS_SQL + f"SELECT {', '.join(shared_columns(k))} FROM points" for k in range(11)}
ORACLES |= {
    "header_scan": POINTS_SQL + "SELECT '1.4' AS version, 1 AS format, 28 AS record_length, count(*) AS n_points, CAST(1 AS BIGINT) AS n_vlrs, count(*) FILTER (WHERE return_number = 1) AS first_returns FROM points",
    "wkt": "SELECT 'TEST WKT' AS wkt",
}
ORACLES |= {f"laz_roundtrip_pf{k}": ORACLES[f"las_roundtrip_pf{k}"] for k in COMPRESSED}
ORACLES |= {
    "folder_roundtrip": ORACLES["las_roundtrip_pf3"],
    "converted": ORACLES["las_roundtrip_pf3"],
    "store_scan": ORACLES["las_roundtrip_pf1"],
    "store_ranges": ORACLES["las_roundtrip_pf6"],
    "largest_batch": POINTS_SQL + f"SELECT point_index // {170 * BATCH_CHUNKS} AS batch, count(*) AS n_points FROM points GROUP BY 1 ORDER BY n_points DESC, batch LIMIT 1",
    "foreign_points": POINTS_SQL + "SELECT point_index, x, y, z, point_index % 300 % 16 AS return_number, point_index % 77 % 16 AS number_of_returns, point_index % 40 % 16 AS classification_flags, point_index % 9 % 4 AS scanner_channel, classification, point_index % 1000 % 256 AS user_data, "
    "(point_index * 3 - 40000 + 32768 + 655360) % 65536 - 32768 AS scan_angle, point_source_id % 65536 AS point_source_id, gps_time, blue FROM points",
    "chunk_list": POINTS_SQL + f"SELECT k * {LISTED_CHUNK} + point_index % {LISTED_CHUNK} AS position, point_index, x, gps_time FROM points, (VALUES {', '.join(f'({k}, {c})' for k, c in enumerate(LISTED))}) t(k, c) WHERE point_index // {LISTED_CHUNK} = c",
    "user_record": POINTS_SQL + "SELECT point_index, x, y, z, intensity, return_number, classification, CAST(0 AS DOUBLE) AS gps_time, gps_time AS measured, red % 1000 AS shade FROM points",
    "chunk_scan": POINTS_SQL + f"SELECT point_index, x, gps_time FROM points WHERE point_index // {CHUNK} IN (0, 1)",
    "chunk_facts": POINTS_SQL + "SELECT CAST(0 AS BIGINT) AS chunk_id, count(*) AS n_points, CAST(0 AS BIGINT) AS first_point, count(*) * 20 AS compressed_size FROM points",
    "codec_items": "SELECT 2 AS compressor, * FROM (VALUES (0, 6, 20, 2), (1, 7, 8, 2), (2, 8, 6, 2)) t(ordinal, item_type, item_size, item_version)",
    "vlr_roundtrip": "SELECT kind, ordinal, user_id, record_id, CAST(length AS BIGINT) AS length, description, payload, kinds FROM (VALUES ('vlr', 0, 'LASF_Projection', 2112, 9, '', 'TEST WKT', 'projection,coordinate_wkt'), ('vlr', 1, 'LASF_Spec', 3, 9, 'record 3', 'some text', 'spec,text_area'), "
    "('vlr', 2, 'LASF_Spec', 100, 0, 'record 100', '', 'spec,waveform_descriptor'), ('evlr', 0, 'own', 7, 4, 'record 7', 'long', ''), ('evlr', 1, 'LASF_Spec', 65535, 4, 'record 65535', 'wave', 'spec,waveform_data')) t(kind, ordinal, user_id, record_id, length, description, payload, kinds)",
    "geo_keys": "SELECT key, short_value, CAST(first_double AS DOUBLE) AS first_double, n_doubles, ascii_value FROM (VALUES (1024, 2, NULL, 0, NULL), (1026, NULL, NULL, 0, 'WGS84'), (2057, NULL, 6378137.0, 2, NULL)) t(key, short_value, first_double, n_doubles, ascii_value)",
    "extra_bytes_roundtrip": POINTS_SQL + "SELECT point_index, red, nir FROM points",
    "index_roundtrip": spatial.CELLS + "SELECT cell, count(*) AS number_points, min(i) AS first_point, max(i) AS last_point FROM (SELECT cell, row_number() OVER (ORDER BY cell, point_index) - 1 AS i FROM cells) GROUP BY cell",
    "box_query_file": POINTS_SQL + "SELECT x, y, z, gps_time FROM points WHERE x BETWEEN {0} AND {2} AND y BETWEEN {1} AND {3}".format(*spatial.QUERY_BOX),
}
