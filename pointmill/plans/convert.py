"""Whole-file work: conversion with or without a new order by cell, box queries that read only listed chunks, generated points."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.operators import intervals as I
from pointmill.operators import quadtree as Q
from pointmill.sources import index as spatial
from pointmill.sources import onefile
from pointmill.sources.las import CHUNK, LasSource

#: Ranges of cells that a box is cut into at most; beyond, they hold more cells than the box.
RANGES = 10_000
#: Fields of the header that a conversion takes over, besides scale and offset.
KEPT = ["source_id", "global_encoding", "project_id", "system_id"]

# fixed values: records by user and number, as the published format names them
RECORD_KINDS = {
    "projection": "user_id = 'LASF_Projection'",
    "math_wkt": "user_id = 'LASF_Projection' AND record_id = 2111",
    "coordinate_wkt": "user_id = 'LASF_Projection' AND record_id = 2112",
    "geo_key_directory": "user_id = 'LASF_Projection' AND record_id = 34735",
    "geo_doubles": "user_id = 'LASF_Projection' AND record_id = 34736",
    "geo_ascii": "user_id = 'LASF_Projection' AND record_id = 34737",
    "spec": "user_id = 'LASF_Spec'",
    "classification_lookup": "user_id = 'LASF_Spec' AND record_id = 0",
    "text_area": "user_id = 'LASF_Spec' AND record_id = 3",
    "extra_bytes": "user_id = 'LASF_Spec' AND record_id = 4",
    "superseded": "user_id = 'LASF_Spec' AND record_id = 7",
    "waveform_descriptor": "user_id = 'LASF_Spec' AND record_id > 99 AND record_id < 355",
    "waveform_data": "user_id = 'LASF_Spec' AND record_id = 65535",
    "codec": "kind = 'vlr' AND reserved IN (0, 43707) AND user_id IN ('laszip encoded', 'LAZ encoded') AND record_id = 22204",
    "index": "user_id = 'LAStools' AND record_id = 30",
}


def reader(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The data source "las", with pushdown where the session allows it."""
    spark.dataSource.register(LasSource)
    allowed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("las").options(**{"pushdown": allowed} | options).load(path)


def record_kinds() -> Column:
    """The kinds that a row of the table vlr is of, as an array."""
    return F.array_compact(F.array(*(F.when(F.expr(test), F.lit(kind)) for kind, test in RECORD_KINDS.items())))


def index_of(points: DataFrame, box: Q.Box, levels: int) -> spatial.Index:
    """The index of points with cell and new_index, whose order is by cell: one run for each cell."""
    runs = points.groupBy("cell").agg(F.min("new_index").alias("a"), F.max("new_index").alias("b"))
    rows = runs.limit(spatial.MOST_CELLS + 1).collect()
    if len(rows) > spatial.MOST_CELLS:
        raise ValueError(f"an index holds {spatial.MOST_CELLS} cells at most; choose larger tiles")
    return spatial.Index(levels, box.min_x, box.max_x, box.min_y, box.max_y, {r.cell: [(r.a, r.b)] for r in rows})


def convert(spark: SparkSession, source: str, target: str, add_index: bool = False, compressed: bool | None = None, chunk_size: int = CHUNK, tile: float = 50.0, levels: int | None = None) -> dict:
    """Writes source's points, facts and records to target; with add_index in the order of quadtree cells, with a new index.

    compressed follows the target's name where it isn't given. The codec's record is left out, and the old index where
    there is a new one. Extra bytes are kept. Returns the header of the result; raises if counts, counts by return or the
    transform differ from the source's, or bounds are not within its bounds.
    """
    compressed = target.lower().endswith(".laz") if compressed is None else compressed
    head = reader(spark, source, table="header").first()
    left_out = ["codec"] + ["index"] * add_index
    kept = reader(spark, source, table="vlr").where(~F.exists(record_kinds(), lambda k: k.isin(left_out))).collect()
    records = [{"user_id": r.user_id, "record_id": r.record_id, "description": r.description, "payload": base64.b64encode(r.payload).decode(), "extended": r.kind == "evlr"} for r in kept]
    points = reader(spark, source)
    columns = [c for c in points.columns if c != "point_index"]
    if add_index:
        at = lambda a: F.col(a) * F.lit(head[f"scale_{a}"]) + F.lit(head[f"offset_{a}"])
        box = Q.box_of(points.select(at("x").alias("x"), at("y").alias("y"))) or Q.Box(0.0, 0.0, 0.0, 0.0)
        levels = Q.levels_for(box, tile) if levels is None else levels
        points = I.reordered(points.withColumn("cell", Q.cell(at("x"), at("y"), box, levels)))
        index = index_of(points, box, levels)
        records.append({"user_id": spatial.USER, "record_id": spatial.NUMBER, "description": "spatial index", "payload": base64.b64encode(index.payload()).decode(), "extended": True})
    order = "new_index" if add_index else "point_index"
    options = {"format": head.format, "extrabytes": head.extra_bytes, "compressed": str(compressed).lower(), "chunk_size": chunk_size, "records": json.dumps(records), "header": json.dumps({k: head[k] for k in KEPT})}
    options |= {f"{k}_{a}": repr(head[f"{k}_{a}"]) for k in ("scale", "offset") for a in "xyz"}
    onefile.write(points.orderBy(order).select(*columns), target, **options)
    new = reader(spark, target, table="header").first()
    same = ["n_points", *(f"{k}_{a}" for k in ("scale", "offset") for a in "xyz")]
    inside = all(head[f"min_{a}"] <= new[f"min_{a}"] and new[f"max_{a}"] <= head[f"max_{a}"] for a in "xyz")
    counts = [r for r in head.by_return if r], [r for r in new.by_return if r]
    if any(head[k] != new[k] for k in same) or counts[0] != counts[1] or not (inside or not new.n_points):
        raise ValueError("the converted file differs from its source")
    return new.asDict()


def box_query(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """The points of a file within a box (min_x, min_y, max_x, max_y): index, runs of the cells that meet the box, the chunks
    that hold these, and only their partitions are read; all chunks where the file has no index."""
    ax, ay, bx, by = box
    head = reader(spark, path, table="header").first()
    at = lambda a: F.col(a) * F.lit(head[f"scale_{a}"]) + F.lit(head[f"offset_{a}"])
    inside = at("x").between(ax, bx) & at("y").between(ay, by)
    stored = reader(spark, path, table="index")
    one = stored.select("levels", "min_x", "min_y", "max_x", "max_y").first()
    if one is None:
        return reader(spark, path).where(inside)
    first, last = Q.leaves_of("cell", one.levels)
    spans = stored.select(first.alias("first"), last.alias("last"), "intervals")
    ranges = Q.cell_ranges(Q.Box(ax, ay, bx, by), Q.Box(one.min_x, one.min_y, one.max_x, one.max_y), one.levels, RANGES)
    runs = Q.meeting(spans, ranges, one.levels, "first", "last").select(F.explode("intervals").alias("i")).select("i.*")
    # numbers of chunks: a file of a table of chunks holds few
    wanted = I.chunks_meeting(runs, reader(spark, path, table="chunks")).collect()
    return reader(spark, path, chunks=",".join(str(r.chunk_id) for r in sorted(wanted)) or "-1").where(inside)


def generated(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n made-up points of format 1 in order: places within 1e6 of zero, returns 1 to 5, GPS time a thousandth a point."""
    draw = lambda k, m: F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(m))
    place = lambda k: (draw(k, 200_000_001) - 100_000_000).cast("int")  # noqa: E731  hundredths
    returns = draw(4, 5) + 1
    return spark.range(n).select(
        F.col("id").alias("point_index"), place(1).alias("x"), place(2).alias("y"), place(3).alias("z"), draw(5, 65536).cast("int").alias("intensity"), (F.pmod(draw(6, 5), returns) + 1).cast("short").alias("return_number"),
        returns.cast("short").alias("number_of_returns"), draw(7, 23).cast("short").alias("classification"), draw(8, 65536).cast("int").alias("point_source_id"), (F.col("id") * 0.001).alias("gps_time"),
    )
