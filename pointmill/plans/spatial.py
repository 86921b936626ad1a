"""Queries on fields, cells, runs and orders of the `points` view, each with its SQL equivalent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointmill.codec.items import RETURNS8
from pointmill.functions import columns as C
from pointmill.operators import checks
from pointmill.operators import intervals as I
from pointmill.operators import quadtree as Q
from pointmill.operators.reduce import Bounds, reduce
from pointmill.plans.points import CHUNK, POINTS_SQL, points

LEVEL = 5
#: Cells of fewer points are not stored in the index that the lookup queries use.
LEAST = 3
QUERY_BOX = (1000, 20000, 9000, 80000)  # min_x, min_y, max_x, max_y


def _celled(spark: SparkSession, sf_dir: str, level: int = LEVEL) -> tuple[DataFrame, Q.Box]:
    p = points(spark, sf_dir)
    box = Q.box_of(p) or Q.Box(0.0, 0.0, 0.0, 0.0)
    return p.withColumn("cell", Q.cell("x", "y", box, level)), box


def bounds_negative_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = points(spark, sf_dir).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    a, b = (F.col(c) * F.lit(-0.01) + F.lit(5.0) for c in "ab")
    return ends.select(F.least(a, b).alias("min_x"), F.greatest(a, b).alias("max_x"))


def legacy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit counts, total and by the first five returns: zero for formats from 6 on and for 2^32 - 1 points or more."""
    counted = points(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("return_number") == r).alias(f"r{r}") for r in range(1, 6)))
    formats = spark.range(11).select(F.col("id").alias("format"))
    fits = (F.col("format") < 6) & (F.col("n") < 2**32 - 1)
    return formats.join(F.broadcast(counted)).select("format", *(F.when(fits, F.col(c)).otherwise(0).alias(f"legacy_{c}") for c in ("n", "r1", "r2", "r3", "r4", "r5")))


def classification_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("classification").agg(F.count(F.lit(1)).alias("n_points")).select(C.class_label("classification").alias("label"), "n_points")


def unpack_bit_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = points(spark, sf_dir).select("point_index", C.packed(("return_number", 0), ("number_of_returns", 3)).alias("b"))
    return byte.select("point_index", C.bits("b", 0, 3).alias("return_number"), C.bits("b", 3, 3).alias("number_of_returns"))


def pack_core14_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("point_index")
    return points(spark, sf_dir).select("point_index", C.packed((e % 16, 0), (e % 4, 4), (e % 2, 6), (F.floor(e / 2) % 2, 7)).alias("flags"))


def box_filter_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("x BETWEEN 1000 AND 5000 AND y BETWEEN 0 AND 500000 AND z BETWEEN -1000 AND 1000").select("point_index", "x", "y", "z")


def custom_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("x", "y", "z", "gps_time")


def colour_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("point_index", *(C.bits(c, at, 8).alias(f"{c}_{n}") for c in ("red", "green", "blue") for n, at in (("lo", 0), ("hi", 8))))


def record_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to the record before, within a chunk; a chunk's first record stands for itself and has none."""
    before = Window.partitionBy("chunk_id").orderBy("point_index")
    p = points(spark, sf_dir).withColumn("chunk_id", F.floor(F.col("point_index") / CHUNK))
    return p.select("point_index", *((F.col(c).cast("long") - F.lag(c).over(before)).alias(f"d{c}") for c in "xy"))


def quadtree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = Q.box_of(points(spark, sf_dir))
    return spark.range(3).select((F.lit(50.0) * F.pow(F.lit(10.0), "id")).alias("tile"), F.element_at(F.array(*(F.lit(Q.levels_for(box, 50.0 * 10**k)) for k in range(3))), F.col("id").cast("int") + 1).alias("levels"))


def quadtree_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _celled(spark, sf_dir)[0].select("point_index", "cell")


def cell_at_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _celled(spark, sf_dir, 2)[0].select("point_index", "cell")


def cell_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _celled(spark, sf_dir)[0].select("cell").distinct()
    up = cells.select(F.explode(F.array(*(Q.ancestor("cell", LEVEL, k) for k in range(LEVEL + 1)))).alias("cell")).distinct()
    return up.select("cell", Q.level_of("cell").alias("level"))


def cell_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, box = _celled(spark, sf_dir)
    return p.select("cell").distinct().select("cell", Q.cell_bounds("cell", box).alias("b")).select("cell", "b.*")


def cell_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _celled(spark, sf_dir)[0].groupBy("cell").agg(F.count(F.lit(1)).alias("n_points"))


def cell_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.runs(_celled(spark, sf_dir)[0]).select("cell", F.col("start").alias("first_point"), F.col("end").alias("last_point"))


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_cell = I.runs(_celled(spark, sf_dir)[0]).groupBy("cell").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("end") - F.col("start") + 1).alias("n"))
    n = F.count(F.lit(1))
    return by_cell.agg(n.alias("n_cells"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_intervals"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_points"), F.when(n > 0, F.sum("k") / n).otherwise(0.0).alias("mean_intervals"))


def _stored(p: DataFrame) -> DataFrame:
    return p.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select("cell")


def find_cell_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's deepest stored cell, of leaves with LEAST points or more and cells of level 2 with an even number."""
    p = _celled(spark, sf_dir)[0].select("point_index", "cell")
    upper = p.select(Q.ancestor("cell", LEVEL, 2).alias("cell")).where("cell % 2 = 0").distinct()
    return p.join(Q.find_cells(p, _stored(p).unionByName(upper), LEVEL), "cell").select("point_index", "found")


def _index(p: DataFrame) -> DataFrame:
    """An index that misses each tenth point."""
    return I.runs(p.where("point_index % 10 <> 0"))


def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an index that misses each tenth point fits all points."""
    p, box = _celled(spark, sf_dir)
    p = p.select("point_index", "cell", "x", "y")
    return checks.index_report(p, _index(p), box)


def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _celled(spark, sf_dir)[0]
    return p.groupBy("cell").agg(F.count(F.lit(1)).alias("n_points")).join(_stored(p), "cell", "left_anti")


def unused_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf cells of an index over all points that no third point falls in."""
    p = _celled(spark, sf_dir)[0]
    return p.select("cell").distinct().join(p.where("point_index % 3 = 0").select("cell").distinct(), "cell", "left_anti")


def chunk_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).where("z > 0")
    sizes = p.groupBy(F.floor(F.col("point_index") / CHUNK).cast("long").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"))
    return I.previous(sizes, "chunk_id", "n", "before").select("chunk_id", (F.col("n") - F.col("before")).alias("delta"))


def _in_cells(p: DataFrame, box: Q.Box) -> DataFrame:
    """The points of the cells that QUERY_BOX meets."""
    return Q.meeting(p, Q.cell_ranges(Q.Box(*QUERY_BOX), box, LEVEL), LEVEL)


def interval_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the runs of the cells which meet QUERY_BOX lie in."""
    return I.chunks_of(I.runs(_in_cells(*_celled(spark, sf_dir))), CHUNK)


def box_query_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of cells that meet the box, the runs of their points, the chunks of these, and of the chunks' points those in the box."""
    p, box = _celled(spark, sf_dir)
    ax, ay, bx, by = QUERY_BOX
    near = p.withColumn("chunk_id", F.floor(F.col("point_index") / CHUNK)).join(I.chunks_of(I.runs(_in_cells(p, box)), CHUNK), "chunk_id", "left_semi")
    return near.where(F.col("x").between(ax, bx) & F.col("y").between(ay, by)).select("point_index", "x", "y")


def recluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.reordered(_celled(spark, sf_dir)[0]).select("point_index", "cell", "new_index")


def _other(p: DataFrame) -> DataFrame:
    """A second reading of the same points: one field differs in each 17th, each 101st is gone."""
    i = F.col("point_index")
    return p.where(i % 101 != 0).withColumn("intensity", F.when(i % 17 == 0, F.col("intensity") + 1).otherwise(F.col("intensity")))


def _mismatches(p: DataFrame) -> DataFrame:
    return checks.mismatches(p, _other(p), ["x", "y", "z", "intensity", "classification"])


def diff_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mismatches(points(spark, sf_dir))
    return found.agg(F.count(F.lit(1)).alias("n_mismatches"), F.count_if(F.col("b").isNull()).alias("n_missing"))


def top_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mismatches(points(spark, sf_dir)).orderBy("point_index").limit(10).select("point_index", F.col("a.intensity").alias("left_intensity"), F.col("b.intensity").alias("right_intensity"))


def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings (here: values) by tool, operation and threads, with millions of points a second."""
    p = points(spark, sf_dir).select(F.col("classification").alias("tool"), F.col("return_number").alias("threads"), "x")
    s = p.groupBy("tool", "threads").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.min("x").alias("least"), F.max("x").alias("most"))
    mean = F.col("total").cast("double") / F.col("n")
    return s.select("tool", F.when(F.col("threads") == 0, "default").otherwise(F.col("threads").cast("string")).alias("threads"), "n", mean.alias("mean"), "least", "most", F.when(mean > 0, F.col("n") / mean).otherwise(0.0).alias("rate"))


def streaming_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate median after each record of a chunk, in order."""
    p = points(spark, sf_dir).select(F.floor(F.col("point_index") / CHUNK).cast("long").alias("chunk_id"), "point_index", "x")
    return C.streaming_medians(p, "chunk_id", "point_index", "x")


def change_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs from the record before, within a chunk: bits 5 returns, 4 intensity, 3 class, 0 source id.

    Intensity is compared with the last one of the same context, and with 0 where there is none.
    """
    chunk = Window.partitionBy("chunk_id").orderBy("point_index")
    p = points(spark, sf_dir).withColumn("chunk_id", F.floor(F.col("point_index") / CHUNK)).withColumn("m", C.return_context("number_of_returns", "return_number"))
    fields = ["return_number", "number_of_returns", "classification", "point_source_id"]
    p = p.select("point_index", "chunk_id", "m", "intensity", *fields, *(F.lag(c).over(chunk).alias(f"last_{c}") for c in fields))
    p = p.where("last_classification IS NOT NULL")  # a chunk's first record is stored whole
    light = F.coalesce(F.lag("intensity").over(Window.partitionBy("chunk_id", "m").orderBy("point_index")), F.lit(0))
    differ = lambda c: F.col(c) != F.col(f"last_{c}")
    bit = lambda condition, at: F.when(condition, F.lit(1 << at)).otherwise(F.lit(0))
    mask = bit(differ("return_number") | differ("number_of_returns"), 5) + bit(F.col("intensity") != light, 4) + bit(differ("classification"), 3) + bit(differ("point_source_id"), 0)
    return p.select("point_index", mask.alias("mask"))


def change_mask14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs from the last record of the scanner channel, within a chunk, as records of formats 6 to 10 say it."""
    at = lambda k: F.floor(F.col("point_index") / k)
    p = points(spark, sf_dir).withColumns({"chunk_id": at(CHUNK), "scanner_channel": at(3) % 4, "scan_angle": F.floor((F.col("z") + 2500) / 1000), "gps_time": at(2) * F.lit(0.001)})
    return C.change_masks14(p, "chunk_id", "point_index")


def _exact(a: np.ndarray, b: np.ndarray | int = 1) -> int:
    """The sum of a times b; in Python's numbers where 64 bits might not hold it."""
    ends = [max(abs(int(v.min())), abs(int(v.max()))) for v in (a, np.asarray(b))]
    if len(a) * ends[0] * ends[1] < 1 << 63:
        return int((a * b).sum())
    return sum(v * w for v, w in zip(a.tolist(), np.broadcast_to(b, a.shape).tolist(), strict=True))


class Moments:
    """Count, sums and sums of products of x, y and z, in whole numbers without bounds."""

    PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]

    def __init__(self) -> None:
        self.n, self.sums, self.products = 0, dict.fromkeys("xyz", 0), dict.fromkeys(self.PAIRS, 0)

    def add(self, batch: pa.RecordBatch) -> Moments:
        at = {a: batch.column(a).to_numpy(zero_copy_only=False).astype(np.int64) for a in "xyz"}
        self.n += batch.num_rows
        self.sums = {a: s + _exact(at[a]) for a, s in self.sums.items()}
        self.products = {(a, b): s + _exact(at[a], at[b]) for (a, b), s in self.products.items()}
        return self

    def merge(self, other: Moments) -> Moments:
        self.n += other.n
        self.sums = {a: s + other.sums[a] for a, s in self.sums.items()}
        self.products = {p: s + other.products[p] for p, s in self.products.items()}
        return self

    def row(self) -> dict:
        """Covariances in whole thousandths, towards zero."""
        out: dict = {"n": self.n}
        for a, b in self.PAIRS:
            top = 1000 * (self.n * self.products[a, b] - self.sums[a] * self.sums[b])
            out[f"cov_{a}{b}"] = float(abs(top) // self.n**2 * (1 if top >= 0 else -1)) / 1000 if self.n else None  # rounded before the division, as in SQL
        return out


def covariance_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of the points' places by a reduction with a state of its own."""
    kind = "n long, " + ", ".join(f"cov_{a}{b} double" for a, b in Moments.PAIRS)
    return reduce(points(spark, sf_dir).select(*"xyz").dropna(), Moments, Moments.add, Moments.merge, Moments.row, kind)


def bounds_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds by showing them all points, task by task."""
    return reduce(points(spark, sf_dir).select("x", "y"), Bounds, Bounds.add, Bounds.merge, Bounds.row, Bounds.KIND)


def colour_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as bytes and back, and all of them as text."""
    colours = ("red", "green", "blue")
    p = points(spark, sf_dir).select("point_index", *(b.alias(f"{c}_{k}") for c in colours for k, b in enumerate(C.colour_bytes(c))))
    p = p.select("point_index", *(C.colour_of(f"{c}_0", f"{c}_1").alias(c) for c in colours))
    return p.withColumn("text", C.array_text(F.array(*colours)))


def _cells_sql(level: int) -> str:
    """A CTE cells: point_index, x, y, the cell's lower corner (lx, ly), size (sx, sy) and number."""
    out = POINTS_SQL + ", box AS (SELECT " + ", ".join(f"CAST(CAST({f}({c}) AS FLOAT) AS DOUBLE) AS {n}{c}" for c in "xy" for f, n in (("min", "min_"), ("max", "max_"))) + " FROM points)"
    out += ", q0 AS (SELECT point_index, x, y, min_x AS lx, min_y AS ly, max_x - min_x AS sx, max_y - min_y AS sy, CAST(0 AS BIGINT) AS path FROM points, box)"
    for k in range(level):
        corner = ", ".join(f"CASE WHEN {c} >= l{c} + s{c} / 2 THEN l{c} + s{c} / 2 ELSE l{c} END AS l{c}, s{c} / 2 AS s{c}" for c in "xy")
        out += f", q{k + 1} AS (SELECT point_index, x, y, {corner}, path * 4 + CASE WHEN x >= lx + sx / 2 THEN 1 ELSE 0 END + CASE WHEN y >= ly + sy / 2 THEN 2 ELSE 0 END AS path FROM q{k})"
    return out + f", cells AS (SELECT *, path + {Q.offset(level)} AS cell FROM q{level}) "


CELLS, AT2 = _cells_sql(LEVEL), _cells_sql(2)
RUNS = ", runs AS (SELECT cell, min(point_index) AS s, max(point_index) AS e FROM (SELECT cell, point_index, point_index - row_number() OVER (PARTITION BY cell ORDER BY point_index) AS g FROM {}) GROUP BY cell, g) "
ALL_RUNS = CELLS + RUNS.format("cells")
STORED = f"SELECT cell FROM cells GROUP BY cell HAVING count(*) >= {LEAST}"
DIFF = POINTS_SQL + """, m AS (SELECT point_index, intensity AS a, CASE WHEN point_index % 101 = 0 THEN NULL WHEN point_index % 17 = 0 THEN intensity + 1 ELSE intensity END AS b FROM points) """
UP = " UNION ".join(f"SELECT ((cell - {Q.offset(LEVEL)}) >> {2 * (LEVEL - k)}) + {Q.offset(k)} AS cell, {k} AS level FROM cells" for k in range(LEVEL + 1))

QUERIES = {
    f.__name__: f
    for f in (
        bounds_negative_scale, legacy_counts, classification_hist, unpack_bit_byte, pack_core14_flags, box_filter_3d, custom_projection, colour_bytes, record_deltas, quadtree_levels, quadtree_cell, cell_at_level, cell_level, cell_bounds,
        cell_histogram, cell_intervals, index_summary, find_cell_fallback, index_validation, missing_cells, unused_cells, chunk_deltas, interval_chunks, box_query_pruned, recluster_order, diff_readers, top_mismatches, bench_summary, streaming_median, change_mask, change_mask14, covariance_xyz, bounds_reduced, colour_roundtrip,
    )
}
_AX, _AY, _BX, _BY = QUERY_BOX
ORACLES = {
    "bounds_negative_scale": POINTS_SQL + "SELECT least(a, b) AS min_x, greatest(a, b) AS max_x FROM (SELECT min(x) * CAST(-0.01 AS DOUBLE) + 5 AS a, max(x) * CAST(-0.01 AS DOUBLE) + 5 AS b FROM points)",
    "legacy_counts": POINTS_SQL + "SELECT format, " + ", ".join(f"CASE WHEN format < 6 THEN {c} ELSE 0 END AS legacy_{c}" for c in ("n", "r1", "r2", "r3", "r4", "r5")) + " FROM range(11) t(format), (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE return_number = {r}) AS r{r}" for r in range(1, 6)) + " FROM points)",
    "classification_hist": POINTS_SQL + "SELECT CASE classification WHEN 1 THEN 'Unclassified' WHEN 2 THEN 'Ground' WHEN 5 THEN 'High vegetation' WHEN 6 THEN 'Building' WHEN 7 THEN 'Low point' END AS label, count(*) AS n_points FROM points GROUP BY 1",
    "unpack_bit_byte": POINTS_SQL + "SELECT point_index, return_number, number_of_returns FROM points",
    "pack_core14_flags": POINTS_SQL + "SELECT point_index, point_index % 16 + (point_index % 4) * 16 + (point_index % 2) * 64 + ((point_index // 2) % 2) * 128 AS flags FROM points",
    "box_filter_3d": POINTS_SQL + "SELECT point_index, x, y, z FROM points WHERE x BETWEEN 1000 AND 5000 AND y BETWEEN 0 AND 500000 AND z BETWEEN -1000 AND 1000",
    "custom_projection": POINTS_SQL + "SELECT x, y, z, gps_time FROM points",
    "colour_bytes": POINTS_SQL + "SELECT point_index, " + ", ".join(f"{c} % 256 AS {c}_lo, {c} // 256 AS {c}_hi" for c in ("red", "green", "blue")) + " FROM points",
    "record_deltas": POINTS_SQL + f"SELECT point_index, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM points WINDOW w AS (PARTITION BY point_index // {CHUNK} ORDER BY point_index)",
    "quadtree_levels": POINTS_SQL + "SELECT tile, CAST(CASE WHEN w <= 0 THEN 4 WHEN w < tile THEN 1 ELSE least(greatest(ceil(log2(w / tile)), 1), 16) END AS INT) AS levels FROM (SELECT CAST(50 AS DOUBLE) AS tile UNION ALL SELECT 500 UNION ALL SELECT 5000), (SELECT greatest(CAST(CAST(max(x) AS FLOAT) AS DOUBLE) - CAST(min(x) AS FLOAT), CAST(CAST(max(y) AS FLOAT) AS DOUBLE) - CAST(min(y) AS FLOAT)) AS w FROM points)",
    "quadtree_cell": CELLS + "SELECT point_index, cell FROM cells",
    "cell_at_level": AT2 + "SELECT point_index, cell FROM cells",
    "cell_level": CELLS + f"SELECT cell, CAST(level AS INT) AS level FROM ({UP})",
    "cell_bounds": CELLS + "SELECT DISTINCT cell, lx AS min_x, lx + sx AS max_x, ly AS min_y, ly + sy AS max_y FROM cells",
    "cell_histogram": CELLS + "SELECT cell, count(*) AS n_points FROM cells GROUP BY cell",
    "cell_intervals": ALL_RUNS + "SELECT cell, s AS first_point, e AS last_point FROM runs",
    "index_summary": ALL_RUNS + "SELECT count(DISTINCT cell) AS n_cells, count(*) AS n_intervals, CAST(sum(e - s + 1) AS BIGINT) AS n_points, CAST(count(*) AS DOUBLE) / count(DISTINCT cell) AS mean_intervals FROM runs",
    "find_cell_fallback": CELLS + f", st AS ({STORED}), up AS (SELECT point_index, cell, ((cell - {Q.offset(LEVEL)}) >> {2 * (LEVEL - 2)}) + {Q.offset(2)} AS c2 FROM cells) SELECT point_index, CASE WHEN cell IN (SELECT cell FROM st) THEN cell WHEN c2 % 2 = 0 THEN c2 ELSE -1 END AS found FROM up",
    "index_validation": CELLS + RUNS.format("cells WHERE point_index % 10 <> 0")
    + ", i AS (SELECT count(*) AS k FROM cells c WHERE EXISTS (SELECT 1 FROM runs r WHERE r.cell = c.cell AND c.point_index BETWEEN r.s AND r.e)), h AS (SELECT CAST(sum(e - s + 1) AS DOUBLE) AS held FROM runs), "
    "t AS (SELECT count(*) AS n, count(DISTINCT cell) AS c, count(*) FILTER (WHERE x BETWEEN lx AND lx + sx AND y BETWEEN ly AND ly + sy) AS b, count(DISTINCT cell) FILTER (WHERE cell NOT IN (SELECT cell FROM runs)) AS m FROM cells) "
    "SELECT n AS n_points, c AS n_cells, k AS in_intervals, n - k AS not_in_intervals, b AS in_bounds, m AS missing_cells, CAST(100 AS DOUBLE) * k / n AS percent_in_intervals, CAST(100 AS DOUBLE) * b / n AS percent_in_bounds, n / held AS efficiency FROM t, i, h",
    "missing_cells": CELLS + f"SELECT cell, count(*) AS n_points FROM cells GROUP BY cell HAVING count(*) < {LEAST}",
    "unused_cells": CELLS + "SELECT DISTINCT cell FROM cells WHERE cell NOT IN (SELECT cell FROM cells WHERE point_index % 3 = 0)",
    "change_mask": POINTS_SQL + f""", l AS (SELECT *, point_index // {CHUNK} AS c, ({sum(RETURNS8, [])})[CAST(return_number + number_of_returns * 8 AS INT) + 1] AS m,
{", ".join(f"lag({c}) OVER w AS last_{c}" for c in ("return_number", "number_of_returns", "classification", "point_source_id"))} FROM points WINDOW w AS (PARTITION BY point_index // {CHUNK} ORDER BY point_index)),
k AS (SELECT *, coalesce(lag(intensity) OVER (PARTITION BY c, m ORDER BY point_index), 0) AS light FROM l WHERE last_classification IS NOT NULL)
SELECT point_index, CASE WHEN return_number <> last_return_number OR number_of_returns <> last_number_of_returns THEN 32 ELSE 0 END + CASE WHEN intensity <> light THEN 16 ELSE 0 END
+ CASE WHEN classification <> last_classification THEN 8 ELSE 0 END + CASE WHEN point_source_id <> last_point_source_id THEN 1 ELSE 0 END AS mask FROM k""",
    "change_mask14": POINTS_SQL + f""", l AS (SELECT point_index, point_index // {CHUNK} AS chunk_id, return_number AS r, number_of_returns AS n, (z + 2500) // 1000 AS a, (point_index // 2) * CAST(0.001 AS DOUBLE) AS t, point_source_id AS s, (point_index // 3) % 4 AS c FROM points),
k AS (SELECT *, {", ".join(f"coalesce(lag({v}) OVER own, lag({v}) OVER before) AS last_{v}" for v in "rnats")}, lag(c) OVER before AS last_c FROM l WINDOW own AS (PARTITION BY chunk_id, c ORDER BY point_index), before AS (PARTITION BY chunk_id ORDER BY point_index))
SELECT chunk_id, point_index, CASE (r - last_r + 16) % 16 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 15 THEN 2 ELSE 3 END + CASE WHEN n <> last_n THEN 4 ELSE 0 END + CASE WHEN a <> last_a THEN 8 ELSE 0 END
+ CASE WHEN t <> last_t THEN 16 ELSE 0 END + CASE WHEN s <> last_s THEN 32 ELSE 0 END + CASE WHEN c <> last_c THEN 64 ELSE 0 END AS mask FROM k WHERE last_c IS NOT NULL""",
    "covariance_xyz": POINTS_SQL + ", s AS (SELECT CAST(count(*) AS HUGEINT) AS n, " + ", ".join(f"CAST(sum({a}) AS HUGEINT) AS s_{a}" for a in "xyz") + ", " + ", ".join(f"CAST(sum(CAST({a} AS HUGEINT) * {b}) AS HUGEINT) AS p_{a}{b}" for a, b in Moments.PAIRS)
    + " FROM points WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL) SELECT CAST(n AS BIGINT) AS n, " + ", ".join(f"CAST(CAST(1000 * (n * p_{a}{b} - s_{a} * s_{b}) // (n * n) AS BIGINT) AS DOUBLE) / 1000 AS cov_{a}{b}" for a, b in Moments.PAIRS) + " FROM s",
    "bounds_reduced": POINTS_SQL + "SELECT CAST(min(x) AS DOUBLE) AS min_x, CAST(min(y) AS DOUBLE) AS min_y, CAST(max(x) AS DOUBLE) AS max_x, CAST(max(y) AS DOUBLE) AS max_y FROM points WHERE x IS NOT NULL AND y IS NOT NULL",
    "colour_roundtrip": POINTS_SQL + "SELECT point_index, red, green, blue, '[' || red || ', ' || green || ', ' || blue || ']' AS text FROM points",
    "chunk_deltas": POINTS_SQL + f"SELECT chunk_id, n - lag(n, 1, 0) OVER (ORDER BY chunk_id) AS delta FROM (SELECT point_index // {CHUNK} AS chunk_id, count(*) AS n FROM points WHERE z > 0 GROUP BY 1)",
    "interval_chunks": CELLS + f"SELECT DISTINCT point_index // {CHUNK} AS chunk_id FROM cells, box WHERE (lx <= {_BX} OR lx <= min_x) AND (lx + sx >= {_AX} OR lx + sx >= max_x) AND (ly <= {_BY} OR ly <= min_y) AND (ly + sy >= {_AY} OR ly + sy >= max_y)",
    "box_query_pruned": POINTS_SQL + f"SELECT point_index, x, y FROM points WHERE x BETWEEN {_AX} AND {_BX} AND y BETWEEN {_AY} AND {_BY}",
    "recluster_order": CELLS + "SELECT point_index, cell, row_number() OVER (ORDER BY cell, point_index) - 1 AS new_index FROM cells",
    "diff_readers": DIFF + "SELECT count(*) AS n_mismatches, count(*) FILTER (WHERE b IS NULL) AS n_missing FROM m WHERE a IS DISTINCT FROM b",
    "top_mismatches": DIFF + "SELECT point_index, a AS left_intensity, b AS right_intensity FROM m WHERE a IS DISTINCT FROM b ORDER BY point_index LIMIT 10",
    "bench_summary": POINTS_SQL + "SELECT tool, threads, n, mean, least, most, CASE WHEN mean > 0 THEN n / mean ELSE 0 END AS rate FROM (SELECT classification AS tool, CAST(return_number AS VARCHAR) AS threads, count(*) AS n, CAST(sum(x) AS DOUBLE) / count(*) AS mean, min(x) AS least, max(x) AS most FROM points GROUP BY 1, 2)",
}
