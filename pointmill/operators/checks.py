"""Checks of indexes against their points, and of two readings of the same points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.operators import intervals as I
from pointmill.operators import quadtree as Q


def index_report(points: DataFrame, index: DataFrame, box: Q.Box) -> DataFrame:
    """One row on how an index (cell, start, end) fits points (point_index, cell, x, y).

    Points in a run of their cell and within the cell's bounds, their shares, cells that the index lacks, and points for
    each place that the runs hold.
    """
    found = I.within(points, index).agg(F.count(F.lit(1)).alias("in_intervals"))
    b = F.col("b")
    inside = F.col("x").between(b["min_x"], b["max_x"]) & F.col("y").between(b["min_y"], b["max_y"])
    total = points.withColumn("b", Q.cell_bounds("cell", box)).agg(F.count(F.lit(1)).alias("n_points"), F.count_if(inside).alias("in_bounds"))
    known = index.select("cell").distinct().withColumn("known", F.lit(1))
    lacking = points.select("cell").distinct().join(known, "cell", "left").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("known").isNull()).alias("missing_cells"))
    held = index.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("held"))
    one = total.join(F.broadcast(found)).join(F.broadcast(lacking)).join(F.broadcast(held))  # a row each
    n = F.greatest(F.col("n_points"), F.lit(1))
    return one.select(
        "n_points", "n_cells", "in_intervals", (F.col("n_points") - F.col("in_intervals")).alias("not_in_intervals"), "in_bounds", "missing_cells", (F.lit(100.0) * F.col("in_intervals") / n).alias("percent_in_intervals"),
        (F.lit(100.0) * F.col("in_bounds") / n).alias("percent_in_bounds"), F.when(F.col("held") > 0, F.col("n_points") / F.col("held")).otherwise(0.0).alias("efficiency"),
    )


def unmatched_cells(points: DataFrame, index: DataFrame) -> DataFrame:
    """cell and side: cells of points that the index lacks (missing), and cells of the index without points (unused)."""
    own, stored = points.select("cell").distinct(), index.select("cell").distinct()
    return own.join(stored, "cell", "left_anti").withColumn("side", F.lit("missing")).unionByName(stored.join(own, "cell", "left_anti").withColumn("side", F.lit("unused")))


def mismatches(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """point_index, a and b (structs of the fields) wherever two readings differ, or one lacks the point."""
    side = lambda d, n: d.select("point_index", F.struct(*fields).alias(n))
    return side(a, "a").join(side(b, "b"), "point_index", "full").where(~F.col("a").eqNullSafe(F.col("b")))
