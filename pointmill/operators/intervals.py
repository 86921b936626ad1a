"""Runs of consecutive points by cell, and what follows from them: chunks to read, membership, a new order.

A cell may hold a third of all points, so no window runs over a whole cell: points are dealt by cell and block of
consecutive indexes, and only runs or counts, one or few for each block, meet by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Consecutive point indexes that one window covers at most.
BLOCK = 1 << 16


def _block(index: str = "point_index", block: int = BLOCK) -> Column:
    return F.floor(F.col(index) / F.lit(block)).cast("long")


def runs(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """cell, start, end (inclusive) of the runs of consecutive point_index; points must have cell and point_index, the latter unique."""
    own = Window.partitionBy("cell", "block").orderBy("point_index")
    dealt = points.select("cell", "point_index", _block(block=block).alias("block"))
    short = dealt.withColumn("island", F.col("point_index") - F.row_number().over(own)).groupBy("cell", "block", "island").agg(F.min("point_index").alias("start"), F.max("point_index").alias("end"))
    # a run goes on in the next block only where it touches the border, so only border runs are joined over the whole cell
    touches = (F.col("start") % block == 0) | (F.col("end") % block == block - 1)
    inner = short.where(~touches).select("cell", "start", "end")
    by_cell = Window.partitionBy("cell").orderBy("start")
    edge = short.where(touches).select("cell", "start", "end", (F.col("start") != F.lag("end").over(by_cell) + 1).alias("new"))
    edge = edge.withColumn("run", F.sum(F.coalesce(F.col("new").cast("int"), F.lit(1))).over(by_cell)).groupBy("cell", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return inner.unionByName(edge.select("cell", "start", "end"))


def running(rows: DataFrame, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """rows with `name`, the sum of value over all rows of smaller order (whole numbers, unique).

    Sums by block of orders are added up in order, then sums within each block: no task sees all rows.
    """
    dealt = rows.withColumn("_block", _block(order, block))
    sums = dealt.groupBy("_block").agg(F.sum(value).alias("_sum"))
    # one row for each block
    base = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(base, "_block").withColumn(name, F.col("_base") + own).drop("_block", "_base")


def previous(rows: DataFrame, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """rows with `name`, the value of the row of the next smaller order (whole numbers, unique), 0 for the first."""
    dealt = rows.withColumn("_block", _block(order, block))
    lasts = dealt.groupBy("_block").agg(F.max_by(value, order).alias("_last"))
    before = lasts.select("_block", F.lag("_last", 1, 0).over(Window.orderBy("_block")).alias("_before"))  # one row for each block
    own = F.lag(value).over(Window.partitionBy("_block").orderBy(order))
    return dealt.join(before, "_block").withColumn(name, F.coalesce(own, "_before")).drop("_block", "_before")


def chunks_meeting(intervals: DataFrame, chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """chunk_id of the chunks (chunk_id, first_point, n_points, of any sizes) that the intervals meet; what lies beyond the
    last point meets none. Both sides are cut at blocks of points, so the join has equal keys."""
    cut = lambda df, a, b: df.withColumn("_block", F.explode(F.sequence(F.floor(a / block), F.floor(b / block))))
    last = F.col("first_point") + F.col("n_points") - 1
    held = cut(chunks.where("n_points > 0").select("chunk_id", "first_point", last.alias("last_point")), F.col("first_point"), F.col("last_point"))
    wanted = cut(intervals.select("start", "end"), F.col("start"), F.col("end"))
    return wanted.join(held, "_block").where("start <= last_point AND end >= first_point").select("chunk_id").distinct()


def chunks_of(intervals: DataFrame, chunk: int) -> DataFrame:
    """chunk_id: the distinct chunks of a fixed size that the intervals meet."""
    size = F.lit(chunk)
    return intervals.select(F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))).alias("chunk_id")).distinct()


def within(points: DataFrame, intervals: DataFrame, block: int = BLOCK) -> DataFrame:
    """The points whose index lies in an interval of their cell.

    Intervals are cut at blocks; within a cell's block each point is held against the farthest end of those that start before it,
    in one pass in order, so that many points and many short intervals don't all meet.
    """
    rows = points.where("cell IS NOT NULL").select("cell", _block(block=block).alias("block"), F.col("point_index").alias("at"), F.lit(None).cast("long").alias("end"), F.struct("*").alias("row"))
    cut = intervals.where("cell IS NOT NULL").withColumn("block", F.explode(F.sequence(_block("start", block), _block("end", block)))).select("cell", "block", F.col("start").alias("at"), "end")
    before = Window.partitionBy("cell", "block").orderBy("at", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.unionByName(cut, allowMissingColumns=True).withColumn("end", F.max("end").over(before))
    return met.where("row IS NOT NULL AND at <= end").select("row.*")


def reordered(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """points with new_index, the place in the order of (cell, point_index), gapless from 0.

    Counts by cell and block give each block's first place; only these counts are summed in order.
    """
    dealt = points.withColumn("block", _block(block=block))
    counts = dealt.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cell").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cells = running(counts.groupBy("cell").agg(F.sum("n").alias("n")), "cell", "n", "base").select("cell", "base")
    first = counts.join(cells, "cell").select("cell", "block", (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first"))
    own = Window.partitionBy("cell", "block").orderBy("point_index")
    return dealt.join(first, ["cell", "block"]).withColumn("new_index", F.col("first") + F.row_number().over(own) - 1).drop("block", "first")


def largest_batch(chunks: DataFrame, batch: int) -> DataFrame:
    """batch, n_points: the batch of so many consecutive chunks (chunk_id, n_points) that holds the most points, the first of several; none without chunks."""
    sums = chunks.groupBy(F.floor(F.col("chunk_id") / F.lit(batch)).alias("batch")).agg(F.sum("n_points").alias("n_points"))
    best = sums.agg(F.max(F.struct("n_points", (-F.col("batch")).alias("at"))).alias("m")).where("m IS NOT NULL")
    return best.select((-F.col("m.at")).alias("batch"), F.col("m.n_points").alias("n_points"))
