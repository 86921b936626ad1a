"""The quadtree over x and y: cells of points, levels and bounds of cells, lookup with ancestors.

Cells of level L are numbered from (4^L - 1) / 3 on; two bits a level follow, root first: bit 0 the right half, bit 1 the
top half. A coordinate on a middle line belongs to the right or top half; points outside of the box fall in edge cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LEVELS = 16


@dataclass(frozen=True)
class Box:
    min_x: float
    min_y: float
    max_x: float
    max_y: float


def box_of(points: DataFrame) -> Box | None:
    """The points' bounds, rounded to 32-bit floats as the index stores them; None for an empty table. One row is fetched.

    The floats are fetched as such: of a cast on to doubles Spark leaves out the one to floats where points are whole numbers.
    """
    at = lambda f, c: f(c).cast("float")
    row = points.agg(at(F.min, "x"), at(F.min, "y"), at(F.max, "x"), at(F.max, "y")).first()
    return None if row[0] is None else Box(*row)


def levels_for(box: Box | None, tile: float = 50.0) -> int:
    """Levels such that leaf cells are about `tile` wide, 1 to 16; 4 where box or tile have no extent."""
    wide = max(box.max_x - box.min_x, box.max_y - box.min_y) if box else 0
    if wide <= 0 or tile <= 0:
        return 4
    return min(max(math.ceil(math.log2(wide / tile)), 1), MOST_LEVELS) if wide >= tile else 1


def offset(level: int) -> int:
    """The first cell of a level."""
    return (4**level - 1) // 3


def _sizes(box: Box, level: int) -> Column:
    """Widths and heights of the cells of levels 1 to `level`: the box's, halved again and again."""
    return F.array(*(F.struct(F.lit((box.max_x - box.min_x) / 2.0**k).alias("w"), F.lit((box.max_y - box.min_y) / 2.0**k).alias("h")) for k in range(1, level + 1)))


def cell(x: Column | str, y: Column | str, box: Box, level: int, levels: int = MOST_LEVELS) -> Column:
    """The cell of a place at a level, the deepest one where there are fewer; 0 at level 0 or in a box without extent.

    A middle line lies one size from the half's lower border: sizes are halved and added, never averaged.
    """
    level = min(level, levels)
    if level < 1 or box.max_x <= box.min_x or box.max_y <= box.min_y:
        return F.lit(0).cast("long")
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    kind = "struct<x:double,y:double,path:bigint>"
    start = F.struct(F.lit(box.min_x), F.lit(box.min_y), F.lit(0).cast("long")).cast(kind)

    def step(s: Column, size: Column) -> Column:
        mx, my = s["x"] + size["w"], s["y"] + size["h"]
        right, top = x >= mx, y >= my
        return F.struct(F.when(right, mx).otherwise(s["x"]), F.when(top, my).otherwise(s["y"]), s["path"] * 4 + right.cast("long") + top.cast("long") * 2).cast(kind)

    # an aggregate over the levels: nested conditions would double at each level
    return F.aggregate(_sizes(box, level), start, step, lambda s: s["path"] + F.lit(offset(level)))


def level_of(number: Column | str) -> Column:
    """The level of a cell: the largest whose first cell is not beyond it."""
    out = F.lit(0)
    for level in range(1, MOST_LEVELS + 1):
        out = out + (F.col(number) if isinstance(number, str) else number).__ge__(F.lit(offset(level))).cast("int")
    return out


def ancestor(leaf: Column | str, level: int, up_to: int) -> Column:
    """The cell of level `up_to` that holds a cell of `level`."""
    return F.shiftright((F.col(leaf) if isinstance(leaf, str) else leaf) - F.lit(offset(level)), 2 * (level - up_to)) + F.lit(offset(up_to))


def cell_bounds(number: str, box: Box) -> Column:
    """A struct min_x, max_x, min_y, max_y of a cell; the whole box for cell 0 or a box without extent."""
    kind = "struct<min_x:double,max_x:double,min_y:double,max_y:double>"
    whole = F.struct(*(F.lit(v) for v in (box.min_x, box.max_x, box.min_y, box.max_y))).cast(kind)
    if box.max_x <= box.min_x or box.max_y <= box.min_y:
        return whole
    level, firsts = level_of(number), F.array(*(F.lit(offset(k)) for k in range(MOST_LEVELS + 1)))
    path = F.col(number) - F.get(firsts, level)
    steps = F.transform(F.slice(_sizes(box, MOST_LEVELS), F.lit(1), level), lambda size, k: F.struct(size.alias("size"), k.alias("k")))
    start = F.struct(F.lit(box.min_x), F.lit(box.max_x - box.min_x), F.lit(box.min_y), F.lit(box.max_y - box.min_y)).cast("struct<x:double,w:double,y:double,h:double>")

    def step(s: Column, at: Column) -> Column:
        digit = F.pmod(F.floor(path / F.pow(F.lit(4.0), level - 1 - at["k"])), F.lit(4))
        w, h = at["size"]["w"], at["size"]["h"]
        x, y = s["x"] + F.when(digit % 2 == 1, w).otherwise(0.0), s["y"] + F.when(digit >= 2, h).otherwise(0.0)
        return F.struct(x, w, y, h).cast("struct<x:double,w:double,y:double,h:double>")

    found = F.aggregate(steps, start, step, lambda s: F.struct(s["x"], s["x"] + s["w"], s["y"], s["y"] + s["h"]).cast(kind))
    return F.when(level > 0, found).otherwise(whole)


def find_cells(leaves: DataFrame, stored: DataFrame, level: int) -> DataFrame:
    """cell, found: for each distinct leaf cell the deepest stored cell that holds it, -1 if none.

    Both tables have a column cell; ancestors are looked up once for each leaf cell, not for each point.
    """
    own = leaves.select("cell").distinct()
    tried = own.select("cell", F.explode(F.array(*(F.struct(F.lit(k).alias("depth"), ancestor("cell", level, k).alias("at")) for k in range(level + 1)))).alias("t"))
    hit = tried.select("cell", "t.depth", "t.at").join(stored.select(F.col("cell").alias("at")).distinct(), "at")
    deepest = hit.groupBy("cell").agg(F.max_by("at", "depth").alias("found"))
    return own.join(deepest, "cell", "left").select("cell", F.coalesce("found", F.lit(-1).cast("long")).alias("found"))


def _column(at: float, least: float, wide: float, level: int) -> int:
    """The column of a place on one axis, by the same halving as cell()."""
    out = 0
    for k in range(1, level + 1):
        middle = least + wide / 2.0**k
        right = at >= middle
        least, out = middle if right else least, out * 2 + right
    return out


def _border(column: int, least: float, wide: float, level: int) -> float:
    """The lower border of a column."""
    for k in range(1, level + 1):
        if column >> (level - k) & 1:
            least += wide / 2.0**k
    return least


def _columns(low: float, high: float, least: float, wide: float, level: int) -> tuple[int, int]:
    """The first and last column that low to high meets, borders included; beyond the box those at its edges."""
    first, last = _column(low, least, wide, level), _column(high, least, wide, level)
    if first and _border(first - 1, least, wide, level) + wide / 2.0**level >= low:
        first -= 1
    return first, last


def cell_ranges(query: Box, box: Box, level: int, most: int | None = None) -> list[tuple[int, int]]:
    """The cells of a level that meet the query, as ranges of numbers, in order and as long as possible.

    The columns and rows that the query covers are whole numbers; from the root only quadrants that their border cuts are
    divided, one inside is a single range. With `most`, division stops a level earlier until there are that many ranges or
    fewer; they then hold more than the query. Cells at the edges also hold what lies beyond the box.
    """
    if level < 1 or box.max_x <= box.min_x or box.max_y <= box.min_y:
        return [(0, 0)]
    if query.max_x < query.min_x or query.max_y < query.min_y:
        return []
    x0, x1 = _columns(query.min_x, query.max_x, box.min_x, box.max_x - box.min_x, level)
    y0, y1 = _columns(query.min_y, query.max_y, box.min_y, box.max_y - box.min_y, level)
    for deepest in range(level, -1, -1):
        out: list[tuple[int, int]] = []
        todo = [(0, 0, 0, 0)]  # path, depth, column and row
        while todo:
            path, depth, x, y = todo.pop()
            size = 1 << (level - depth)
            left, low = x * size, y * size
            if left > x1 or left + size <= x0 or low > y1 or low + size <= y0:
                continue
            inside = x0 <= left and left + size - 1 <= x1 and y0 <= low and low + size - 1 <= y1
            if not inside and depth < deepest:
                todo += [(path * 4 + q, depth + 1, x * 2 + q % 2, y * 2 + q // 2) for q in (3, 2, 1, 0)]
                continue
            first = offset(level) + path * size * size
            if out and out[-1][1] == first - 1:
                first = out.pop()[0]
            out.append((first, offset(level) + (path + 1) * size * size - 1))
        if most is None or len(out) <= most:
            break
    return out


def leaves_of(number: Column | str, level: int) -> tuple[Column, Column]:
    """The first and last cell of a level under a cell of that or a lower level."""
    number = F.col(number) if isinstance(number, str) else number
    own = level_of(number)
    firsts = F.array(*(F.lit(offset(k)) for k in range(MOST_LEVELS + 1)))
    path, below = number - F.get(firsts, own), F.lit(1).cast("long") * F.pow(F.lit(4.0), F.lit(level) - own).cast("long")
    return F.lit(offset(level)) + path * below, F.lit(offset(level)) + (path + 1) * below - 1


def meeting(rows: DataFrame, ranges: list[tuple[int, int]], level: int, first: str = "cell", last: str | None = None) -> DataFrame:
    """The rows whose cell, or whose cells first to last, lie in the ranges of a level.

    Ranges are cut at blocks of cells, so that the join has equal keys, and no condition is pushed into the way cells are worked out.
    """
    shift = 2 * (level // 2)
    block = lambda c: F.shiftright(F.col(c) - F.lit(offset(level)), shift)
    held = rows.sparkSession.createDataFrame(ranges, "_start long, _end long")
    held = held.withColumn("_held", F.explode(F.sequence(block("_start"), block("_end"))))
    last = last or first
    wanted = F.sequence(block(first), block(last))
    cut = rows.withColumn("_block", block(first)) if last == first else rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_block", F.explode(wanted))
    met = cut.join(held, (F.col("_block") == F.col("_held")) & (F.col(first) <= F.col("_end")) & (F.col(last) >= F.col("_start")), "left_semi")
    return (met if last == first else met.dropDuplicates(["_row"]).drop("_row")).drop("_block")
