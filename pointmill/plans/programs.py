"""What a user runs on whole files: look into one, check its index, compare two, read one as fast as can be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions.columns import encoding_text
from pointmill.operators import checks
from pointmill.operators import quadtree as Q
from pointmill.plans.convert import reader, record_kinds


def first_of(rows: list[str], total: int, indent: str = "  ") -> list[str]:
    """Lines, and how many more there are."""
    return [indent + r for r in rows] + [f"{indent}... and {total - len(rows)} more"] * (total > len(rows))


def inspect(spark: SparkSession, path: str, cells: int = 3) -> str:
    """A file's header, records, chunks and index in words, with the first cells of the index."""
    h = reader(spark, path, table="header").withColumn("encoding", encoding_text("global_encoding")).first()
    lines = [f"{h.file}: version {h.version}, format {h.format}, {'compressed, ' if h.compressed else ''}{h.n_points} points of {h.record_length} bytes ({h.extra_bytes} extra)"]
    lines += [f"made by {h.software or '?'} on day {h.day} of {h.year}; encoding: {h.encoding or 'none'}", f"by return: {', '.join(map(str, h.by_return))}"]
    lines += [f"{a}: {h[f'min_{a}']} to {h[f'max_{a}']}, scale {h[f'scale_{a}']}, offset {h[f'offset_{a}']}" for a in "xyz"]
    records = reader(spark, path, table="vlr").select("kind", "user_id", "record_id", "length", "description", record_kinds().alias("kinds")).collect()
    lines += [f"{len(records)} records"] + [f"  {r.kind} {r.user_id} {r.record_id}, {r.length} bytes, {'/'.join(r.kinds) or 'unknown'}: {r.description}" for r in records]
    chunks = reader(spark, path, table="chunks").agg(F.count(F.lit(1)).alias("n"), F.max("n_points").alias("most")).first()
    lines.append(f"{chunks.n} chunks of {chunks.most or 0} points at most")
    index = reader(spark, path, table="index")
    s = index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("intervals")).alias("k"), F.sum("number_points").alias("points"), F.max("levels").alias("levels"), F.max("source").alias("source")).first()
    if not s.n:
        return "\n".join([*lines, "no index"])
    lines.append(f"index ({s.source}): {s.levels} levels, {s.n} cells, {s.k} runs, {s.k / s.n:.2f} a cell, {s.points} points")
    some = [f"cell {r.cell}: {r.number_points} points, {len(r.intervals)} runs from {r.intervals[0].start if r.intervals else '-'}" for r in index.orderBy("cell").limit(cells).collect()]
    return "\n".join([*lines, *first_of(some, s.n)])


def _celled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, Q.Box]:
    h = reader(spark, path, table="header").first()
    stored = reader(spark, path, table="index")
    one = stored.select("levels", "min_x", "min_y", "max_x", "max_y").first()
    if one is None:
        raise ValueError(f"{path} has no index")
    box = Q.Box(one.min_x, one.min_y, one.max_x, one.max_y)
    world = reader(spark, path).select("point_index", *((F.col(a) * F.lit(h[f"scale_{a}"]) + F.lit(h[f"offset_{a}"])).alias(a) for a in "xy"))
    runs = stored.select("cell", F.explode("intervals").alias("i")).select("cell", "i.start", "i.end")
    return world.withColumn("cell", Q.cell("x", "y", box, one.levels)), runs, box


def validate_index(spark: SparkSession, path: str, sample: int = 10) -> dict:
    """How a file's index fits its points, with a few of the cells that only one of them has; raises without an index."""
    points, runs, box = _celled(spark, path)
    out = checks.index_report(points, runs, box).first().asDict()
    odd = checks.unmatched_cells(points, runs)
    for side in ("missing", "unused"):
        out[side] = [r.cell for r in odd.where(F.col("side") == side).orderBy("cell").limit(sample).collect()]
    return out


def compare(spark: SparkSession, a: str, b: str, first: int = 10) -> dict:
    """How many points differ between two files, and the first ones; all fields that both have are compared."""
    one, two = reader(spark, a), reader(spark, b)
    fields = [c for c in one.columns if c in two.columns and c != "point_index"]
    odd = checks.mismatches(one, two, fields)
    return {"mismatches": odd.count(), "first": [r.point_index for r in odd.orderBy("point_index").limit(first).collect()]}


def read_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path, each read whole: what reading alone takes."""
    return spark.read.format("binaryFile").load(path).select(F.sum(F.octet_length("content"))).first()[0] or 0
