"""Timed reads and writes of a file by number of tasks, with rates, as a table, as text and as JSON.

    python -m pointmill.plans.benchmark --file a.laz --tasks 1,2,4 --operation both
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.plans.convert import reader
from pointmill.plans.programs import read_bytes
from pointmill.sources import onefile

OWN, BYTES = "pointmill", "roofline"
TIMINGS = "tool string, operation string, threads int, iteration int, time_s double"


def doublings(most: int) -> list[int]:
    """1, 2, 4 and so on below most, and most."""
    return [1 << k for k in range(most.bit_length()) if 1 << k < most] + [most]


def _timed(work: Callable[[], object], warmup: int, iterations: int) -> Iterable[tuple[int, float]]:
    for k in range(-warmup, iterations):
        began = time.perf_counter()
        work()
        if k >= 0:
            yield k, time.perf_counter() - began


def timings(spark: SparkSession, path: str, tasks: list[int] | None = None, operation: str = "both", warmup: int = 1, iterations: int = 3, chunk_size: int = 50_000, keep: str | None = None) -> DataFrame:
    """tool, operation, threads, iteration, time_s: reads and writes of all points by so many tasks at most, and reading the bytes alone (0 tasks: as Spark likes).

    Writes go to a new file next to path, which is removed again (or stays as `keep`). An operation other than read, write or
    both, no iterations, or no tasks raise ValueError.
    """
    if operation not in ("read", "write", "both") or iterations < 1 or min(tasks or [1]) < 1:
        raise ValueError("read, write or both, by at least one task, at least once")
    tasks = tasks or doublings(spark.sparkContext.defaultParallelism)
    head = reader(spark, path, table="header").first()
    out: list[tuple] = []
    if operation != "write":
        for n in tasks:
            work = lambda n=n: reader(spark, path).coalesce(n).write.format("noop").mode("overwrite").save()
            out += [(OWN, "read", n, k, t) for k, t in _timed(work, warmup, iterations)]
        out += [(BYTES, "read", 0, k, t) for k, t in _timed(lambda: read_bytes(spark, path), warmup, iterations)]
    if operation != "read":
        target = keep or f"{path}.bench-{uuid.uuid4().hex}.laz"
        options = {"format": head.format, "extrabytes": head.extra_bytes, "compressed": str(head.compressed).lower(), "chunk_size": chunk_size} | {f"{k}_{a}": repr(head[f"{k}_{a}"]) for k in ("scale", "offset") for a in "xyz"}
        points = reader(spark, path)
        points = points.select(*(c for c in points.columns if c != "point_index"))
        try:
            for n in tasks:
                out += [(OWN, "write", n, k, t) for k, t in _timed(lambda n=n: onefile.write(points.coalesce(n), target, **options), warmup, iterations)]
        finally:
            if not keep and os.path.exists(target):
                os.remove(target)
    return spark.createDataFrame(out, TIMINGS)


def summary(timed: DataFrame, n_points: int, size: int) -> DataFrame:
    """One row for each operation, tool and number of tasks: n, mean, min and max seconds, Mpts/s and MB/s (0 where no time passed).

    Reads come before writes, the own tool first, then by name and number of tasks.
    """
    t, mean = F.col("time_s"), F.col("mean_s")
    rate = lambda v: F.when(mean > 0, F.lit(v / 1e6) / mean).otherwise(0.0)
    rows = timed.groupBy("operation", "tool", "threads").agg(F.count(t).alias("n"), F.avg(t).alias("mean_s"), F.min(t).alias("min_s"), F.max(t).alias("max_s"))
    rows = rows.withColumns({"mpts_s": rate(n_points), "mb_s": rate(size)})
    return rows.orderBy("operation", F.col("tool") != OWN, "tool", "threads")


def report(spark: SparkSession, path: str, timed: DataFrame) -> str:
    """Facts of the file and all timings as JSON, in the order of the summary and of iterations."""
    head = reader(spark, path, table="header").first()
    rows = timed.orderBy("operation", F.col("tool") != OWN, "tool", "threads", "iteration").collect()
    facts = {"platform": sys.platform, "has_thread_control": True, "hardware_threads": spark.sparkContext.defaultParallelism, "file": path, "num_points": head.n_points, "file_size_bytes": read_bytes(spark, path), "point_format": head.format, "is_compressed": head.compressed}
    return json.dumps(facts | {"results": [r.asDict() for r in rows]}, indent=2)


def table(rows: DataFrame) -> str:
    """The summary as text, a block for each operation."""
    out, last = [], None
    for r in rows.collect():
        if r.operation != last:
            last = r.operation
            out += [f"{last}", f"{'tool':<20}{'tasks':>8}{'mean s':>10}{'min s':>10}{'max s':>10}{'Mpts/s':>10}{'MB/s':>10}"]
        out.append(f"{r.tool:<20}{r.threads or 'default':>8}{r.mean_s:>10.3f}{r.min_s:>10.3f}{r.max_s:>10.3f}{r.mpts_s:>10.3f}{r.mb_s:>10.2f}")
    return "\n".join(out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--file", required=True)
    p.add_argument("--tasks", type=lambda v: [int(x) for x in v.split(",")])
    p.add_argument("--operation", default="read", choices=["read", "write", "both"])
    p.add_argument("--warmup", type=int, default=1)
    p.add_argument("--iterations", type=int, default=3)
    p.add_argument("--chunk-size", type=int, default=50_000)
    p.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    timed = timings(spark, a.file, a.tasks, a.operation, a.warmup, a.iterations, a.chunk_size)
    if a.json:
        print(report(spark, a.file, timed))
    else:
        print(table(summary(timed, reader(spark, a.file, table="header").first().n_points, read_bytes(spark, a.file))))


if __name__ == "__main__":
    main()
