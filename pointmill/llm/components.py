"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import remove, written

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, for all nodes of links (columns a and b, unordered, no nulls).

    Alternates two steps until nothing changes: each node links its larger neighbours to its smallest one, then its
    smaller neighbours to the smallest. Every step is an aggregation by node that only keeps a minimum, and a join back;
    a node of very many links is combined before the shuffle and split in the join by Spark. Each round is written to
    the shared folder and the one before removed.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(ROUNDS):
        # large star
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        remove(edges)
        edges = now
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
