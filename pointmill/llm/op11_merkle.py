"""Merkle manifest of a table of documents: leaves, a subroot for each source, one root, and a proof for each row.

Superblock reduction: a source's nodes are numbered, and those whose number over fanout^levels is the same make a bucket.
applyInPandas collapses a bucket's levels at once; the buckets' roots are the nodes of the next round, until every source
has one node. The sources' subroots are reduced in the same way to the root. Going down again, a bucket meets the one proof
of its own root and puts it behind the lower proof of each of its nodes.

A bucket has at most fanout^levels rows however large its source is. Numbers come from one sort by range: each sorted
partition counts its rows by source, and running sums over those few counts place them. Tables between rounds are written to
the shared folder; each round has one row in fanout^levels of the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointmill.llm.common import lower_ascii, remove, written

FANOUT, LEVELS = 16, 3
#: Characters of a digest as text.
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*values: Column) -> Column:
    """SHA-256 in hexadecimal of the values, each with its length in bytes in front, or `-` if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf of every row, and other: the leaf after tampering, which lower-cases A-Z of the texts whose
    doc_id as decimal text has a CRC-32 that 5 divides (a null doc_id has none)."""
    text = F.col("text").cast("string")
    rest = [F.col(c) for c in FIELDS[:-1]]
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), digest_of(*rest, text).alias("leaf"),
        F.when(hit, digest_of(*rest, lower_ascii(text))).alias("other"),
    ).withColumn("other", F.coalesce("other", "leaf"))


def numbered(df: DataFrame, part: str, *order: str) -> DataFrame:
    """df with at, each row's number from 0 within its part by the order given, and n, the part's rows; written.

    Rows alike in part and order are spread by their place in the input, so that no task gets all copies of one row.
    """
    keys = [part, *order, "_tie"]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    table = written(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_row", F.monotonically_increasing_id()), "placed")
    placed = table.withColumn("_task", F.shiftright("_row", 33))
    runs = placed.groupBy(part, "_task").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_own"))
    whole = Window.partitionBy(part)
    before = F.sum("_own").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(part, "_task", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_own").over(whole).alias("n"))
    out = written(placed.join(runs, [part, "_task"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_row", "_task", "_shift"), "numbered")
    remove(table)
    return out


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def floors(nodes: list[str], n: int, fanout: int, levels: int) -> list[list[str]]:
    """A bucket's nodes level by level: all levels if its part has more nodes than one bucket, else until one node is left."""
    out, many = [nodes], n > fanout**levels
    while len(out) <= levels if many else len(out[-1]) > 1:
        low = out[-1]
        out.append([_hash(low[i : i + fanout]) for i in range(0, len(low), fanout)])
    return out


def _collapse(fanout: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("at")
        n, first = int(bucket["n"].iloc[0]), bucket.iloc[0]
        top = floors(bucket["node"].tolist(), n, fanout, levels)[-1]
        return pd.DataFrame({"part": [first["part"]], "at": [first["bucket"]], "node": top, "n": [-(-n // fanout**levels)]})

    return run


PLACES = pa.list_(pa.struct([("at", pa.int32()), ("of", pa.int32())]))
_PROOF = "proof string, places array<struct<at: int, of: int>>, subroot string, root string"


def _proofs(nodes: list[str], n: int, upper: tuple[str, list], fanout: int, levels: int) -> list[tuple[str, list]]:
    """For each node of a bucket its siblings' digests up to the root, as one text, and its place in each run."""
    found = [upper]
    for low in reversed(floors(nodes, n, fanout, levels)[:-1]):
        above, found = found, []
        for start in range(0, len(low), fanout):
            run = low[start : start + fanout]
            whole, (proof, places) = "".join(run), above[start // fanout]
            found += [(whole[: HEX * i] + whole[HEX * (i + 1) :] + proof, [{"at": i, "of": len(run)}, *places]) for i in range(len(run))]
    return found


def _extend(fanout: int, levels: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(bucket: pa.Table, top: pa.Table) -> pa.Table:
        bucket, (top,) = bucket.sort_by("at"), top.to_pylist()
        found = _proofs(bucket["node"].to_pylist(), bucket["n"][0].as_py(), (top["proof"], top["places"]), fanout, levels)
        rows = bucket.num_rows
        new = {"proof": [p for p, _ in found], "places": [p for _, p in found], "subroot": [top["subroot"]] * rows, "root": [top["root"]] * rows}
        return pa.table([pa.array(new[f.name], f.type) if f.name in new else bucket[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def _up(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The rounds' nodes, part, at, node, n, from those given to one node for each part."""
    rounds = [nodes]
    size = fanout**levels
    while not rounds[-1].where("n > 1").isEmpty():
        low = rounds[-1].select("part", "at", "node", "n", F.expr(f"at div {size}").alias("bucket"))
        rounds.append(written(low.groupBy("part", "bucket").applyInPandas(_collapse(fanout, levels), "part string, at long, node string, n long"), "nodes"))
    return rounds


def _down(rounds: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The rows of the first round with proof, places, subroot and root; tops has those of each part's last node."""
    proofs = tops.select("part", F.lit(0).cast("long").alias("bucket"), "proof", "places", "subroot", "root")
    if len(rounds) == 1:
        return rounds[0].join(proofs.drop("bucket"), "part")
    out = proofs
    for k, low in enumerate(reversed(rounds[:-1])):
        kept = [f for f in low.schema if k == len(rounds) - 2 or f.name in ("part", "at")]
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + _PROOF
        schema = pa.schema([*((f.name, pa.string() if f.dataType.simpleString() == "string" else pa.int64()) for f in kept), ("proof", pa.string()), ("places", PLACES), ("subroot", pa.string()), ("root", pa.string())])
        buckets = low.withColumn("bucket", F.expr(f"at div {fanout**levels}"))
        tied = buckets.groupBy("part", "bucket").cogroup(proofs.groupBy("part", "bucket"))
        out = tied.applyInArrow(_extend(fanout, levels, schema), kind)
        if k < len(rounds) - 2:
            proofs = written(out.withColumnRenamed("at", "bucket"), "proofs")
    return out


def prove(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest of doc_id, source and leaf (texts; other columns of texts are carried along): adds subroot, root, proof and places.

    proof holds the digests of the siblings in each run from the leaf to the root, left to right, as one text; places has
    for each run the node's number in it and the run's nodes. Leaves ascend by doc_id within a source, a null doc_id first,
    rows of one doc_id by leaf; a null source is a source of its own, before all others. A source's lone leaf is its subroot, a lone
    subroot the root. An empty table gives an empty result.
    """
    part = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    first = written(nodes.withColumn("part", part), "leaves")  # hashed once, not again for the ranges
    rounds = _up(numbered(first, "part", "doc_id", "leaf").withColumnRenamed("leaf", "node"), fanout, levels)
    remove(first)
    subroots = rounds[-1].select("part", F.col("node").alias("subroot"))
    inner = numbered(subroots.withColumn("whole", F.lit("whole")), "whole", "part").select(F.col("whole").alias("part"), "at", F.col("subroot").alias("node"), "n", F.col("part").alias("own"))
    above = _up(inner, fanout, levels)
    root = above[-1].select("part", F.lit("").alias("proof"), F.expr("cast(array() AS array<struct<at: int, of: int>>)").alias("places"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    tops = _down(above, root, fanout, levels).select(F.col("own").alias("part"), "proof", "places", F.col("node").alias("subroot"), "root")
    out = _down(rounds, written(tops, "tops"), fanout, levels)
    return out.withColumnRenamed("node", "leaf").drop("part", "at", "n")


def fold(leaf: Column | str, proof: Column | str = "proof", places: Column | str = "places") -> Column:
    """The root that a leaf and the siblings of its proof give."""
    leaf, proof, places = (F.col(c) if isinstance(c, str) else c for c in (leaf, proof, places))
    start = F.struct(leaf.alias("node"), F.lit(1).alias("at"))

    def step(done: Column, place: Column) -> Column:
        left, right = place["at"] * HEX, (place["of"] - place["at"] - 1) * HEX
        run = F.concat(F.substring(proof, done["at"], left), done["node"], F.substring(proof, done["at"] + left, right))
        return F.struct(F.sha2(run, 256).alias("node"), (done["at"] + left + right).alias("at"))

    return F.aggregate(places, start, step)["node"]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: whether the root that the tampered leaf and its proof give is the root.

    Nulls in any column, repeated ids and rows, and columns besides those of documents are allowed: see leaves() and prove().
    """
    proved = prove(leaves(docs))
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), fold("other").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same in SQL for small tables.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS part, source, lang, n_chars, text,
         CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
              lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 5 = 0
              THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM documents),
h AS (SELECT doc_id, part, sha256(b || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(b || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS other
  FROM (SELECT *, coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
             || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS b FROM d)),
r AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM h),
low AS (SELECT part, 0 AS lvl, idx, leaf AS node, n FROM r
  UNION ALL SELECT part, lvl + 1, idx // 16, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 15) // 16 FROM low WHERE n > 1 GROUP BY part, lvl, idx // 16),
s AS (SELECT part, node AS subroot, row_number() OVER (ORDER BY encode(part)) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (SELECT 0 AS lvl, idx, subroot AS node, n FROM s
  UNION ALL SELECT lvl + 1, idx // 16, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 15) // 16 FROM top WHERE n > 1 GROUP BY lvl, idx // 16),
p AS (SELECT rid, 0 AS tree, l.lvl, l.idx, l.node FROM r JOIN low l ON l.part = r.part AND l.n > 1 AND l.idx // 16 = r.idx // CAST(pow(16, l.lvl + 1) AS BIGINT) AND l.idx <> r.idx // CAST(pow(16, l.lvl) AS BIGINT)
  UNION ALL SELECT rid, 1, t.lvl, t.idx, t.node FROM r JOIN s ON s.part = r.part JOIN top t ON t.n > 1 AND t.idx // 16 = s.idx // CAST(pow(16, t.lvl + 1) AS BIGINT) AND t.idx <> s.idx // CAST(pow(16, t.lvl) AS BIGINT)),
q AS (SELECT rid, sha256(string_agg(node, '' ORDER BY tree, lvl, idx)) AS proof FROM p GROUP BY rid),
f AS (SELECT rid, part, 0 AS lvl, idx, other AS node, n FROM r
  UNION ALL SELECT f.rid, f.part, f.lvl + 1, f.idx // 16, sha256(string_agg(CASE WHEN l.idx = f.idx THEN f.node ELSE l.node END, '' ORDER BY l.idx)), (any_value(f.n) + 15) // 16
  FROM f JOIN low l ON l.part = f.part AND l.lvl = f.lvl AND l.idx // 16 = f.idx // 16 WHERE f.n > 1 GROUP BY f.rid, f.part, f.lvl, f.idx),
g AS (SELECT f.rid, 0 AS lvl, s.idx, f.node, s.n FROM f JOIN s ON s.part = f.part WHERE f.n = 1
  UNION ALL SELECT g.rid, g.lvl + 1, g.idx // 16, sha256(string_agg(CASE WHEN t.idx = g.idx THEN g.node ELSE t.node END, '' ORDER BY t.idx)), (any_value(g.n) + 15) // 16
  FROM g JOIN top t ON t.lvl = g.lvl AND t.idx // 16 = g.idx // 16 WHERE g.n > 1 GROUP BY g.rid, g.lvl, g.idx)
SELECT r.doc_id, r.leaf, s.subroot, top.node AS root, coalesce(q.proof, sha256('')) AS proof_sha256, g.node AS folded_root, g.node = top.node AS verified
FROM r JOIN s ON s.part = r.part JOIN top ON top.n = 1 JOIN g ON g.rid = r.rid AND g.n = 1 LEFT JOIN q ON q.rid = r.rid
"""
