"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters whole records by a seeded hash of id and text into buckets of a size that fits in memory, one shuffle
partition each, and before that, where they are more than one shuffle should have, into coarse buckets of many. Pass two puts each bucket in a fixed order, permutes it by a Fisher-Yates shuffle that is seeded by the
bucket's number, and deals the records, counted on from bucket to bucket, to the shards in turn. Shard sizes differ by one
row at most (law `rows`), and each shard's records are in random order. The same rows and seed give the same shards,
however the input is split into files or tasks, so a task that is run again makes the same bucket.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointmill.llm.common import shared_folder, text_bytes, written

OVERHEAD = 16
#: Bytes of one bucket; a task holds a few copies of it.
BUCKET_BYTES = 24 << 20
#: Buckets whose counts one task adds up; buckets, and so shuffle partitions, of one pass at most.
BLOCK = MOST_BUCKETS = 4096


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _scattered(docs: DataFrame, seed: int) -> DataFrame:
    """_row (all columns), _size and _mark, the seeded hash; rows alike in id and text are told apart by a number.

    Numbers are needed only where there are such rows, so that a group of very many of them is scattered as well. Which of
    them gets which number is left open: they differ in other columns at most.
    """
    columns = docs.columns
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    key = docs.select(F.col("doc_id").alias("_i"), text.alias("_t"))
    again = written(key.groupBy("_i", "_t").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_i", "_t"), "again")
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), record_size(F.col("text")).alias("_size"), F.col("doc_id").alias("_id"), text.alias("_text"))
    if again.isEmpty():
        sized = sized.withColumn("_copy", F.lit(0).cast("long"))
    else:
        joined = sized.join(again, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t")), "left")
        sized = written(joined.withColumn("_copy", F.when(F.col("_t").isNotNull(), F.monotonically_increasing_id()).otherwise(0)).drop("_i", "_t"), "copies")
    return sized.select("_row", "_size", F.xxhash64(F.lit(seed), "_id", "_text", "_copy").alias("_mark"))


def _permuted(scattered: DataFrame, starts: DataFrame, columns: list[str], seed: int, first: int, n: int) -> DataFrame:
    """The rows of buckets first to first + n - 1 with their places; n is bounded, so are the buckets' starts."""
    # a bucket is the partition of its number; marks and the row itself give it one order, whatever order records arrive in,
    # and shuffle(), which counts partitions on from its seed, then permutes it
    order = lambda a, b: F.when(a["_mark"] < b["_mark"], -1).when(a["_mark"] > b["_mark"], 1).otherwise(0)
    own = scattered.withColumn("_at", F.col("_bucket") - first).repartitionById(n, "_at")
    own = own.groupBy("_at", "_bucket").agg(F.array_sort(F.collect_list(F.struct("_mark", "_size", "_row")), order).alias("_all"))
    own = own.select("_bucket", F.shuffle("_all", seed + first).alias("_all"))
    dealt = own.join(F.broadcast(starts), "_bucket").select("_start", F.posexplode("_all").alias("_i", "_x"))
    return dealt.select(*(F.col("_x._row")[c].alias(c) for c in columns), F.col("_x._size").alias("_size"), (F.col("_start") + F.col("_i")).alias("_place"))


def shuffled(docs: DataFrame, seed: int = 42, bucket_bytes: int = BUCKET_BYTES, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """All columns of docs and _size and _place, the record's place in a random order of all (0 to n - 1).

    Beyond most_buckets buckets, records are first scattered to coarse buckets of so many, written as folders, and each coarse one
    is then scattered by itself, in a job of its own; places are the same either way.
    """
    columns, spark = docs.columns, docs.sparkSession
    total = docs.select(F.sum(record_size(F.col("text")))).first()[0] or 0
    n = max(1, math.ceil(total / bucket_bytes))
    scattered = _scattered(docs, seed).withColumn("_bucket", F.pmod("_mark", F.lit(n)).cast("int"))
    if n > most_buckets:
        # a coarse bucket may be of many gigabytes: its rows are dealt to some tasks by their marks
        coarse = scattered.withColumn("_coarse", (F.col("_bucket") / most_buckets).cast("int"))
        path = f"{shared_folder(spark)}/coarse-{uuid.uuid4().hex}"
        coarse.repartition("_coarse", F.pmod(F.shiftright("_mark", 40), F.lit(8))).write.partitionBy("_coarse").parquet(path)
        scattered = spark.read.schema(coarse.schema).parquet(path)
    counts = scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    blocks = counts.withColumn("_block", (F.col("_bucket") / BLOCK).cast("int"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = blocks.groupBy("_block").agg(F.sum("_n").alias("_total")).select("_block", before(Window.orderBy("_block"), "_total").alias("_base"))
    starts = blocks.join(tops, "_block").select("_bucket", (F.col("_base") + before(Window.partitionBy("_block").orderBy("_bucket"), "_n")).alias("_start"))
    starts = written(starts, "starts")
    if n <= most_buckets:
        return _permuted(scattered, starts, columns, seed, 0, n)
    out = f"{shared_folder(spark)}/permuted-{uuid.uuid4().hex}"
    for k, first in enumerate(range(0, n, most_buckets)):
        size = min(most_buckets, n - first)
        own = starts.where(F.col("_bucket").between(first, first + size - 1))
        rows = _permuted(scattered.where(F.col("_coarse") == k).drop("_coarse"), own, columns, seed, first, size)
        rows.write.parquet(f"{out}/coarse={k}")
    return spark.read.schema(rows.schema).parquet(*(f"{out}/coarse={k}" for k in range(k + 1)))


def shard(docs: DataFrame, n_shards: int, seed: int = 42, bucket_bytes: int = BUCKET_BYTES, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """All columns of docs and size, law, shard and slot; slots of a shard are gapless from 0.

    A null text has no bytes and is dealt like an empty one. Null and repeated ids, texts and rows are kept and dealt like any
    others; a text larger than a bucket makes its bucket larger. Columns of docs named like the new ones are left out. An
    empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("size", "law", "shard", "slot", "_size", "_place", "_row", "_mark", "_bucket", "_at", "_coarse")]
    rows = shuffled(docs.select(*(F.col(f"`{c}`") for c in kept)), seed, bucket_bytes, most_buckets)
    place = F.col("_place")
    return rows.select(*kept, F.col("_size").alias("size"), F.lit("rows").alias("law"), (place % n_shards).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes the shards as Parquet under path, a folder shard=K each, rows in the order of their slots; returns them."""
    rows = shard(docs, n_shards, seed, bucket_bytes)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def digest(shards: DataFrame) -> DataFrame:
    """The contract's columns of a shard() result."""
    return shards.select(
        "doc_id", "size", F.crc32(text_bytes()).cast("long").alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
