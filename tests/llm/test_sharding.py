import zlib
from collections import Counter

import pytest

from pointmill.llm import op9_sharding

KIND = "doc_id long, text string, lang string, size string, shard int, slot long"




@pytest.fixture(scope="module")
def rows():
    out = [(i, f"text {i} " * (i % 7), "en", "clash", 3, 4) for i in range(150)]
    return out + [(None, None, None, None, None, None)] * 30 + [(5, "same", "x", None, 1, 1)] * 40 + [(6, "", "x", None, 1, 1), (200, "ä" * 9000, None, None, None, None)]


def test_law_and_digest(spark, rows):
    docs = spark.createDataFrame(rows, KIND)
    got = op9_sharding.digest(op9_sharding.shard(docs, 7, bucket_bytes=2000)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = [sorted(r.slot for r in got if r.shard == k) for k in range(7)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_same_seed_same_shards(spark, rows):
    """However the input is dealt out, rows that differ in id or text get the same places; another seed gives others."""
    docs = spark.createDataFrame([r for r in rows if r[0] is not None and r[1] != "same"], KIND)
    place = lambda df, seed: {(r.doc_id, r.text): (r.shard, r.slot) for r in op9_sharding.shard(df, 5, seed, 3000).collect()}
    one = place(docs.repartition(2), 1)
    assert one == place(docs.repartition(5, "text"), 1) == place(docs.coalesce(1).orderBy("doc_id", ascending=False), 1)
    other = place(docs, 2)
    assert sum(one[k] == other[k] for k in one) < len(one) / 5


def test_buckets_are_even(spark):
    """Rows alike in id and text are scattered as well."""
    docs = spark.range(4000).selectExpr("cast(null as long) doc_id", "'copy' text")
    marks = op9_sharding._scattered(docs, 3).selectExpr("pmod(_mark, 20) b").groupBy("b").count().collect()
    assert len(marks) == 20 and max(r["count"] for r in marks) < 300


def test_written_shards(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, KIND)
    got = op9_sharding.write_shards(docs, str(tmp_path / "out"), 3, bucket_bytes=4000)
    assert got.count() == len(rows) and sorted(r.shard for r in got.select("shard").distinct().collect()) == [0, 1, 2]
    assert op9_sharding.shard(docs.limit(0), 3).count() == 0


def test_coarse_buckets(spark, rows):
    """More buckets than one pass may have: several passes of few partitions, with the same places as one."""
    docs = spark.createDataFrame([r for r in rows if r[0] is not None and r[1] != "same"], KIND).repartition(3)
    place = lambda most: {(r.doc_id, r.text): (r.shard, r.slot) for r in op9_sharding.shard(docs, 5, 1, 500, most).collect()}
    one = place(4096)
    assert one == place(8) == place(3) and len(one) == 152


def test_a_text_larger_than_its_bucket(spark):
    docs = spark.createDataFrame([(i, "x" * (5_000_000 if i == 3 else 10)) for i in range(20)], "doc_id long, text string")
    got = op9_sharding.shard(docs, 4, bucket_bytes=1_000_000).select("doc_id", "size", "shard", "slot").collect()
    assert sorted(r.doc_id for r in got) == list(range(20)) and max(r["size"] for r in got) == 5_000_016
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(4) for k in range(5)]
