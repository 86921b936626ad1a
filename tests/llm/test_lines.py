import random

import duckdb
import numpy as np
import pytest

from pointmill.llm import op7_lines


def test_first_hashes_in_common():
    """Keys that share their first hash are all indexed."""
    h, g = np.array([5, 9, 5, 5], np.int64), np.array([1, 2, 3, 4], np.int64)
    shard = op7_lines.shard_of(h, g, np.full(4, 6), np.array([10, 20, 30, op7_lines.NO_ID]))
    probe_h, probe_g = np.array([5, 5, 5, 5, 9, 7, 5], np.int64), np.array([1, 1, 3, 3, 2, 2, 4], np.int64)
    own = np.array([10, 11, 30, 31, 1, 1, 1], np.int64)
    assert op7_lines._gone(shard, probe_h, probe_g, own).tolist() == [False, True, False, True, True, False, False]


@pytest.mark.parametrize("bound", [op7_lines.INDEX_BYTES, 0])
def test_equals_sql(spark, bound, monkeypatch):
    """Both ways of probing against the SQL, with several shards; columns of any names pass through."""
    monkeypatch.setattr(op7_lines, "SHARD_KEYS", 7)
    rng = random.Random(2)
    lines = [f"line {i} " + "long enough to count as a key, forty" for i in range(60)] + ["short", "", " \t"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(40))) if i % 9 else None, i % 3) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(4)
    got = op7_lines.dedup(docs, ["doc_id", "shard"], index_bytes=bound).collect()
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(op7_lines.SQL).fetchall()
    import hashlib

    assert sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == sorted(want)
    assert all(r.shard == r.doc_id % 3 for r in got) and sum(w[2] for w in want) > 100
    assert op7_lines.dedup(docs.limit(0), ["doc_id"], index_bytes=bound).count() == 0


def test_a_very_frequent_line(spark, monkeypatch):
    """Beyond the bound, the lines of a shard are dealt to tasks by the count of its most frequent key."""
    monkeypatch.setattr(op7_lines, "PART_ROWS", 3)
    rows = [(i, f"the very same line in each and every document\nown line number {i}, long enough to be a key {i % 7}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keys = op7_lines.frequent(docs)
    assert [r.parts for r in op7_lines.index_shards(keys, keys.count())[1].collect()] == [30]
    got = op7_lines.dedup(docs, ["doc_id"], index_bytes=0).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == sorted(op7_lines.brute(rows))


@pytest.mark.parametrize("bound", [op7_lines.INDEX_BYTES, 0])
def test_bytes_that_are_no_utf8(spark, bound):
    docs = spark.range(6).selectExpr("id AS doc_id", "cast(concat(X'61FF0A', repeat('same line ', 6)) AS string) AS text")
    got = op7_lines.dedup(docs, ["doc_id"], index_bytes=bound).orderBy("doc_id").collect()
    assert [r.kept for r in got[:5]] == ["a\ufffd"] * 5 and got[5].kept == "a\ufffd\n" + "same line " * 6
