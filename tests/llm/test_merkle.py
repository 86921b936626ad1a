"""The manifest against a plain tree in Python."""

import hashlib
import zlib

import duckdb
import pyarrow as pa
import pytest

from pointmill.llm import op11_merkle

KIND = "doc_id long, text string, lang string, source string, n_chars long, leaf string, at long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    i, text, lang, source, n, *_ = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes, fanout):
    """The root, and each leaf's siblings by level with its place."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            start = i // fanout * fanout
            run = nodes[start : start + fanout]
            proofs[k].append((i - start, run[: i - start] + run[i - start + 1 :]))
            at[k] = i // fanout
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def expected(rows, fanout):
    sources = {}
    for r in rows:
        sources.setdefault((r[3] is not None, (r[3] or "").encode()), []).append(r)
    out, roots, subs = [], [], []
    for _, own in sorted(sources.items()):
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, proofs = tree([leaf(r) for r in own], fanout)
        roots.append(sub)
        subs.append((own, proofs))
    root, upper = tree(roots, fanout)
    for sub, (own, proofs), up in zip(roots, subs, upper, strict=True):
        for r, p in zip(own, proofs, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, hit)
            for at, siblings in p + up:
                node = h(*siblings[:at], node, *siblings[at:])
            out.append((r[0], leaf(r), sub, root, h(*(s for _, run in p + up for s in run)), node, node == root))
    return sorted(map(repr, out))


def rows_of(n, sources):
    return [(i, f"Text {i} Ab" if i % 3 else f"plain {i}", "en", sources[i % len(sources)], i * 7, "x", 1) for i in range(n)]


ODD = [(None, "A", None, None, None, "x", 1), (None, None, "de", None, 3, "x", 1), (5, "", "", "", 0, None, None), (5, "", "", "", 0, None, None), (5, "Z", "", "", 0, None, None), (9, "é" * 200_000 + "É", "fr", "z", 1, None, None)]


def got(docs):
    return sorted(repr(tuple(r)) for r in op11_merkle.digest(docs).collect())


def test_production_fanout(spark):
    """One source of more nodes than a bucket, small ones, a lone leaf, nulls, repeated rows and a very long text."""
    rows = rows_of(4500, ["a"]) + [(10_000 + r[0], *r[1:]) for r in rows_of(40, ["b", None])] + ODD
    docs = spark.createDataFrame(rows, KIND).repartition(5)
    assert got(docs) == expected(rows, 16)
    assert op11_merkle.digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 9, 28, 65])
def test_small_trees(spark, n, monkeypatch):
    """Many rounds of small buckets, many sources, every size of a last run."""
    rows = rows_of(n, ["a"]) + [(1000 + i, "T", "en", f"s{i}", 1, None, None) for i in range(n % 11)]
    nodes = op11_merkle.leaves(spark.createDataFrame(rows, KIND).repartition(3))
    proved = op11_merkle.prove(nodes, 2, 2)
    out = [(r.doc_id, r.leaf, r.subroot, r.root, h(r.proof), r.folded, r.folded == r.root) for r in proved.withColumn("folded", op11_merkle.fold("other")).collect()]
    assert sorted(map(repr, out)) == expected(rows, 2)
    if n == 65:
        assert proved.select(op11_merkle.fold("leaf").alias("f"), "root").where("f <> root").count() == 0


def test_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert got(docs) == expected(rows, 16)


@pytest.mark.parametrize("rows", [rows_of(300, ["a", None, "é"]) + [(10_000 + i, "T", "en", f"s{i}", 1, None, None) for i in range(20)] + ODD, rows_of(1, ["a"]), []])
def test_sql(rows):
    kinds = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    documents = pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds)})  # noqa: F841
    assert sorted(map(repr, duckdb.sql(op11_merkle.SQL).fetchall())) == (expected(rows, 16) if rows else [])
