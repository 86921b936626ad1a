from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.llm import op1_quality, op2_toxicity, op6_substrings

SF = "/root/testdata/sf0.01"


def rank_sum(rows):
    """The share of pairs of a labelled and an unlabelled row that the scores order rightly."""
    ones, zeros = [r.score for r in rows if r.y], [r.score for r in rows if not r.y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize(("module", "label", "least"), [(op1_quality, "quality", 0.95), (op2_toxicity, "toxic", 0.75)])
def test_held_out(spark, module, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = module.classify(docs, labels)
    assert out.count() == docs.count()
    assert rank_sum(out.where("held_out").join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").collect()) >= least


@pytest.mark.parametrize("module", [op1_quality, op2_toxicity])
def test_odd_rows(spark, module):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "some words", None), (3, "word " * 9999, "y"), (3, "word " * 9999, "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 0), (None, 1, 1), (3, 0, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = module.classify(docs, known).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert module.classify(docs.limit(0), labels).count() == 0


def test_toxic_expressions(spark):
    """Pairs of words that only one class uses, or that begin a text, weigh for that class."""
    rows = [(i, f"common words number {i % 50} here zot qux and more", 1) for i in range(400)] + [(400 + i, f"common words number {i % 50} here and more", 0) for i in range(400)]
    rows += [(800 + i, f"yak {i % 50}", 1) for i in range(200)] + [(1000 + i, f"gnu {i % 50}", 0) for i in range(200)]
    found = op2_toxicity.weights(spark.createDataFrame(rows, "doc_id long, text string, y int").withColumn("text", F.col("text").cast("binary")))
    weight = {r.key: r.weight for r in found.collect()}
    pair = lambda text: int(op2_toxicity.pair_keys(op2_toxicity.word_numbers(text))[-1])
    assert weight.get(pair(b"zot qux"), 0) > 0  # each word follows one other only, in toxic texts only
    assert weight.get(pair(b"yak"), 0) > 0 > weight.get(pair(b"gnu"), 0)  # after START
    assert weight.get(pair(b"words number"), 0) == 0


def test_pooled_vectors_by_hand(spark, monkeypatch):
    """Word vectors and pooling against sums word by word, over several tasks and parts of texts."""
    texts = ["one two three two one", "", None, "three, three one !! two", "one " * 30]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    places, signs = op1_quality.index_vectors()
    want = np.zeros((op1_quality.BUCKETS, op1_quality.DIMS))
    for t in texts:
        w = op1_quality.numbers((t or "").encode())
        for i, a in enumerate(w):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                for k in range(op1_quality.ONES) if i != j else ():
                    want[a, places[w[j], k]] += signs[w[j], k]
    want /= np.linalg.norm(want, axis=1, keepdims=True) + 1
    got = op1_quality.word_vectors(docs)
    assert np.allclose(got, want, atol=1e-6)
    w = [got[i] for i in op1_quality.numbers(texts[3].encode())]
    by_hand = np.concatenate((np.mean(w, axis=0), np.mean([np.abs(b - a) for a, b in zip(w, w[1:], strict=False)], axis=0)))
    monkeypatch.setattr(op1_quality, "HELD", 2)
    assert np.allclose(op1_quality.pooled(texts[3].encode(), got), by_hand, atol=1e-6)
    assert not op1_quality.pooled(b"", got).any()


def test_toxicity_sums_to_one(spark):
    """The table's differences are those of two models, worked out word by word, whose probabilities sum to one."""
    rng = np.random.default_rng(5)
    texts = [(int(i % 4 == 0), " ".join(f"w{x}" for x in rng.zipf(1.5, 30) % 40) + (" bad thing" if i % 8 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame([(y, bytearray(t.encode())) for y, t in texts], "y int, text binary").repartition(3)
    discounts = {"word_discount": 1.5, "pair_discount": 2.0, "shared": 3.0}
    got = op2_toxicity.weights(docs, **discounts).toPandas()
    table = op2_toxicity.Table(got["key"].to_numpy(), got["weight"].to_numpy())
    n = [Counter(), Counter()]
    for y, t in texts:
        w = ["^", *t.split()]
        n[y].update(zip(w, w[1:], strict=False))
    words = {w for c in n for _, w in c}
    before = {w: [sum(b == w for _, b in c) for c in n] for w in words}
    b, size = [len(c) for c in n], [sum(c.values()) for c in n]
    own = lambda a, other, rate: max(a - rate - 3.0 * other, 0)
    pool = {w: sum(before[w]) / (sum(b) + 1) for w in words}
    single = [{w: own(before[w][c] / b[c], before[w][1 - c] / b[1 - c], 1.5 / min(b)) for w in words} for c in (0, 1)]
    mass = [1 - sum(x.values()) for x in single]
    p1 = lambda c, w: single[c].get(w, 0) + mass[c] * pool.get(w, 1 / (sum(b) + 1))
    held = [Counter(), Counter()]
    for c in (0, 1):
        for (h, _), k in n[c].items():
            held[c][h] += k
    share = lambda c, h, w: n[c][h, w] / held[c][h] if held[c][h] else 0.0
    direct = lambda c, h, w: own(share(c, h, w), share(1 - c, h, w), 2.0 / min(size) * size[c] / held[c][h]) if held[c][h] else 0.0
    p2 = lambda c, h, w: direct(c, h, w) + (1 - sum(direct(c, h, x) for x in words)) * p1(c, w)
    for c in (0, 1):
        assert sum(p1(c, w) for w in [*words, None]) == pytest.approx(1)
        for h in ["^", "w1", "w2", "bad", "never"]:
            assert sum(p2(c, h, w) for w in [*words, None]) == pytest.approx(1)
    for text in ["w1 w2 bad thing w3", "w1 w1 w1", "thing bad", "never seen"]:
        w = ["^", *text.split()]
        want = sum(np.log(p2(1, h, x) / p2(0, h, x)) for h, x in zip(w, w[1:], strict=False)) / (len(w) - 1)
        assert table.difference(text.encode()) == pytest.approx(want, rel=1e-4, abs=1e-6)
    assert table.difference(b"bad thing") > 0 > table.difference(b"w1 w1 w1")


def test_labelled_rows(spark):
    """The bit array loses no labelled row."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(b"x").alias("text"))
    known = spark.range(0, 3000, 7).select(F.col("id").alias("doc_id"), F.lit(1).alias("y"))
    assert sorted(r.doc_id for r in op2_toxicity.labelled_rows(rows, known).collect()) == list(range(0, 3000, 7))


@pytest.mark.parametrize(("length", "anchor"), [(400, 32), (20, 4)])
def test_substrings(spark, length, anchor):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").collect()]
    run = "abcdefg hijklmn opq rst " * 30
    rows += [(900, None), (901, ""), (None, run), (902, "x" * 399), (903, "z" * 1001), (904, "ä" * 300), (905, "start " + run[:450] + " end"), (906, run[:450]), (906, run[:450])]
    got = op6_substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("u", F.lit(1)).repartition(3), length, anchor).collect()
    want = op6_substrings.brute([(t or "").encode() for _, t in rows], length)
    assert sorted((str(r.doc_id), r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))


def test_substrings_of_nothing(spark):
    assert op6_substrings.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
