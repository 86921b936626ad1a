"""Operators that choose rows: by the row itself, not by its id."""

import numpy as np
import pytest
import xxhash

from pointmill.llm import op4_decontaminate, op8_simhash

KIND = "doc_id long, text string, fp int, start_word string"
T, U = "a text of some words that is the same in several rows of the table", "quite another text with other words in it"
ITEM = "the quick brown fox jumps over the lazy dog while seven other animals look on from far away"


def kept(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_first_of_groups(spark):
    rows = [(None, T, 1, "x"), (None, U, 2, None), (5, T, 3, None), (7, "", 4, "y"), (7, T, 5, "z"), (7, None, 6, "w"), (9, U, 7, None), (9, U, 7, None)]
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    assert kept(op8_simhash.first_of_groups(docs)) == sorted(map(repr, [(5, T, 3, None), (7, "", 4, "y"), (7, None, 6, "w"), (9, U, 7, None)]))
    assert op8_simhash.first_of_groups(docs.limit(0)).count() == 0


def test_clean(spark):
    rows = [(None, ITEM, 1, "x"), (None, U, 2, "y"), (3, f"so {ITEM} end", 1, None), (3, T, 1, None), (4, None, 1, None), (4, "", 1, None), (3, T, 1, None), (5, "w " * 50_000 + ITEM, 1, None)]
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    items = spark.createDataFrame([(1, ITEM), (2, None), (None, U), (4, "")], "item_id long, text string")
    assert kept(op4_decontaminate.clean(docs, items)) == sorted(repr(r) for r in rows if ITEM not in (r[1] or ""))
    assert kept(op4_decontaminate.clean(docs, items.limit(0))) == sorted(map(repr, rows))
    found = op4_decontaminate.leaks(docs, items)
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in found.collect()) == [("3", 1, 0), ("5", 1, 0), ("None", 1, 0)]
    assert op4_decontaminate.leaks(docs, items.limit(0)).count() == 0 == op4_decontaminate.leaks(docs.limit(0), items).count()


def test_blocks_of_items(spark, monkeypatch):
    """Items beyond one block's bound are searched as well."""
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(7)], "item_id long, text string")
    blocks = op4_decontaminate.item_blocks(items, 3)
    assert [len(b) for b in blocks] == [3, 3, 1]
    monkeypatch.setattr(op4_decontaminate, "item_blocks", lambda benchmark: blocks)
    docs = items.selectExpr("item_id + 10 AS doc_id", "concat('before ', text, ' after') AS text")
    assert sorted((r.doc_id, r.item_id) for r in op4_decontaminate.leaks(docs, items).collect()) == [(i + 10, i) for i in range(7)]
    assert op4_decontaminate.clean(docs, items).count() == 0


@pytest.mark.parametrize("n", [6, 10, 14, 25, 40])
def test_recall_by_edits(n):
    """Share of matches found, against brute force, at each number of edits that is allowed."""
    rng = np.random.default_rng(n)
    for edits in range(op4_decontaminate.most_edits(n) + 1):
        hit = held = 0
        for _ in range(25):
            item = rng.choice(500, n, replace=False).tolist()
            doc = rng.integers(500, size=20).tolist() + op4_decontaminate.edited(item, edits, 600, rng) + rng.integers(500, size=20).tolist()
            held += op4_decontaminate.distance(item, doc)[0] <= op4_decontaminate.most_edits(n)
            text, doc = (" ".join(f"w{x}" for x in w).encode() for w in (item, doc))
            hit += bool(op4_decontaminate.Items([(1, text)]).search(doc))
        assert held == 25 and hit >= 0.9 * held


@pytest.mark.parametrize("parts", [(2,), (3,), (4,)])
def test_any_number_of_partitions(spark, parts):
    """All pairs within the limit are linked, for any number of partitions."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40)
    prints = {int(x) for b in base for x in [b, *(b ^ np.bitwise_or.reduce(1 << rng.integers(0, 62, k)) for k in (1, 2, 3, 4, 5))]}
    table = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = {r.fp: r.root for r in op8_simhash.rooted(table, parts=parts).collect()}
    group = {x: x for x in prints}
    for _ in prints:
        new = {a: min(group[b] for b in prints if (a ^ b).bit_count() <= 4) for a in prints}
        if new == group:
            break
        group = new
    pairs = lambda g: {frozenset(k for k in g if g[k] == v) for v in g.values()}
    assert pairs(found) == pairs(group)


def test_partitions_follow_the_size():
    """Few fingerprints take three partitions, very many take two."""
    mean = np.full(64, 0.5)
    cost = lambda n, k: op8_simhash.allocate([op8_simhash._costs(list(range(64 // k)), n * n / 2 / 2.0 ** (64 // k), mean, n, 4) for _ in range(k)], 5 - k)[0]
    assert cost(10**5, 3) < cost(10**5, 2) and cost(10**9, 2) < cost(10**9, 3)


def test_fingerprint_by_hand():
    """The vote over shingles, bit by bit."""
    for text in ["one two three four five six seven", "Aa\x0bBb  cc\tdd ee ff" * 9, "four words are here", "two words", "x " * 40]:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").replace("\t", " ").split(" ")
        words = [w for w in words if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
        votes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))
        assert op8_simhash.fingerprint(text.encode()) == want
    assert op8_simhash.fingerprint(b" \t ") == 0
