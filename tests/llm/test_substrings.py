import hashlib
import random
from collections import Counter

import pytest

from pointmill.llm import op6_substrings


def edited_copies(seed, n, size, letters):
    """Texts put together from a few passages, cut and changed at random places."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(4)]
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(4)):
            x = rng.choice(passages)
            a = rng.randrange(size)
            b = rng.randrange(a, size)
            text += x[a:b] + "".join(rng.choice(letters) for _ in range(rng.randrange(6)))
        yield text


@pytest.mark.parametrize(("length", "anchor", "widths"), [(40, 8, (16, 4, 1)), (40, 4, (64, 16, 4, 1)), (25, 16, (1,))])
@pytest.mark.parametrize("letters", ["abcdefgh", "ab"])
def test_edited_copies(spark, length, anchor, widths, letters):
    """Repeats that begin and end anywhere, also in the middle of units and next to each other."""
    rows = list(enumerate(edited_copies(length, 60, 150, letters)))
    docs = spark.createDataFrame([(i % 50, t, 7) for i, t in rows], "doc_id long, text string, mark int").repartition(3)
    got = op6_substrings.dedup(docs, length, anchor, widths).collect()
    want = op6_substrings.brute([t.encode() for _, t in rows], length)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == sorted((i % 50, len(t.encode()), *w) for (i, t), w in zip(rows, want, strict=True))
    assert any(w[0] for w in want) and any(not w[0] for w in want)


def test_whole_table(spark):
    """All rows of a table at 400 bytes, against counts of all strings by their hashes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, length = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()], op6_substrings.LENGTH
    hashes = [[hash(t[at : at + length]) for at in range(len(t) - length + 1)] for _, t in rows]
    seen = Counter(h for own in hashes for h in own)
    want = []
    for (i, t), own in zip(rows, hashes, strict=True):
        gone = bytearray(len(t))
        for at, h in enumerate(own):
            if seen[h] > 1:
                gone[at : at + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = (b"\0" + bytes(gone)).count(b"\0\1")
        want.append((i, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest(), len(kept) < len(t)))
    assert sorted(map(tuple, op6_substrings.digest(docs).collect())) == sorted(want)
    assert 100 < sum(w[5] for w in want) < len(want)


def test_stretches(monkeypatch):
    """Units don't depend on where a long text is cut into stretches, but for a cut in two."""
    text = random.Random(1).randbytes(3000)
    whole = {x: p for s, e, p in op6_substrings.units(text, 100, 16) for x in range(s, e + 1)}
    monkeypatch.setattr(op6_substrings, "STRETCH", 333)
    assert whole == {x: p for s, e, p in op6_substrings.units(text, 100, 16) for x in range(s, e + 1)}
