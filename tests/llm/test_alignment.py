"""Alignment against plain intervals over the libraries' tokens of whole texts."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointmill.llm import op12_alignment

KIND = "doc_id long, text string, n_a long, links string"
TEXTS = [None, "", " ", "Hello World!", "x" * 100_000 + " end", "naïve straße <|endoftext|> <s> 12", "a  b \n c ", "日本 語　😀", "with ▁ sign", "Hello World! Hello"]
ANY = st.text(st.characters(exclude_categories=["Cs"]), max_size=30)
TRICKY = st.text(st.sampled_from("ab thein'sreL1½é中 \n\t　\x1c\x85▁<>|"), max_size=24)


@pytest.fixture(scope="module")
def aligner():
    return op12_alignment.load(*op12_alignment.vocabularies())


def plain(al, text):
    """Groups, links, numbers of tokens."""
    a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    raw_a, raw_b = (b"".join(names[i] for i in ids) for ids, names in ((a, al.bytes_a), (b, al.bytes_b)))
    if not text or not raw_a == raw_b == (" " + text).encode():
        return "", [], 0, 0
    sides = []
    for ids, names in ((a, al.bytes_a), (b, al.bytes_b)):
        at, spans = 0, []
        for i in ids:
            spans.append((at, at + len(names[i]), i))
            at += len(names[i])
        sides.append(spans)
    groups, start = [], 0
    for end in sorted({e for _, e, _ in sides[0]} & {e for _, e, _ in sides[1]}):
        groups.append("|".join(",".join(str(i) for x, y, i in side if start <= x and y <= end) for side in sides))
        start = end
    links, first = [], 0
    for x, y, i in sides[0]:
        while first < len(sides[1]) and sides[1][first][1] <= x:
            first += 1
        k = first
        while k < len(sides[1]) and sides[1][k][0] < y:
            links.append((i, sides[1][k][2]))
            k += 1
    return ";".join(groups), links, len(a), len(b)


def scored(al, rows):
    found = [plain(al, r[1] or "") for r in rows]
    count = Counter(p for f in found for p in f[1])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for r, (groups, links, n_a, n_b) in zip(rows, found, strict=True):
        n_groups = groups.count("|") if links else 0
        sha = hashlib.sha256(groups.encode()).hexdigest() if links else ""
        out.append((r[0], n_a, n_b, n_groups, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha))
    return sorted(map(repr, out))


@pytest.mark.parametrize("block", [op12_alignment.BLOCK, 50])
def test_rows(spark, aligner, block, monkeypatch):
    """Nulls, empty and very long texts, repeated rows, columns named like the new ones; one block or many."""
    monkeypatch.setattr(op12_alignment, "TOGETHER", block // 2)
    rows = [(i if i else None, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 5, None)] * 2
    docs = spark.createDataFrame(rows, KIND).repartition(2)
    got = op12_alignment.score(docs, op12_alignment.vocabularies(), block)
    assert sorted(repr(tuple(r)) for r in got.collect()) == scored(aligner, rows)
    assert op12_alignment.score(docs.limit(0), op12_alignment.vocabularies()).count() == 0
    one = op12_alignment.align(docs, op12_alignment.vocabularies()).where("doc_id = 5").first()
    assert (one.groups, [tuple(p) for p in one.links], one.n_a, one.n_b) == plain(aligner, TEXTS[5])


def test_bytes_that_are_no_utf8(spark, aligner):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'6162FF20C3' AS string) AS text")
    assert op12_alignment.align(docs, op12_alignment.vocabularies()).first().groups == plain(aligner, b"ab\xff \xc3".decode("utf-8", "replace"))[0]


def test_whole_tables(spark, aligner):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in op12_alignment.score(docs, op12_alignment.vocabularies()).collect()) == scored(aligner, rows)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(ANY, TRICKY), max_size=3))
def test_any_texts(aligner, texts):
    for t, got in zip(texts, aligner.texts(texts), strict=True):
        groups, links, n_a, n_b = plain(aligner, t)
        assert (got or ("", b"", 0, 0)) == (groups, b"".join((a << 32 | b).to_bytes(8, "little") for a, b in links), n_a, n_b)


def test_small_stores(aligner):
    own = op12_alignment.Aligner(*op12_alignment.vocabularies(), 3)
    for t in ["one two three four five, six", "five six seven naïve straße", "one two  unbelievable"] * 2:
        assert own.texts([t]) == aligner.texts([t])
