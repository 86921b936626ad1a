import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointmill.llm import op3_bpe, queries

KIND = "doc_id long, text string, n_tokens long, ids string"
TEXTS = [None, "", "Hello World!", "Hello World!", "x" * 300_000 + " end", "naïve straße <|endoftext|> 12"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_rows(spark, library):
    """Nulls, empty and very long texts, repeated rows, columns named like the new ones."""
    rows = [(i if i else None, t, 1, "ids") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 5, None)] * 2
    docs = spark.createDataFrame(rows, KIND).repartition(2)
    got = op3_bpe.encode(docs, queries.vocabulary(), digest=True).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    plain = op3_bpe.encode(docs, queries.vocabulary()).where("doc_id = 5").first()
    assert plain.ids == library.encode(TEXTS[5], add_special_tokens=False).ids
    assert op3_bpe.encode(docs.limit(0), queries.vocabulary()).count() == 0


def test_bytes_that_are_no_utf8(spark, library):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'6162FF20C3' AS string) AS text")
    got = op3_bpe.encode(docs, queries.vocabulary()).first()
    assert got.ids == library.encode(b"ab\xff \xc3".decode("utf-8", "replace"), add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_any_texts(library, texts):
    bpe = op3_bpe.load(queries.vocabulary())
    for t, raw in zip(texts, bpe.encode_texts(texts), strict=True):
        assert memoryview(raw).cast("I").tolist() == library.encode(t, add_special_tokens=False).ids


def test_small_stores(library, monkeypatch):
    """Stores that overflow all the time change nothing."""
    monkeypatch.setattr(op3_bpe, "CACHE", 3)
    bpe = op3_bpe.Bpe(queries.vocabulary())
    for t in ["one two three four five six", "five six seven eight naïve", "one two three nine ten eleven"] * 2:
        assert bpe.encode(t) == library.encode(t, add_special_tokens=False).ids
