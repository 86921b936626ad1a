"""Byte-level BPE against the tiktoken library, and decoding as an exact round trip."""

import base64
import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointmill.llm import op13_bytes

KIND = "doc_id long, text string, n_tokens long, decoded string"
TEXTS = [None, "", " ", "Hello World!", "x" * 300_000 + " end", "naïve straße <|endoftext|> 12", "a  b \n c", "\x1c 　 x", "don't\r\n\r\n  we'll"]
ANY = st.text(st.characters(exclude_categories=["Cs"]), max_size=40)
TRICKY = st.text(st.sampled_from("ab thein'sreL1½é中՘࢏ \n\t　\x1c\x85"), max_size=24)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(op13_bytes.vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rows(spark, library):
    """Nulls, empty and very long texts, repeated rows, columns named like the new ones."""
    rows = [(i if i else None, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 5, None)] * 2
    docs = spark.createDataFrame(rows, KIND).repartition(2)
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, op13_bytes.encode(docs, op13_bytes.vocabulary(), digest=True).collect()))) == sorted(map(repr, want))
    plain = op13_bytes.encode(docs, op13_bytes.vocabulary()).where("doc_id = 5").first()
    assert plain.ids == library.encode_ordinary(TEXTS[5]) and plain.decoded.decode() == TEXTS[5]
    assert op13_bytes.encode(docs.limit(0), op13_bytes.vocabulary()).count() == 0


def test_bytes_that_are_no_utf8(spark, library):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'6162FF20C3' AS string) AS text")
    assert op13_bytes.encode(docs, op13_bytes.vocabulary()).first().ids == library.encode_ordinary(b"ab\xff \xc3".decode("utf-8", "replace"))


@settings(max_examples=400, deadline=None)
@given(st.one_of(ANY, TRICKY))
def test_any_text(library, text):
    bpe = op13_bytes.load(op13_bytes.vocabulary())
    ids = bpe.encode(text)
    assert ids == library.encode_ordinary(text) and bpe.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 50_255), min_size=1, max_size=5))
def test_any_piece(library, ids):
    """Any bytes, valid UTF-8 or not, made of tokens: merges by rank give the same."""
    bpe = op13_bytes.load(op13_bytes.vocabulary())
    raw = bpe.decode(ids)
    assert bpe.tokens(raw) == library._core_bpe.encode_single_piece(raw)  # noqa: SLF001


def test_small_stores(library):
    """Stores that overflow all the time change nothing."""
    bpe = op13_bytes.ByteBpe(op13_bytes.vocabulary(), 3)
    for t in ["one two three four five, six", "five six seven eight naïve straße", "unbelievable  antidisestablishment"] * 2:
        assert bpe.encode(t) == library.encode_ordinary(t)


def test_tokens_no_merge_makes(tmp_path):
    """A token that its own bytes don't merge to counts for whole pieces only, as in the library."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xbc": 259, b"cbc": 260, b"bcbc": 261, b"aabb": 262}
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
    bpe = op13_bytes.ByteBpe(str(path))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert 262 not in bpe.sound
    for t in ["aabb", "aabbc", "abc", "xbc", "abcbc", "cbcbcabab", "aabbaabb", "ab" * 400 + "c"]:
        assert bpe.encode(t) == own.encode_ordinary(t), t
