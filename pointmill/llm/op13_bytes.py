"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1, so that an automaton of pyahocorasick over the vocabulary finds the longest token that starts
at a place. A sequence of tokens is the BPE encoding of its bytes if and only if each two neighbours are compatible, that
is no merge across their border comes before the merges that form them. So from left to right the longest token that fits
its left neighbour is taken; if none fits, the last one gives way to the next shorter. Places from which nothing fits are
kept, so each is tried once and the time is linear in the length. Compatibility is remembered by pair of tokens.

Texts are cut at spaces after what is no white space, where the pattern always cuts; the ids of such words are stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import by_slices, text_bytes

#: Words, pieces and token borders in each of a worker's stores; each has an older half, which goes when the newer is full.
CACHE = 200_000
#: Code points of a word or piece whose ids are stored, at most; bytes of texts that are encoded together.
STORED, TOGETHER = 64, 1 << 20


def vocabulary() -> str:
    """The file of ranks that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def ranges(chars: str) -> str:
    """The code points as ranges for a character class; a class of single ones would be slow to compile."""
    out, start = [], None
    points = [*sorted(map(ord, chars)), None]
    for at, p in enumerate(points[:-1]):
        start = p if start is None else start
        if points[at + 1] != p + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(p))}")
            start = None
    return "".join(out)


def classes() -> dict[str, str]:
    """Letters, numbers and white space as the tiktoken library's Unicode tables have them; Python's are of other versions."""
    import tiktoken

    every, single = "".join(chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000), {bytes([b]): b for b in range(256)}
    out = {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        one = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        out[kind] = bytes(one.encode_ordinary(every)).decode()
    return out


class Store(dict):
    """A dictionary of bounded size: full, it becomes the older half, from which entries still in use come back."""

    def __init__(self, make: Callable, size: int):
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


class ByteBpe:
    """A vocabulary of byte strings by rank; encode() takes whole texts, decode() gives bytes back."""

    def __init__(self, path: str, size: int = CACHE):
        from ahocorasick import Automaton

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.names: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.names[i] = t
        self.width = self.far = len(self.names)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[int, int] = {}
        self.edges: tuple[Store, Store] = tuple(Store(lambda t, side=side: self._edge(t, side), self.width) for side in (0, 1))
        sound = [i for t, i in sorted(self.ranks.items(), key=lambda e: e[1]) if len(t) == 1 or self._split(t, i)]
        self.sound, self.sizes = set(sound), list(map(len, self.names))
        self.most = max(self.sizes)
        self.automaton = Automaton()
        for i in sorted(sound, key=lambda i: (self.sizes[i] == 1, i)):  # edges are tried in this order: frequent ones first
            self.automaton.add_word(self.names[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._longest(t[:-1]) for t in self.names]
        self.longest = Store(lambda prefix: self._longest(prefix.encode("latin-1")), size)
        self.fits = Store(lambda border: self._compatible(*divmod(border, self.width), self.far), size)
        self.fitting = Store(self._fitting, size)
        self.pieces, self.words = Store(self._pack, size), Store(self._word, size)
        kinds = {k: ranges(c) for k, c in classes().items()}
        letter, number, blank = kinds[r"\p{L}"], kinds[r"\p{N}"], kinds[r"\s"]
        # fixed value: the published pattern, its classes written out
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+")
        self.letters = re.compile(f"[{letter}]+").fullmatch
        self.inner, self.border = re.compile(f" (?<=[{blank}] )"), re.compile(f"(?<=[^{blank}])(?= )")

    def _edge(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """The nodes down the token's left (0) or right (1) edge, each with the rank at which the next node above takes it."""
        nodes, node, until = [], token, self.far
        while node in self.halves:
            nodes.append((node, until))
            node, until = self.halves[node][side], node
        return (*nodes, (node, until))

    def _compatible(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the border of a and b, of a rank below before, comes before both sides are complete.

        At equal ranks the pair further left goes first: that is a's own merge, but not b's.
        """
        get, width, right = self.merges.get, self.width, self.edges[0][b]
        for x, x_until in self.edges[1][a]:
            x *= width
            for y, y_until in right:
                k = get(x + y)
                if k is not None and k < before and k < x_until and k <= y_until:
                    return False
        return True

    def _split(self, t: bytes, rank: int) -> bool:
        """Finds the two tokens whose merge forms t. False if t's own bytes don't merge to it; then no merges ever form it."""
        for n in range(len(t) - 1, 0, -1):
            a, b = self.ranks.get(t[:n], rank), self.ranks.get(t[n:], rank)
            known = all(x in self.halves or len(self.names[x]) == 1 for x in (a, b))
            if a < rank and b < rank and known and self._compatible(a, b, rank):
                self.halves[rank] = (a, b)
                self.merges[a * self.width + b] = rank
                return True
        return False

    def _longest(self, t: bytes) -> int:
        """The longest token that t begins with; -1 if none."""
        return next((i for n in range(len(t), 0, -1) if (i := self.ranks.get(t[:n], -1)) in self.sound), -1)

    def _fitting(self, border: int) -> int:
        """Of the right token and those that it begins with the longest that fits the left one; -1 if none."""
        left, token = divmod(border, self.width)
        while token >= 0 and not self.fits[left * self.width + token]:
            token = self.shorter[token]
        return token

    def tokens(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        text, n, prefix, most, longest = raw.decode("latin-1"), len(raw), self.automaton.longest_prefix, self.most, self.longest
        sizes, fitting, width, shorter = self.sizes, self.fitting, self.width, self.shorter
        ids, at, last, closed = [], 0, -1, set()
        while at < n:
            ahead = text[at : at + most]
            token = longest[ahead[: prefix(ahead)]]
            if last >= 0:
                token = fitting[last * width + token]
            while token < 0 or closed and at + sizes[token] in closed:
                if token < 0:  # nothing fits here: back to the place before
                    closed.add(at)
                    token = ids.pop()
                    at -= sizes[token]
                    last = ids[-1] if ids else -1
                token = shorter[token]
                if last >= 0 and token >= 0:
                    token = fitting[last * width + token]
            ids.append(token)
            last = token
            at += sizes[token]
        return ids

    def _pack(self, piece: str) -> bytes:
        return array("I", self.tokens(piece.encode())).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of the word and the space before it."""
        return self._pack(" " + word) if self.letters(word) else self._cut(" " + word)

    def _cut(self, text: str) -> bytes:
        pieces = self.pattern.findall(text)
        return self._pack(text) if len(pieces) == 1 else b"".join(map(self._stored, pieces))

    def _stored(self, piece: str) -> bytes:
        if len(piece) > STORED:
            return self._pack(piece)
        return self.words[piece[1:]] if piece[0] == " " else self.pieces[piece]

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if text[:1] == " " or self.inner.search(text):  # spaces at the start or after white space
            first, *rest = self.border.split(text)
            rest = [w[1:] for w in rest]
        else:
            first, *rest = text.split(" ")
        words = self.words
        if max(map(len, rest), default=0) <= STORED:
            return self._cut(first) + b"".join([words[w] for w in rest])
        return self._cut(first) + b"".join([words[w] if len(w) <= STORED else self._word(w) for w in rest])

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))


@lru_cache(1)
def load(path: str) -> ByteBpe:
    """One vocabulary for each Python worker."""
    return ByteBpe(path)


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.binary())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _apply(path: str, digest: bool) -> Callable:
    def work(columns: list[list]) -> list[list]:
        bpe, out = load(path), [[], [], [], []]
        for doc_id, text in zip(*columns, strict=True):
            # Spark's strings may hold bytes that are no UTF-8; they are read as U+FFFD
            raw = bpe.encode_packed(text.decode("utf-8", "replace"))
            ids = memoryview(raw).cast("I").tolist()
            decoded = bpe.decode(ids)
            row = (hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()) if digest else (ids, decoded)
            for c, v in zip(out, (doc_id, len(ids), *row), strict=True):
                c.append(v)
        return out

    return by_slices(work, DIGEST if digest else ENCODED, TOGETHER)


def encode(docs: DataFrame, vocabulary: str, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids and decoded (bytes); with digest, SHA-256 sums instead of the last two.

    A null text is empty: no ids, nothing decoded. Null and repeated ids and rows come through as they are, and an empty
    table gives an empty result. A text of any length is encoded whole; bytes that are no UTF-8 count as U+FFFD. Only
    doc_id and text are read, so other columns may have any names. vocabulary is the path of the file of ranks, the same on
    every executor.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes())
    kind = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<long>, decoded binary")
    return rows.mapInArrow(_apply(vocabulary, digest), kind)
