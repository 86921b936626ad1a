"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is one token with which the BPE encoding of that prefix ends. An automaton over the
vocabulary lists the tokens that end at each position, longest first; the right one is the first whose predecessor (the
last token of the remaining prefix, stored before) is compatible with it: their two merge trees meet at the border, and
no merge across it would have come before the merges that formed them. Back-pointers then give the ids. New words are
encoded in order, so that a prefix which several of them share is worked out once.

Normalisation and word splitting are those of the tokenizer's file: composed form, lower case, runs of letters, single
digits, runs of other signs, white space dropped. Texts within a plain Latin range take a compiled expression for these
steps; any other text takes the tokenizer library's own normaliser and splitter. No ids come from the library.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import by_slices, text_bytes

#: Fixed value: the mark of a word's last symbol in the vocabulary file.
END = "</w>"
#: Encoded words, and token borders, in each of a worker's two stores; then the older one goes.
CACHE = 60_000
#: Bytes of a word whose ids are stored, at most; bytes of texts whose new words are encoded together.
STORED, TOGETHER = 64, 1 << 20
#: Symbols of the automaton: the 256 bytes, and each of them as a word's last one.
SYMBOLS = 512


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _plain_range() -> tuple[re.Pattern, re.Pattern]:
    """Two expressions over U+0009..U+024F and general punctuation: what is outside of it, and the words."""
    points = [*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]
    kinds: dict[str, str] = {"L": "", "N": "", "other": ""}
    for p in points:
        c = unicodedata.category(chr(p))[0]
        if not (c == "Z" or p < 0x20):
            kinds[c if c in "LN" else "other"] += chr(p)
    outside = f"[^{re.escape(''.join(map(chr, points)))}]"
    words = f"'s|'t|'re|'ve|'m|'ll|'d|[{re.escape(kinds['L'])}]+|[{re.escape(kinds['N'])}]|[{re.escape(kinds['other'])}]+"
    return re.compile(outside), re.compile(words)


class Bpe:
    """A word-end BPE vocabulary; encode() and decode() take whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = max([*vocab.values(), *self.special.values()])
        self.names: list[str | None] = [None] * (top + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = t
        self.width = top + 1
        self.back = {c: b for b, c in enumerate(byte_symbols())}
        self.pairs: dict[int, int] = {}
        rank: dict[int, int] = {}
        halves: dict[int, tuple[int, int]] = {}
        for k, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.pairs.setdefault(pair[0] * self.width + pair[1], k)
            if whole not in halves:
                halves[whole], rank[whole] = pair, k
        self.halves, self.rank, self.far = halves, rank, len(merges) + 1
        self.edges: tuple[dict[int, tuple], dict[int, tuple]] = ({}, {})
        self._build((t, i) for t, i in vocab.items() if i not in halves or self._sound(i))
        self.edges = ({}, {})
        self.outside, self.words = _plain_range()
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.borders: dict[int, bool] = {}
        self.older_borders: dict[int, bool] = {}

    @cached_property
    def library(self):  # noqa: ANN202
        """The tokenizer library's normaliser and splitter, loaded for the first text that needs them."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _build(self, tokens: Iterator[tuple[str, int]]) -> None:
        """The automaton: steps by state and symbol, where to go on from when there is none, and the tokens that end in a state."""
        step: dict[int, int] = {}
        parent, symbol, ends = [0], [0], [-1]
        self.sized: dict[int, tuple[int, int]] = {}
        for t, i in tokens:
            last = t.endswith(END) and len(t) > len(END)
            body = t[: -len(END)] if last else t
            if any(c not in self.back for c in body):
                continue
            state = 0
            codes = [self.back[c] for c in body]
            if last:
                codes[-1] += 256
            for c in codes:
                key = state * SYMBOLS + c
                state = step.get(key, 0)
                if not state:
                    state = step[key] = len(parent)
                    parent.append(key // SYMBOLS)
                    symbol.append(c)
                    ends.append(-1)
            ends[state] = i
            self.sized[i] = (i, len(codes))
        other, order = [0] * len(parent), [0]
        children: dict[int, list[int]] = {}
        for s in range(1, len(parent)):
            children.setdefault(parent[s], []).append(s)
        for s in order:  # by depth
            order += children.get(s, ())
        for s in order[1:]:
            up = parent[s]
            if up:
                at, c = other[up], symbol[s]
                while at and at * SYMBOLS + c not in step:
                    at = other[at]
                other[s] = step.get(at * SYMBOLS + c, 0)
        self.step, self.other, self.ends = step, other, ends
        self.found: dict[int, tuple[tuple[int, int], ...]] = {}
        self.moves: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}

    def _found(self, state: int) -> tuple[tuple[int, int], ...]:
        """The tokens that end in the state, longest first, each with its size."""
        out, at = [], state
        while at:
            if self.ends[at] >= 0:
                out.append(self.sized[self.ends[at]])
            at = self.other[at]
        got = self.found[state] = tuple(out)
        return got

    def _edge(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """The nodes down the token's left (0) or right (1) edge, each with the rank at which the next node above takes it."""
        got = self.edges[side].get(token)
        if got is None:
            nodes, node, until = [], token, self.far
            while True:
                nodes.append((node, until))
                if node not in self.halves:
                    break
                node, until = self.halves[node][side], self.rank[node]
            got = self.edges[side][token] = tuple(nodes)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes before both sides are complete.

        At equal ranks the pair further left goes first: that is a's own merge, but not b's.
        """
        get, right = self.pairs.get, self._edge(b, 0)
        for x, x_until in self._edge(a, 1):
            x *= self.width
            for y, y_until in right:
                k = get(x + y)
                if k is not None and k < x_until and k <= y_until:
                    return False
        return True

    def _sound(self, t: int) -> bool:
        """Whether the token's own letters encode to it: at each border in its tree no other merge comes first."""
        halves, rank, todo = self.halves, self.rank, [t]
        while todo:
            x = todo.pop()
            if x not in halves:
                continue
            a, b = halves[x]
            for p, p_until in self._edge(a, 1):
                for q, q_until in self._edge(b, 0):
                    k = self.pairs.get(p * self.width + q)
                    if k is not None and (p, q) != (a, b) and k < min(p_until, rank[x]) and k <= min(q_until, rank[x]):
                        return False
            todo += (a, b)
        return True

    def _move(self, key: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The state after a state and one more symbol, and the tokens that end there."""
        step, other = self.step, self.other
        state, c = divmod(key, SYMBOLS)
        while (to := step.get(state * SYMBOLS + c)) is None and state:
            state = other[state]
        state = to or 0
        if len(self.moves) >= CACHE:
            self.moves.clear()
        got = self.moves[key] = (state, self.found.get(state) or self._found(state))
        return got

    def _learn(self, words: list[str]) -> None:
        """Stores the ids of new words. In order, words share the work for the prefix that they have in common.

        Of each place of a word's bytes three lists hold the state of the automaton, the last token of the prefix that ends
        there, and the place before that token.
        """
        move, remember, width = self._move, self._remember, self.width
        before, states, ends, places = b"", [], [], []
        for raw, word in sorted([(w.encode("utf-8", "surrogateescape"), w) for w in words]):
            n, same = len(raw) - 1, 0
            most = min(n, len(before))
            if raw[:most] == before[:most]:
                same = most
            else:
                while raw[same] == before[same]:
                    same += 1
            del states[same:], ends[same:], places[same:]
            state, moves, borders = states[-1] if same else 0, self.moves, self.borders
            for at in range(same, n + 1):
                key = state * SYMBOLS + raw[at] + (at == n) * 256
                state, found = moves.get(key) or move(key)
                for t, size in found:
                    place = at - size
                    if place < 0:
                        break
                    border = ends[place] * width + t
                    fits = borders.get(border)
                    if fits or fits is None and remember(border):
                        break
                states.append(state)
                ends.append(t)
                places.append(place)
            ids, at = [], n
            while at >= 0:
                ids.append(ends[at])
                at = places[at]
            ids.reverse()
            self.known[word] = pack(f"<{len(ids)}I", *ids)
            # the last place belongs to this word only
            del states[n:], ends[n:], places[n:]
            before = raw[:n]

    def _remember(self, border: int) -> bool:
        fits = self.older_borders.get(border)
        if fits is None:
            fits = self._compatible(*divmod(border, self.width))
        if len(self.borders) >= CACHE:
            self.borders, self.older_borders = {}, self.borders
        self.borders[border] = fits
        return fits

    def _pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text in order: (True, special token) or (False, word)."""
        at = 0
        for m in self.cut.finditer(text) if self.cut and "<|" in text else ():
            yield from ((False, w) for w in self._split(text[at : m.start()]))
            yield True, m[0]
            at = m.end()
        yield from ((False, w) for w in self._split(text[at:] if at else text))

    def _split(self, text: str) -> list[str]:
        if not self.outside.search(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            text = text.lower()
            if not self.outside.search(text):
                return self.words.findall(text)
        return [self._own(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def _own(self, symbols: str) -> str:
        return bytes(self.back[c] for c in symbols).decode("utf-8", "surrogateescape")

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers. New words of all texts are encoded together."""
        cut = [list(self._pieces(t)) if self.cut and self.cut.search(t) else None for t in texts]
        words = [self._split(t) if c is None else [w for special, w in c if not special] for t, c in zip(texts, cut, strict=True)]
        if len(self.known) >= CACHE:
            self.known, self.older = {}, self.known
        new = set().union(*words).difference(self.known)
        again = [w for w in new if w in self.older]
        for w in again:
            self.known[w] = self.older[w]
        new.difference_update(again)
        self._learn(list(new))
        get, out = self.known.__getitem__, []
        for own, pieces in zip(words, cut, strict=True):
            if pieces is None:
                out.append(b"".join(map(get, own)))
            else:
                out.append(b"".join(pack("<I", self.special[w]) if special else get(w) for special, w in pieces))
        for w in new:
            if len(w) > STORED:
                del self.known[w]
        return out

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_texts([text])[0]).cast("I").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens' names, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(1)
def load(path: str) -> Bpe:
    """One vocabulary for each Python worker."""
    return Bpe(path)


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _apply(path: str, digest: bool) -> Callable:
    def work(columns: list[list]) -> list[list]:
        bpe, out = load(path), [[], [], [], []]
        # Spark's strings may hold bytes that are no UTF-8; they are read as U+FFFD
        for doc_id, raw in zip(columns[0], bpe.encode_texts([t.decode("utf-8", "replace") for t in columns[1]]), strict=True):
            ids = memoryview(raw).cast("I").tolist()
            decoded = bpe.decode(ids)
            row = (hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) if digest else (ids, decoded)
            for c, v in zip(out, (doc_id, len(ids), *row), strict=True):
                c.append(v)
        return out

    return by_slices(work, DIGEST if digest else ENCODED, TOGETHER)


def encode(docs: DataFrame, vocabulary: str, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids and decoded; with digest, SHA-256 sums instead of the last two.

    A null text is empty: no ids, an empty decoded text. Null and repeated ids and rows come through as they are, and an
    empty table gives an empty result. A text of any length is encoded whole, by itself if it is long; bytes that are no
    UTF-8 count as U+FFFD. Only doc_id and text are read, so other columns may have any names. vocabulary is the path of
    the tokenizer's file, the same on every executor.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes())
    kind = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<long>, decoded string")
    return rows.mapInArrow(_apply(vocabulary, digest), kind)
