"""Benchmark decontamination by the CGK embedding and bit sampling.

Texts are word sequences. A document holds a benchmark item if some stretch of its words is within an edit distance of
the item: a fifth of the item's words at most, insertions, deletions and changes counted alike. The search slides
windows of the item's length over the document. A CGK walk embeds a window: at each of 3n steps it writes the current
word and moves on or stays by a random bit that belongs to the step and the word, so a small edit distance becomes a
small Hamming distance. Each repetition draws a few of the steps; windows and items that agree in all of them are
candidates, verified by the exact distance. The Hamming share of a match grows with the number of edits, so the number of
repetitions follows from the target recall by item length, from walks over pairs of most_edits(n) edits each.

Windows are embedded only where they can match at all: an item of n words with d edits keeps n - d of its words and
n - 2 - 3d of its word triples, so a stretch with fewer of the item's triples is left out without loss; for items too
short for that, a stretch with fewer of any item's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import SLICE, by_slices, text_bytes

EDITS, RECALL = 0.2, 0.995
#: Steps drawn in a repetition; fewer are drawn for lengths that would need more than TIMES repetitions.
DRAWN, TIMES = 3, 64
#: Steps of a walk for each word.
STEPS = 3
#: Pairs of an item and its edited copy, and walks over each, from which repetitions are reckoned; symbols embedded at once.
PAIRS, WALKS, SYMBOLS = 100, 50, 8 << 20
#: Items that are sent to all executors at once, and bytes of their texts; more are searched block after block.
BLOCK_ITEMS, BLOCK_BYTES = 5000, 16 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased; other signs of ASCII only separate."""
    return WORD.findall(text.lower())


def most_edits(n: int) -> int:
    return int(EDITS * n)


def _random(*parts: np.ndarray | int) -> np.ndarray:
    x = np.array([0x243F6A8885A308D3], np.uint64)
    for p in parts:
        x = (x ^ np.asarray(p, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(32))
    return x


def embed(ids: np.ndarray, times: int) -> np.ndarray:
    """CGK walks over rows of word ids (above 0; 0 stands past the end): 3n symbols for each repetition and row."""
    m, n = ids.shape
    padded = np.concatenate((ids, np.zeros((m, 1), ids.dtype)), axis=1)
    repetition, row = (x.ravel() for x in np.meshgrid(np.arange(times), np.arange(m), indexing="ij"))
    at, out = np.zeros(len(row), np.int64), np.empty((len(row), STEPS * n), np.int32)
    for step in range(STEPS * n):
        symbol = padded[row, at]
        out[:, step] = symbol
        at = np.minimum(at + (_random(repetition, step, symbol) >> np.uint64(63)).astype(np.int64), n)
    return out.reshape(times, m, STEPS * n)


@lru_cache(100_000)
def drawn_steps(n: int, repetition: int, drawn: int = DRAWN) -> np.ndarray:
    """The steps that a repetition draws."""
    return np.sort((_random(repetition, np.arange(drawn), 99) % np.uint64(max(1, STEPS * n))).astype(np.int64))


def distance(item: list[int], stretch: list[int]) -> tuple[int, int]:
    """The least edit distance of the item to any part of the stretch, and where the first such part ends."""
    row = np.zeros(len(stretch) + 1, np.int64)
    place, s = np.arange(len(stretch) + 1), np.array(stretch, np.int64)
    for k, word in enumerate(item):
        best = np.empty_like(row)
        best[0] = k + 1
        best[1:] = np.minimum(row[:-1] + (s != word), row[1:] + 1)
        row = np.minimum.accumulate(best - place) + place
    end = int(row.argmin())
    return int(row[end]), end


def triples(seq: np.ndarray) -> np.ndarray:
    """A number for each three words in a row; different ones may share it, which only costs time."""
    m = np.int64(0x9E3779B1)
    return (seq[:-2] * m + seq[1:-1]) * m + seq[2:]


def edited(item: list[int], edits: int, new: int, rng: np.random.Generator) -> list[int]:
    """The item after so many changes, insertions and deletions at random places; new words are numbered from `new`."""
    out = list(item)
    for k, kind in enumerate(rng.integers(3, size=edits).tolist()):
        at = int(rng.integers(len(out) + (kind == 1)))
        out[at : at + (kind != 1)] = [] if kind == 2 and len(out) > 1 else [new + k]
    return out


@lru_cache(1000)
def _reckoned(n: int, recall: float) -> tuple[int, int]:
    d = most_edits(n)
    if not d:
        return DRAWN, 1
    rng, item = np.random.default_rng(n), list(range(1, n + 1))
    own = embed(np.array([item]), WALKS)
    shares = []
    for _ in range(PAIRS):
        # the window runs on behind the copy, or ends within it
        row = (edited(item, d, n + 1, rng) + list(range(2 * n + 1, 3 * n + 1)))[:n]
        shares.append((own != embed(np.array([row]), WALKS)).mean(axis=2).ravel())
    for drawn in range(DRAWN, 0, -1):
        hit = ((1 - np.array(shares)) ** drawn).mean(axis=1)
        found = lambda times, hit=hit: (1 - (1 - hit) ** times).mean()
        times = 1
        while found(times) < recall and (times < TIMES or drawn == 1):
            times += 1
        if found(times) >= recall:
            break
    return drawn, times


def repetitions(n: int, recall: float = RECALL) -> tuple[int, int]:
    """Steps drawn and repetitions that find an item of n words under most_edits(n) edits with the target probability.

    Reckoned for the window that starts where the match does, at the next of some lengths, as longer items need more.
    """
    step = max(5, 5 * (n // 40))
    return _reckoned(-(-n // step) * step if most_edits(n) else n, recall)


class Items:
    """A block of benchmark items, prepared for the search."""

    def __init__(self, items: list[tuple[int, bytes]], recall: float = RECALL):
        self.ids: dict[bytes, int] = {}
        self.items = []  # (item_id, word ids)
        for item_id, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            if w:
                self.items.append((item_id, w))
        held: dict[int, set[int]] = {}
        for k, (_, w) in enumerate(self.items):
            for x in triples(np.array(w, np.int64)).tolist():
                held.setdefault(x, set()).add(k)
        # sorted triples, and for each the items that hold it
        self.triples = np.array(sorted(held), np.int64)
        self.holders = [np.array(sorted(held[x]), np.int64) for x in self.triples.tolist()]
        self.held = np.array([len(x) for x in self.holders], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.int64), *self.holders])
        self.first = np.cumsum(self.held) - self.held
        size = np.array([len(w) for _, w in self.items], np.int64)
        edits = np.array([most_edits(n) for n in size.tolist()], np.int64)
        self.needed = size - 2 - 3 * edits
        self.lengths: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            self.lengths.setdefault(len(w), []).append(k)
        self.tables: dict[tuple[int, int], dict[bytes, list[int]]] = {}
        self.plan = {n: repetitions(n, recall) for n in self.lengths}
        for n, own in self.lengths.items():
            self.tables.update({(n, r): {} for r in range(self.plan[n][1])})
            for at in range(0, len(own), step := self._at_once(n)):
                rows = np.array([self.items[k][1] for k in own[at : at + step]], np.int64)
                for r, keys in self._keys(rows):
                    for k, key in zip(own[at : at + step], keys, strict=True):
                        self.tables[n, r].setdefault(key.tobytes(), []).append(k)

    def _at_once(self, n: int) -> int:
        """How many rows of n words are embedded at once."""
        return max(1, min(512, SYMBOLS // (self.plan[n][1] * STEPS * n)))

    def _keys(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each repetition with the symbols that it draws of each row."""
        n = rows.shape[1]
        drawn, times = self.plan[n]
        walks = embed(rows, times)
        for r in range(times):
            yield r, np.ascontiguousarray(walks[r][:, drawn_steps(n, r, drawn)])

    def search(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, first word, word after the last) of the items that the text holds, best place of each."""
        get = self.ids.get
        found: dict[int, tuple[int, int, int]] = {}
        seq = np.fromiter([get(w, 0) for w in words(text)], np.int64)
        known = np.concatenate(([0], np.cumsum(seq > 0)))
        if not known[-1]:
            return []
        for n, able in self._able(seq, known).items():
            starts = np.unique(np.concatenate(list(able.values())))
            own = {k: set(x.tolist()) for k, x in able.items()}
            tried: dict[int, list[int]] = {}
            for at in range(0, len(starts), step := self._at_once(n)):
                self._probe(seq, starts[at : at + step], n, own, tried, found)
        return [(self.items[k][0], *v) for k, v in sorted(found.items())]

    def _able(self, seq: np.ndarray, known: np.ndarray) -> dict[int, dict[int, np.ndarray]]:
        """For each length the items with the starts of windows that hold enough of their triples; item -1: any of the length."""
        total, able = len(seq), {}
        for n in self.lengths:
            if n - 2 - 3 * most_edits(n) < 1 and known[-1] >= n - most_edits(n):
                start = np.arange(max(total - n + most_edits(n), 0) + 1)
                start = start[known[np.minimum(start + n + most_edits(n), total)] - known[start] >= n - most_edits(n)]
                if len(start):
                    able[n] = {-1: start}
        if total > 2 and len(self.triples):
            own = triples(seq)
            at = np.minimum(np.searchsorted(self.triples, own), len(self.triples) - 1)
            place = np.flatnonzero(self.triples[at] == own)
            at = at[place]
            times = self.held[at]
            inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            item, place = self.flat[np.repeat(self.first[at], times) + inner], np.repeat(place, times)
            enough = np.bincount(item, minlength=len(self.items)) >= self.needed
            for k in np.flatnonzero(enough & (self.needed > 0)).tolist():
                n, need = len(self.items[k][1]), int(self.needed[k])
                d, hits = most_edits(n), place[item == k]
                # a window of n + d words that holds `need` hits in a row starts at the first of them or up to so far before
                tight = hits[need - 1 :] - hits[: len(hits) - need + 1] + 3 <= n + d
                high, low = hits[: len(hits) - need + 1][tight], np.maximum(hits[need - 1 :][tight] + 3 - n - d, 0)
                if len(high):
                    count = high - low + 1
                    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    able.setdefault(n, {})[k] = np.unique(np.repeat(low, count) + inner)
        return able

    def _probe(self, seq: np.ndarray, start: np.ndarray, n: int, able: dict[int, set[int]], tried: dict[int, list[int]], found: dict[int, tuple[int, int, int]]) -> None:
        d = most_edits(n)
        place = start[:, None] + np.arange(n)[None, :]
        inside = (place >= 0) & (place < len(seq))
        # a word outside of the vocabulary is id 0 like the end of the text; neither equals a word of an item
        rows = np.where(inside, seq[np.clip(place, 0, len(seq) - 1)], 0)
        for r, keys in self._keys(rows):
            table = self.tables[n, r]
            for s, key in zip(start.tolist(), keys, strict=True):
                for k in table.get(key.tobytes(), ()):
                    if -1 not in able and s not in able.get(k, ()):
                        continue
                    # a start within d words was verified over a stretch that holds this one's match as well
                    if found.get(k, (d + 1,))[0] == 0 or any(abs(s - x) <= d for x in tried.get(k, ())):
                        continue
                    tried.setdefault(k, []).append(s)
                    lo, hi = max(0, s - 2 * d), min(len(seq), s + n + 2 * d)
                    edits, end = distance(self.items[k][1], seq[lo:hi].tolist())
                    if edits <= d and edits < found.get(k, (d + 1,))[0]:
                        back, length = distance(self.items[k][1][::-1], seq[lo : lo + end][::-1].tolist())
                        found[k] = (edits, lo + end - length, lo + end)


@lru_cache(2)
def _prepared(key: int, items: tuple) -> Items:  # noqa: ARG001
    return Items(list(items))


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64())])
KIND = "doc_id long, item_id long, distance int, start_word long, end_word long"


def item_blocks(benchmark: DataFrame, most: int = BLOCK_ITEMS, most_bytes: int = BLOCK_BYTES) -> list[tuple]:
    """The items in blocks of checked size, each a tuple of (item_id, text); items without text are left out."""
    blocks, held = [[]], 0
    for i, t in benchmark.select(F.col("item_id").cast("long"), text_bytes()).where("item_id is not null").orderBy("item_id", "text").toLocalIterator():
        if len(blocks[-1]) >= most or held + len(t) > most_bytes and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((i, bytes(t)))
        held += len(t)
    return [tuple(b) for b in blocks if b]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, start_word and end_word: one row for each row of docs and item that it holds.

    A document without text holds nothing; an item without words is held by nothing; items with a null id are left out, and
    without items the result is empty. A text of any length is searched whole; memory follows the longest one.
    A null doc_id comes through; repeated rows give repeated results. Of several places with one item the first with the
    least distance found is given. Columns besides doc_id, item_id and text are not read. Items beyond one block's bound
    are searched block after block, each over all documents.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes())
    out = None
    for number, block in enumerate(item_blocks(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(columns: list[list], shared=shared, number=number) -> list[list]:  # noqa: ANN001
            items = _prepared(number, shared.value)
            found = [(i, *f) for i, t in zip(*columns, strict=True) for f in items.search(t)]
            return [list(c) for c in zip(*found, strict=True)] if found else [[]] * 5

        part = rows.mapInArrow(by_slices(work, FOUND), KIND)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], KIND)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, all columns as they are.

    Each row is judged by its own text, so null and repeated ids don't matter; a null text holds nothing and stays. No row
    is shuffled. Columns may have any names.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    kind = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    out = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    place = docs.columns.index("text")
    # the text passes once, as bytes that are read as a string again
    passed = [F.col(n).cast("binary").alias(n) if k == place else F.col(n) for k, n in enumerate(names)]
    for number, block in enumerate(item_blocks(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            items = _prepared(number, shared.value)
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    # one text at a time is held
                    stays = [not items.search(batch.column(place)[i].as_py() or b"") for i in range(batch.num_rows)]
                    batch = batch.filter(pa.array(stays, pa.bool_()))
                    yield batch.set_column(place, names[place], batch.column(place).view(pa.string()))

        out = out.select(*passed).mapInArrow(work, kind)
    return out.toDF(*docs.columns)
