"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens meet in the whole corpus.

A transducer reads both sequences. Its state is the side that leads and that side's unmatched bytes; the next token comes
from the other side, and the step, remembered by state and token, leaves what is unmatched then. Where nothing is left both
end at one byte and the group closes. Each step out of a state with unmatched bytes meets one token of the leading side: these
are all pairs of tokens whose bytes overlap.

Both tokenizers cut at spaces after what is no white space, so there the state is empty: words are tokenized and aligned
once and stored. Tokens come from the tokenizers' libraries.

Counts of pairs over the corpus: documents are aligned in blocks of a bounded size, each with a dictionary of its own
pairs; documents refer to places in it. Spark sums the dictionaries' counts by pair, finds each B token's highest one, and
joins the sums back to the dictionaries; each block meets only its own. A pair in every document is one row of each block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import text_bytes, uncollected, written
from pointmill.llm.op3_bpe import byte_symbols
from pointmill.llm.op13_bytes import Store, ranges

#: Words, and steps, in a worker's stores; code points of a word that is stored, at most.
CACHE, STORED = 200_000, 64
#: Bytes of texts whose new words are tokenized together, and of a block. A longer text is a block of its own.
TOGETHER, BLOCK = 1 << 20, 4 << 20
SPACE = "▁"


def vocabularies() -> tuple[str, str]:
    """The files of tokenizers A and B that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Two tokenizers and the transducer between them."""

    def __init__(self, path_a: str, path_b: str, size: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        back = {c: n for n, c in enumerate(byte_symbols())}
        names = self.a.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for t, i in names.items():
            self.bytes_a[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.text_a, self.text_b = list(map(str, range(len(self.bytes_a)))), list(map(str, range(len(self.bytes_b))))
        self.width = max(len(self.bytes_a), len(self.bytes_b))
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.left: list[tuple[int, bytes]] = [(0, b"")]
        self.steps = Store(self._step, size)
        self.words: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.size = size
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        first = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
        #: whether both cut before a space after what is none; else texts are aligned whole
        self.cuts = plain and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        blank = ranges("".join(c for c in map(chr, range(0x10000)) if c.isspace()) + "\x85᠎​﻿")
        self.empty = self.b.piece_to_id(SPACE)
        #: states after each token of A from the empty state; those of no bytes and those not met yet are 0
        self.firsts = [self._state(0, t) for t in self.bytes_a]
        self.inner, self.border = re.compile(f" (?<=[{blank}] )"), re.compile(f"(?<=[^{blank}])(?= )")

    def _step(self, key: int) -> int:
        """The state after a state and the next token of the side behind; ValueError if their bytes differ.

        States with A ahead are even, those with B ahead odd; the empty one is 0 and takes a token of A.
        """
        state, token = divmod(key, self.width)
        ahead, rest = self.left[state]
        if not rest:
            return self._state(0, self.bytes_a[token])
        new = (self.bytes_b, self.bytes_a)[ahead][token]
        if rest.startswith(new):
            return self._state(ahead, rest[len(new) :])
        if new.startswith(rest):
            return self._state(1 - ahead, new[len(rest) :])
        raise ValueError("other bytes")

    def _state(self, ahead: int, rest: bytes) -> int:
        if not rest:
            return 0
        got = self.states.get((ahead, rest))
        if got is None:
            got = len(self.left) + (len(self.left) + ahead) % 2
            self.left += [(ahead, rest)] * (got + 1 - len(self.left))
            self.states[ahead, rest] = got
        return got

    def align(self, ids_a: list[int], ids_b: list[int]) -> tuple[str, bytes, int, int] | None:
        """Groups as text, links as packed 64-bit integers (A's id times 2^32 and B's), numbers of A's and B's tokens.

        None where the two sequences aren't of the same bytes.
        """
        steps, width, text_a, text_b, firsts = self.steps, self.width, self.text_a, self.text_b, self.firsts
        groups, links, i, j, n = [], [], 0, 0, len(ids_b)
        try:
            while j < n:
                before, other, a = i, j, ids_a[i]
                state = firsts[a] or steps[a]  # from the empty state
                i += 1
                while state:
                    if state & 1:
                        token = a = ids_a[i]
                        i += 1
                    else:
                        token = b = ids_b[j]
                        j += 1
                    links.append(a << 32 | b)
                    state = steps[state * width + token]
                if i - before == 1:
                    own = text_a[a]
                else:
                    own = ",".join([text_a[t] for t in ids_a[before:i]])
                if j - other == 1:
                    groups.append(f"{own}|{text_b[b]}")
                else:
                    groups.append(f"{own}|{','.join([text_b[t] for t in ids_b[other:j]])}")
        except (IndexError, ValueError):  # one side ends within a token of the other, or they differ
            return None
        return (";".join(groups), pack(f"<{len(links)}Q", *links), i, n) if i == len(ids_a) else None

    def _cut(self, text: str) -> list[str]:
        """The words of space+text, without the space that each begins with."""
        if not self.cuts:
            return [text]
        if text[:1] == " " or self.inner.search(text):
            return [w[1:] for w in self.border.split(" " + text)]
        return text.split(" ")

    def texts(self, texts: list[str]) -> list[tuple[str, bytes, int, int] | None]:
        """align() of each text; None where it is empty or can't be aligned."""
        cut = [self._cut(t) if t else [] for t in texts]
        if len(self.words) >= self.size:
            self.words, self.older = {}, self.words
        new = set().union(*cut).difference(self.words)
        for w in [w for w in new if w in self.older]:
            self.words[w] = self.older[w]
            new.discard(w)
        new = list(new)
        ids_a = self.a.encode_batch_fast([" " + w for w in new], add_special_tokens=False)
        for w, a, b in zip(new, ids_a, self.b.encode(new, num_threads=1), strict=True):
            self.words[w] = self.align(a.ids, b or [self.empty])
        get, out = self.words.__getitem__, []
        for words in cut:
            parts = list(map(get, words))
            if not parts or not all(parts):
                out.append(None)
                continue
            groups, links, n_a, n_b = zip(*parts)
            out.append((";".join(groups), b"".join(links), sum(n_a), sum(n_b)))
        for w in new:
            if len(w) > STORED:
                del self.words[w]
        return out


@lru_cache(1)
def load(path_a: str, path_b: str) -> Aligner:
    """One pair of tokenizers for each Python worker."""
    return Aligner(path_a, path_b)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about that many bytes; a longer text is one by itself."""
    sizes = np.diff(np.frombuffer(batch.column("text").cast(pa.large_binary()).buffers()[1], np.int64)[batch.column("text").offset :][: batch.num_rows + 1])
    start = total = 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and total + size > most:
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += size
    yield batch.slice(start)


def _aligned(paths: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, int]]:
    """Ids and alignments of the documents, a slice at a time, and the slice's bytes."""
    for batch in batches:
        for part in _slices(batch, TOGETHER) if batch.num_rows else ():
            # Spark's strings may hold bytes that are no UTF-8; they are read as U+FFFD
            texts = [t.decode("utf-8", "replace") for t in part.column("text").to_pylist()]
            with uncollected():
                found = load(*paths).texts(texts)
            yield part.column("doc_id").to_pylist(), found, part.nbytes


LINKS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
ALIGNED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("groups", pa.string()), ("links", LINKS)])


def align(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """doc_id, n_a, n_b, groups and links of every row of docs.

    groups is text, `a1,a2|b1;a3|b2,b3` of decimal ids, links the pairs of tokens whose bytes overlap, in order. Texts that
    are null or empty, or whose tokens have other bytes than the text, have no tokens: zeros, an empty text, no links. Null
    and repeated ids and rows come through as they are, an empty table gives an empty result, bytes that are no UTF-8 count as
    U+FFFD. Only doc_id and text are read. paths are those of the tokenizers' files, the same on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found, _ in _aligned(paths, batches):
            found = [f or ("", b"", 0, 0) for f in found]
            pairs = np.frombuffer(b"".join(f[1] for f in found), np.uint64).astype(np.int64)
            ends = np.cumsum([0, *(len(f[1]) // 8 for f in found)])
            both = pa.StructArray.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF)], ["a", "b"])
            links = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[0] for f in found]), links], schema=ALIGNED)

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, n_a long, n_b long, groups string, links array<struct<a: long, b: long>>")


ROW = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
BLOCKS = pa.schema([("block", pa.int64()), *((n, pa.list_(t)) for n, t in ROW), ("places", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary())])
SCORED = pa.schema([*ROW[:5], ("n_best", pa.int64()), ("count_sum", pa.int64()), ROW[5]])


def _narrow(n: int) -> type:
    """The type of places in a dictionary of n pairs."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _blocks(paths: tuple[str, str], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each block: its documents' columns as lists, the links as places in the dictionary, the dictionary with counts."""

    def block(number: int, rows: list[tuple], links: list[bytes]) -> pa.RecordBatch:
        pairs, places, counts = np.unique(np.frombuffer(b"".join(links), np.uint64), return_inverse=True, return_counts=True)
        columns = zip(*rows, strict=True)
        lists = [pa.array([list(c)], pa.list_(t)) for c, (_, t) in zip(columns, ROW, strict=True)]
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (places.astype(_narrow(len(pairs))), pairs, counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *packed], schema=BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, links, total = TaskContext.get().partitionId() << 32, [], [], 0
        for ids, found, size in _aligned(paths, batches):
            if rows and total + size > most:
                yield block(number, rows, links)
                number, rows, links, total = number + 1, [], [], 0
            total += size
            for doc_id, one in zip(ids, found, strict=True):
                if one is None:
                    rows.append((doc_id, 0, 0, 0, 0, ""))
                    continue
                groups, own, n_a, n_b = one
                rows.append((doc_id, n_a, n_b, groups.count("|"), len(own) // 8, hashlib.sha256(groups.encode()).hexdigest()))
                links.append(own)
        if rows:
            yield block(number, rows, links)

    return run


PAIRS = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])


def _dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            pairs, counts = np.frombuffer(row["pairs"], np.uint64), np.frombuffer(row["counts"], np.int64)
            for at in range(0, len(pairs), 1 << 16):
                some = pairs[at : at + (1 << 16)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["block"])), pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.array(some), pa.array(counts[at : at + len(some)])], schema=PAIRS)


def _score(blocks: pa.Table, sums: pa.Table) -> pa.Table:
    """The documents' rows of one block, with the corpus-wide counts of its dictionary."""
    (row,) = blocks.to_pylist()
    total, best = np.zeros(sums.num_rows, np.int64), np.zeros(sums.num_rows, np.int64)
    at = sums["place"].to_numpy()
    total[at], best[at] = sums["total"].to_numpy(), sums["best"].to_numpy()
    places, ends = np.frombuffer(row["places"], _narrow(sums.num_rows)), np.cumsum([0, *row["n_links"]])
    sums_of = [np.concatenate([[0], np.cumsum(x[places])]) for x in (best, total)]
    new = {"n_best": np.diff(sums_of[0][ends]), "count_sum": np.diff(sums_of[1][ends])}
    return pa.table([pa.array(new.get(f.name, row.get(f.name)), f.type) for f in SCORED], schema=SCORED)


def score(docs: DataFrame, paths: tuple[str, str], block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs.

    A pair's count is the number of links of all documents that hold it; n_best counts a document's links whose count is the
    highest of all pairs of their B id, count_sum adds up the counts. Rows without tokens (see align(), whose cases hold
    here as well) have zeros and an empty groups_sha256.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    kind = ", ".join(f"{n} array<{'string' if t == pa.string() else 'long'}>" for n, t in ROW)
    blocks = written(rows.mapInArrow(_blocks(paths, block), f"block long, {kind}, places binary, pairs binary, counts binary"), "blocks")
    pairs = blocks.select("block", "pairs", "counts").mapInArrow(_dictionaries, "block long, place int, pair long, n long")
    sums = written(pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "sums")
    highest = sums.groupBy("b").agg(F.max("total").alias("highest"))
    marked = sums.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    known = pairs.select("block", "place", "pair").join(marked, "pair").select("block", "place", "total", "best")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.drop("pairs", "counts").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score, out)
