"""Repeated substrings: every byte covered by a string of LENGTH bytes that also starts elsewhere is removed.

Distributed prefix doubling over the starts that can still matter. Tasks double ranks up to ANCHOR bytes. To go on with
every byte up to LENGTH would shuffle over a hundred times the input, so starts go on in ranges: each string of LENGTH
bytes has one anchor, its position of the least rank, and equal strings have equal anchors at equal offsets. The starts
that share an anchor are one unit, ordered by their offset from it. Then each round

1. ranks ranges of starts by all that the strings of every start of the range hold, at first the anchor alone; what is
   added to the left and to the right grows as ranges shrink, to a quarter of their width each round, until a range is one
   start and its rank that of the whole LENGTH bytes;
2. has Spark regroup the ranks: a range of a rank that nothing else has is left, for none of its starts repeats;
3. ranks what remains by its whole span as well: a range whose span occurs twice repeats with all its starts and is done;
   one of its kind stays as a witness, as long as an undecided range has its rank.

So the rows of a round follow the number of places where repeated text begins or ends, not the bytes. Ranks are hashes,
so no global order is needed: 64 bits where a clash only costs work, 128 bits where it would remove text. Counts are
combined before the shuffle. Each round is written to the shared folder and the one before removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import by_slices, remove, text_bytes, tidy, written

LENGTH, ANCHOR = 400, 64
#: Widths of the ranges of starts, round by round; each divides the one before.
WIDTHS = (64, 16, 4, 1)
#: Starts of one text that are ranked at a time.
STRETCH = 1 << 20
PLACE = 22


def _ranks(x: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all strings of a length that is a power of two, by doubling."""
    rank, step = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while step < length:
        rank = rank[:-step] * np.uint64(0xBF58476D1CE4E5B9) + rank[step:]
        rank ^= rank >> np.uint64(29)
        step *= 2
    return rank * np.uint64(0x94D049BB133111EB)


def units(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[int, int, int]]:
    """(first start, last start, anchor) of the runs of starts that share an anchor."""
    whole, window = np.frombuffer(text, np.uint8), length - anchor + 1
    for at in range(0, max(0, len(text) - length + 1), STRETCH):
        part = whole[at : at + STRETCH + length - 1]
        rank = _ranks(part, anchor)
        least = rank >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(rank), dtype=np.uint64)
        step = 1
        while step * 2 <= window:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if window > step:
            least = np.minimum(least[: len(least) - (window - step)], least[window - step :])
        own = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [len(own) - 1]))
        yield from zip((first + at).tolist(), (last + at).tolist(), (own[first] + at).tolist(), strict=True)


def _long(digest: int) -> int:
    return digest - (1 << 63)


def _two(digest: int) -> tuple[int, int]:
    return _long(digest >> 64), _long(digest & (2**64 - 1))


def _columns(rows: list[tuple], width: int) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * width


def _unit_rows(length: int, anchor: int):  # noqa: ANN202
    def work(columns: list[list]) -> list[list]:
        out: list[tuple] = []
        for i, mark, text in zip(*columns, strict=True):
            for s, e, p in units(text, length, anchor):
                out.append((i, mark, s, e, p, _long(xxhash.xxh64_intdigest(text[p : p + anchor])), *_two(xxhash.xxh3_128_intdigest(text[s : e + length], p - s))))
        return _columns(out, 8)

    return work


def _context_rows(length: int):  # noqa: ANN202
    def work(columns: list[list]) -> list[list]:
        return _columns([(i, mark, x["p"], x["s"], x["e"], x["open"], text[x["s"] : x["e"] + length]) for i, mark, text, own in zip(*columns, strict=True) for x in own], 7)

    return work


def _range_rows(length: int, anchor: int, width: int, before: int):  # noqa: ANN202
    """The ranges of `width` starts that those of width `before` split into, with both ranks."""
    most = length - anchor

    def work(columns: list[list]) -> list[list]:
        out: list[tuple] = []
        for i, mark, p, s, e, context, own in zip(*columns, strict=True):
            near, far = p - e, p - s
            for x in own:
                for k in range(x["node"] * before // width, min((x["node"] + 1) * before - 1, far) // width + 1):
                    low, high = k * width, min(k * width + width - 1, most)
                    a, b = p - min(high, far), p - max(low, near)  # the unit's first and last start in the range
                    if a <= b:
                        rank = xxhash.xxh64_intdigest(context[p - low - s : p - high + length - s], k)
                        out.append((i, mark, p, k, a, b, x["open"], _long(rank), *_two(xxhash.xxh3_128_intdigest(context[a - s : b + length - s], p - a))))
        return _columns(out, 10)

    return work


def _cut(length: int):  # noqa: ANN202
    def work(columns: list[list]) -> list[list]:
        out: list[tuple] = []
        for i, text, own in zip(*columns, strict=True):
            spans: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in own or ()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e + length)
                else:
                    spans.append([s, e + length])
            edges = [0, *(x for span in spans for x in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((i, len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in spans], kept))
        return _columns(out, 5)

    return work


KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<struct<start long, end long>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}


def _mapped(df: DataFrame, work, **fields: str) -> DataFrame:  # noqa: ANN001
    """df through a work of by_slices; fields: the new columns with their types."""
    return df.mapInArrow(by_slices(work, pa.schema([(n, KINDS[k]) for n, k in fields.items()])), ", ".join(f"{n} {k}" for n, k in fields.items()))


def _of(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df joined with other on keys that may be null; the other's keys are left out."""
    named = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(named, on, how).drop(*(f"_{k}" for k in keys))


ROW = ["doc_id", "mark"]


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs) and kept (binary, what is left) of each row of docs.

    A null text is empty; a text shorter than `length` loses nothing; a very long one is ranked a stretch at a time. Repeated
    rows are places of their own, so a text of enough bytes that occurs in two rows is removed whole, under one id or two;
    a null doc_id comes through. Other columns are not read. An empty table gives an empty result. `anchor` is a power of
    two, less than `length`.
    """
    spark = docs.sparkSession
    # a row is known by its id and its text: equal rows have equal spans
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), text_bytes().alias("text"))
    whole = dict.fromkeys(("doc_id", "mark", "s", "e", "p", "rank", "u", "v"), "long")
    every = written(_mapped(rows.where(F.length("text") >= length), _unit_rows(length, anchor), **whole), "units")
    # ranks that stay are written before rows are joined with them: only then can Spark split a rank of very many rows
    twice = written(every.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank"), "ranks")
    live = written(every.join(twice, "rank"), "live")
    remove(every)
    remove(twice)
    tidy(spark)
    counted = live.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"), F.min(F.struct(*ROW, "s", "e", "p")).alias("one"))
    kinds = written(counted.select("u", "v", "rank", (F.col("n") == 1).alias("open"), "one.*"), "kinds")
    found = [written(live.join(kinds.where("NOT open").select("u", "v"), ["u", "v"], "left_semi").select(*ROW, "s", "e"), "found")]
    remove(live)
    undecided = lambda df: df.join(written(df.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("some")).where("n > 1 AND some").select("rank"), "ranks"), "rank")
    todo = undecided(kinds).groupBy(*ROW).agg(F.collect_list(F.struct("p", "s", "e", "open")).alias("own"))
    contexts = written(_mapped(_of(rows, todo, ROW).select(*ROW, "text", "own"), _context_rows(length), **dict.fromkeys(("doc_id", "mark", "p", "s", "e"), "long"), open="boolean", context="binary"), "contexts")
    remove(kinds)
    tidy(spark)
    part = contexts.withColumn("own", F.array(F.struct(F.lit(0).cast("long").alias("node"), "open")))
    before = length
    for width in widths:
        ids = dict.fromkeys(("doc_id", "mark", "p", "node", "s", "e"), "long")
        nodes = written(_mapped(part.select(*ROW, "p", "s", "e", "context", "own"), _range_rows(length, anchor, width, before), **ids, open="boolean", rank="long", u="long", v="long"), "ranges")
        counted = nodes.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.min("open").alias("alone"), F.min("rank").alias("rank"), F.min(F.struct(*ROW, "p", "node")).alias("one"))
        kinds = written(counted.select("u", "v", "rank", (F.col("alone") & (F.col("n") == 1)).alias("open"), "one.*"), "kinds")
        found.append(written(nodes.where("open").join(kinds.where("NOT open").select("u", "v"), ["u", "v"], "left_semi").select(*ROW, "s", "e"), "found"))
        remove(nodes)
        if width > 1:
            alive = written(undecided(kinds).groupBy(*ROW, "p").agg(F.collect_list(F.struct("node", "open")).alias("own")), "alive")
            part = _of(contexts, alive, [*ROW, "p"])
            before = width
        remove(kinds)
        tidy(spark)
    remove(contexts)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    own = spans.distinct().groupBy(*ROW).agg(F.collect_list(F.struct("s", "e")).alias("own"))
    return _mapped(_of(rows, own, ROW, "left").select("doc_id", "text", "own"), _cut(length), doc_id="long", n_bytes="long", n_removed="long", spans="array<struct<start long, end long>>", kept="binary")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the SHA-256 of what is left, and removed: whether anything was."""
    kept = [F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", *kept, (F.col("n_removed") > 0).alias("removed"))


def brute(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, bytes]]:
    """Bytes removed, runs and what is left of each text, from counts of all strings; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for at in range(len(t) - length + 1):
            seen[t[at : at + length]] = seen.get(t[at : at + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for at in range(len(t) - length + 1):
            if seen[t[at : at + length]] > 1:
                gone[at + 1 : at + length + 1] = True
        mask = gone[1:-1]
        out.append((int(mask.sum()), int((gone[1:] & ~gone[:-1]).sum()), bytes(np.frombuffer(t, np.uint8)[~mask])))
    return out
