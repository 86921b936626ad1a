"""Line dedup: frequent lines are indexed by a sharded minimal perfect hash, which the documents probe.

Spark counts in how many documents each long line occurs, by line hash. The frequent ones are split into shards by hash;
a task builds each shard's minimal perfect hash (levels of bit arrays; a key that collides goes on to the next level) and
the arrays that it indexes: a 64-bit fingerprint, the count and the largest document id. Documents hash their lines
and probe the arrays. The shards are sent to all executors if their size, known from the exact number of keys, is within
a bound; beyond it the hashes of lines go to the shards: each task gets a shard and a part of its lines, and probes it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pointmill.llm.common import BLANKS, by_slices, lower_ascii, remove, text_bytes, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of one shard; bytes that a key takes in it, at most; bytes of all shards up to which they are sent to executors;
#: beyond that, tasks among which a shard's lines are dealt out at least, and documents with the shard's most frequent key
#: for each further one.
SHARD_KEYS, KEY_BYTES, INDEX_BYTES, PARTS, PART_ROWS = 100_000, 32, 64 << 20, 8, 1_000_000
LEVELS, GAMMA = 24, 2.0
NO_ID = np.iinfo(np.int64).min


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: index() gives each key its own number below n."""

    def __init__(self, keys: np.ndarray):
        self.bits: list[tuple[int, np.ndarray, np.ndarray]] = []  # of each level: size, words, keys placed before each word
        left, base = keys.astype(np.uint64), 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(len(left) * GAMMA) + 63 & ~63)
            at = _mixed(left, level) % np.uint64(size)
            taken = np.bincount(at.astype(np.int64), minlength=size)
            alone = (taken == 1).astype(np.uint8)
            words = np.packbits(alone.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
            ranks = base + np.concatenate(([0], np.cumsum(np.bitwise_count(words))[:-1]))
            self.bits.append((size, words, ranks.astype(np.uint32)))
            base += int(alone.sum())
            left = left[alone[at.astype(np.int64)] == 0]
        self.rest = {int(k): base + i for i, k in enumerate(left)}  # in practice none after so many levels

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1, or any number, for a key that is not in the set."""
        keys = keys.astype(np.uint64)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.bits):
            at = (_mixed(keys[todo], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = ranks[at[hit] >> 6] + below[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        for i in todo if self.rest else ():
            out[i] = self.rest.get(int(keys[i]), -1)
        return out


def line_keys(text: Column) -> Column:
    """For each line a struct of two hashes, or null for a line whose key is short."""

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    keys = F.transform(lines, lambda x: lower_ascii(F.trim(x, F.lit(BLANKS))))
    return F.transform(keys, lambda k: F.when(F.length(k) >= MIN_CHARS, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(k, F.lit(7)).alias("g"))))


def frequent(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h, g, n, last: the keys found in at least min_docs rows, with the largest doc_id that holds them.

    A row's lines are made distinct before they are shuffled, and counts are combined before as well.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.array_distinct(F.filter(line_keys(F.col("text")), lambda k: k.isNotNull())).alias("keys"))
    one = own.select("id", F.explode("keys").alias("k")).select("id", "k.h", "k.g")
    return one.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)


Shard = tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray, dict[tuple[int, int], int]]


def shard_of(h: np.ndarray, g: np.ndarray, n: np.ndarray, last: np.ndarray) -> Shard:
    """The hash, the fingerprints, counts and last ids that it indexes, and the last ids of keys whose h another key has."""
    _, first = np.unique(h, return_index=True)
    mph = PerfectHash(h[first].view(np.uint64))
    at = mph.index(h[first].view(np.uint64))
    prints, counts, ids = np.zeros(len(first), np.int64), np.zeros(len(first), np.uint32), np.zeros(len(first), np.int64)
    prints[at], counts[at], ids[at] = g[first], np.minimum(n[first], 2**32 - 1), last[first]
    rest = np.setdiff1d(np.arange(len(h)), first)
    return mph, prints, counts, ids, {(int(h[i]), int(g[i])): int(last[i]) for i in rest}


def _build(part_rows: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = shard_of(*(pdf[c].to_numpy(np.int64) for c in ("h", "g", "n", "last")))
        parts = max(PARTS, -(-int(pdf["n"].max()) // part_rows))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "parts": [parts], "arrays": [pickle.dumps(shard)]})

    return run


def index_shards(keys: DataFrame, n: int) -> tuple[int, DataFrame]:
    """The number of shards, and a row for each with its pickled hash and arrays."""
    shards = max(1, -(-n // SHARD_KEYS))
    rows = keys.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    # pandas keeps 64-bit ids whole only without nulls
    rows = rows.withColumn("last", F.coalesce("last", F.lit(NO_ID)))
    return shards, rows.groupBy("shard").applyInPandas(_build(PART_ROWS), "shard int, parts int, arrays binary")


def _gone(shard: Shard, h: np.ndarray, g: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of each line, whether it goes: its key is indexed and its document isn't the last that holds it."""
    mph, prints, _, last, rest = shard
    out = np.zeros(len(h), bool)
    if len(h) and len(prints):
        at = mph.index(h.view(np.uint64))
        mine = np.flatnonzero((at >= 0) & (at < len(prints)))
        mine = mine[prints[at[mine]] == g[mine]]
        held = last[at[mine]]
        out[mine] = (held != own[mine]) & (held != NO_ID)
    for i in np.flatnonzero(np.isin(h, [k for k, _ in rest])) if rest else ():
        held = rest.get((int(h[i]), int(g[i])), NO_ID)
        out[i] |= held not in (own[i], NO_ID)
    return out


def _drops(index: tuple[int, dict[int, Shard]], ids: list, h: np.ndarray, g: np.ndarray, shard: np.ndarray, owner: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), bool)
    own = np.array([NO_ID if i is None else i for i in ids], np.int64)
    for s, arrays in index[1].items():
        mine = np.flatnonzero(shard == s)
        if len(mine):
            out[mine] = _gone(arrays, h[mine], g[mine], own[owner[mine]])
    return out


def _probe(shared, extra: int):  # noqa: ANN001, ANN202
    """The work of by_slices: the first columns are doc_id, text, hashes of its lines and their shards."""
    loaded: list = []

    def work(columns: list[list]) -> list[list]:
        if not loaded:
            shards, blobs = shared.value
            loaded.append((shards, {s: pickle.loads(b) for s, b in blobs.items()}))  # noqa: S301
        ids, texts, hs, gs, ss = columns[:5]
        lengths = [len(x) for x in hs]
        owner = np.repeat(np.arange(len(ids)), lengths)
        flat = lambda c: np.array([v for x in c for v in x], np.int64)
        short = np.array([v is None for x in hs for v in x], bool)
        zero = lambda c: [[0 if v is None else v for v in x] for x in c]
        gone = _drops(loaded[0], ids, flat(zero(hs)), flat(zero(gs)), flat(zero(ss)), owner) & ~short
        kept, dropped, at = [], [], 0
        for text, n in zip(texts, lengths, strict=True):
            part = gone[at : at + n]
            at += n
            drops = int(part.sum())
            dropped.append(drops)
            kept.append(text if not drops else b"\n".join(x for x, g in zip(text.split(b"\n"), part, strict=True) if not g))
        return [*columns[5 : 5 + extra], lengths, dropped, [k.decode("utf-8", "replace") for k in kept]]

    return work


def dedup(docs: DataFrame, keep: list[str], min_docs: int = MIN_DOCS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The columns `keep` of docs, and n_lines, n_dropped and kept, the text without its dropped lines.

    A null or empty text is one empty line, and kept is then ''. Each row counts as a document, so repeated rows with one
    id all hold the line, and all keep it if theirs is the largest id. Texts may be of any length. A null id is below every other; if only null ids
    hold a line, none loses it. Bytes that are no UTF-8 come back as U+FFFD. Other columns than doc_id, text and `keep` are not read; keep must not name the new ones.
    """
    keys = written(frequent(docs, min_docs), "lines")
    n = keys.count()
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)), F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    if n * KEY_BYTES <= index_bytes:
        shards, built = index_shards(keys, n)
        blobs = {r["shard"]: bytes(r["arrays"]) for r in built.toLocalIterator()}  # index_bytes at most
        remove(keys)
        shared = docs.sparkSession.sparkContext.broadcast((shards, blobs))
        probe = rows.select("_id", text_bytes("_text").alias("_t"), line_keys(F.col("_text")).alias("_k"), *(f"_{i}" for i in range(len(keep))))
        shard = F.transform("_k", lambda k: F.pmod(F.xxhash64(k["h"]), F.lit(shards)))
        probe = probe.select("_id", "_t", F.col("_k.h").alias("_h"), F.col("_k.g").alias("_g"), shard.alias("_s"), *(f"_{i}" for i in range(len(keep))))
        types = docs.select(*(F.col(f"`{c}`") for c in keep)).schema
        kind = ", ".join([*(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(types)), "n_lines long", "n_dropped long", "kept string"])
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = pa.schema([*((f"_{i}", to_arrow_type(f.dataType)) for i, f in enumerate(types)), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])
        out = probe.mapInArrow(by_slices(_probe(shared, len(keep)), arrow), kind)
    else:
        out = _dealt(rows, *index_shards(keys, n), docs.select(*(F.col(f"`{c}`") for c in keep)).schema)
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "n_lines", "n_dropped", "kept")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, each shard's arrays before its lines: the lines that go."""
    arrays, now = None, None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        for at in np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))).tolist():
            rows = batch.slice(at, int(np.searchsorted(shard[at:], shard[at], "right")))
            if shard[at] != now:
                now, arrays = shard[at], pickle.loads(rows.column("arrays")[0].as_py())  # noqa: S301
                rows = rows.slice(1)
            long = lambda c, rows=rows: rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
            own = pa.compute.fill_null(rows.column("id"), NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            gone = _gone(arrays, long("h"), long("g"), own) if len(rows) else np.zeros(0, bool)
            yield rows.filter(pa.array(gone)).select(["id", "mark", "at"])


def _cut(extra: int):  # noqa: ANN202
    def work(columns: list[list]) -> list[list]:
        kept, lengths, dropped = [], [], []
        for text, gone in zip(*columns[:2], strict=True):
            lines, out = text.split(b"\n"), set(gone or ())
            lengths.append(len(lines))
            dropped.append(len(out))
            kept.append((text if not out else b"\n".join(x for i, x in enumerate(lines) if i not in out)).decode("utf-8", "replace"))
        return [*columns[2 : 2 + extra], lengths, dropped, kept]

    return work


def _dealt(rows: DataFrame, shards: int, built: DataFrame, types: StructType) -> DataFrame:
    """The same for an index over the bound: hashes of lines are shuffled to their shards, then places back to documents."""
    from pyspark.sql.pandas.types import to_arrow_type

    extra = len(types)
    rows = rows.withColumn("_text", F.coalesce("_text", F.lit(""))).withColumn("_mark", F.xxhash64("_text"))
    lines = rows.select(F.col("_id").alias("id"), F.col("_mark").alias("mark"), F.posexplode(line_keys(F.col("_text"))).alias("at", "k")).where("k IS NOT NULL")
    lines = lines.select(F.pmod(F.xxhash64("k.h"), F.lit(shards)).cast("int").alias("shard"), "id", "mark", "at", "k.h", "k.g")
    null = lambda kind: F.lit(None).cast(kind)
    table = written(built, "shards")
    arrays = table.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), null("long").alias("id"), null("long").alias("mark"), null("int").alias("at"), null("long").alias("h"), null("long").alias("g"), "arrays")
    # shards with a very frequent line: two numbers each, and one shard in SHARD_KEYS keys
    more = F.broadcast(table.where(F.col("parts") > PARTS).select("shard", "parts"))
    part = F.pmod(F.xxhash64("id", "mark", "at"), F.coalesce("parts", F.lit(PARTS))).cast("int")
    lines = lines.join(more, "shard", "left").select("shard", part.alias("part"), "id", "mark", "at", "h", "g")
    both = arrays.unionByName(lines.withColumn("arrays", null("binary"))).repartition("shard", "part").sortWithinPartitions("part", "shard", F.col("arrays").isNull())
    # shard and part make one number, so that each pair of them begins with its arrays
    both = both.withColumn("shard", F.col("part") * shards + F.col("shard"))
    hit = both.select("shard", "id", "mark", "at", "h", "g", "arrays").mapInArrow(_stream, "id long, mark long, at int")
    gone = hit.groupBy(F.col("id").alias("_i"), F.col("mark").alias("_m")).agg(F.collect_set("at").alias("_gone"))
    found = rows.join(gone, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_mark") == F.col("_m")), "left")
    kind = ", ".join([*(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(types)), "n_lines long", "n_dropped long", "kept string"])
    arrow = pa.schema([*((f"_{i}", to_arrow_type(f.dataType)) for i, f in enumerate(types)), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])
    return found.select(text_bytes("_text"), "_gone", *(f"_{i}" for i in range(extra))).mapInArrow(by_slices(_cut(extra), arrow), kind)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    return dedup(docs, ["doc_id"]).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in SQL for small tables.
SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, i, line, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def brute(rows: list[tuple[int | None, str | None]], min_docs: int = MIN_DOCS) -> Iterator[tuple]:
    """The contract on a small list, line by line; for tests."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANKS).translate(low)
    held: dict[str, list] = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held.setdefault(k, []).append(i)
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = []
        for x in lines:
            ids = held[key(x)]
            known = [j for j in ids if j is not None]
            stay += [x] if len(key(x)) < MIN_CHARS or len(ids) < min_docs or not known or i == max(known) else []
        yield i, len(lines), len(lines) - len(stay), "\n".join(stay)
