"""SimHash near-dedup by a generalised pigeonhole.

Fingerprints within `limit` bits of each other are found by partitions of the bits. If the partitions have thresholds
whose sum is limit - partitions + 1, two such fingerprints agree in at least one partition up to its threshold. Bits that
vary together go into one partition, and the thresholds, unequal, come from a dynamic programme that minimises the
candidates estimated from counts over all fingerprints. Each fingerprint is indexed under its own bits of a partition and
probes under all bit patterns within the threshold; every candidate is verified.

Equal fingerprints are one class from the start, so only distinct fingerprints are indexed. A key that holds more than
CELL of them is split into blocks, and each pair of blocks is compared on its own, so no task holds a large group and no
link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import by_slices, remove, text_bytes, written
from pointmill.llm.components import components

SHINGLE, LIMIT, SEED = 4, 4, 42
#: Numbers of partitions among which the cheapest is taken: fewer have longer keys, and more probes for each fingerprint.
PARTS = (2, 3)
#: Fingerprints under one key that one task compares with each other.
CELL = 2000
#: Rows of one group that a task holds at once.
HELD = 50_000
#: What one probe costs, in candidates.
PROBE_COST = 2.0


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is 1 if over half of the shingles' hashes have it."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.fromiter([digest(whole[a:b], SEED) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64, n - SHINGLE + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(columns: list[list]) -> list[list]:
    prints = [fingerprint(t) for t in columns[-1]]
    return [columns[0], np.array(prints, np.uint64).view(np.int64)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row."""
    kind = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(by_slices(_fingerprints, kind), "doc_id long, fp long")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how often each two bits are both 1, and the number of fingerprints."""
    total, n = np.zeros((64, 64)), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 65536):
            x = batch.column(0).to_numpy(zero_copy_only=False)[at : at + 65536].view(np.uint64)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
    flat = np.concatenate((total.ravel(), [n]))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])


def bit_moments(prints: DataFrame) -> tuple[np.ndarray, int]:
    rows = prints.select("fp").mapInArrow(_moments, "i int, v double").groupBy("i").agg(F.sum("v")).collect()  # 4097 numbers
    flat = np.zeros(64 * 64 + 1)
    for i, v in rows:
        flat[i] = v
    return flat[:-1].reshape(64, 64), int(flat[-1])


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in `parts` partitions of near equal size, each grown by the bit that is most correlated with it so far."""
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            own.append(best := max(left, key=lambda b: (corr[b, own].sum(), -b)))
            left.remove(best)
        out.append(sorted(own))
    return out


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The least cost, and the thresholds of the given sum that have it, one for each partition; cost[p][t + 1] is for threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (v, chosen) in best.items():
            for t in range(-1, len(c) - 1):
                w = v + c[t + 1]
                if s + t not in new or w < new[s + t][0]:
                    new[s + t] = (w, [*chosen, t])
        best = new
    return best[total]


def plan(prints: DataFrame, limit: int = LIMIT, parts: tuple[int, ...] = PARTS) -> list[tuple[list[int], int]]:
    """Partitions of the bits with their thresholds, in the number of partitions that costs least.

    Candidates of a partition at threshold 0 are counted, over all fingerprints; those at higher thresholds are the
    count times what independent bits of the same means would add. Candidates grow with the square of the fingerprints,
    probes with their number, so many fingerprints take fewer partitions with longer keys.
    """
    both, n = bit_moments(prints)
    mean = np.diag(both) / max(n, 1)
    tried = [(k, group_bits(both, n, k)) for k in parts]
    counted = {}
    for _, groups in tried:
        for bits in groups:
            pairs = F.sum(F.col("c") * (F.col("c") - 1.0) / 2)
            counted[tuple(bits)] = prints.groupBy(_key_column(bits).alias("k")).agg(F.count(F.lit(1)).alias("c")).agg(pairs).first()[0] or 0.0
    plans = []
    for k, groups in tried:
        (spent, thresholds) = allocate([_costs(bits, counted[tuple(bits)], mean, n, limit) for bits in groups], limit - k + 1)
        plans.append((spent, k, list(zip(groups, thresholds, strict=True))))
    return min(plans)[2]


def _costs(bits: list[int], pairs: float, mean: np.ndarray, n: int, limit: int) -> list[float]:
    """What a partition costs without probes and at each threshold from 0 on."""
    near = np.array([1.0])
    for b in bits:  # distribution of the distance of two fingerprints on these bits
        a = mean[b] ** 2 + (1 - mean[b]) ** 2
        near = np.convolve(near, [a, 1 - a])
    at0 = max(near[0], 1e-30)
    row, probes = [0.0], 0
    for t in range(limit + 1):
        probes += comb(len(bits), t)
        row.append(max(pairs, n * n / 2 * at0) * near[: t + 1].sum() / at0 + PROBE_COST * n * probes)
    return row


def _key_column(bits: list[int]):  # noqa: ANN202
    return F.col("fp").bitwiseAND(F.lit(sum(1 << b for b in bits) - (2**64 if 63 in bits else 0)))


def _masks(bits: list[int], threshold: int) -> np.ndarray:
    """The bit patterns by which a key within the threshold may differ, 0 first."""
    flips = [sum(1 << b for b in c) for t in range(threshold + 1) for c in combinations(bits, t)]
    return np.array(flips, np.uint64)


def _spread(chosen: list[tuple[list[int], int]]):  # noqa: ANN202
    """For mapInArrow: fp to (key, part, probe, fp): one index row and the probes of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for p, (bits, t) in enumerate(chosen):
                if t < 0:
                    continue
                mask, flips = np.uint64(sum(1 << b for b in bits)), _masks(bits, t)
                for at in range(0, len(x), step := max(1, 200_000 // len(flips))):
                    y = x[at : at + step]
                    keys = ((y & mask)[:, None] ^ flips[None, :]).ravel()
                    probe = np.tile(np.arange(len(flips)) > 0, len(y))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), p, np.int8)), pa.array(probe), pa.array(np.repeat(y, len(flips)).view(np.int64))], names=["key", "part", "probe", "fp"]
                    )

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links, those that join two parts which were not yet joined."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent, keep = list(range(len(nodes))), []
    x, y = flat[: len(a)].tolist(), flat[len(a) :].tolist()
    for k in range(len(x)):
        i, j = x[k], y[k]
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[max(i, j)] = min(i, j)
            keep.append(k)
    return a[keep], b[keep]


def _verify(limit: int):  # noqa: ANN202
    """For mapInArrow over rows sorted by (key, part, cell, probe): verified links, a forest of them for each stretch.

    Rows of the first side (probe false) are compared with all later rows of their group.
    """

    def links(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, part, cell, probe, fp = rows
        n = len(key)
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (cell[1:] != cell[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        end = np.repeat(starts + sizes, sizes)
        first = np.flatnonzero(~probe & (end > np.arange(n) + 1))
        todo = end[first] - first - 1
        found_a, found_b = [], []
        upto = np.cumsum(todo)
        at = 0
        while at < len(first):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 2_000_000, "right")))
            i = np.repeat(first[at:stop], todo[at:stop])
            inner = np.arange(len(i)) - np.repeat(np.cumsum(todo[at:stop]) - todo[at:stop], todo[at:stop])
            j = i + 1 + inner
            near = np.bitwise_count(fp[i] ^ fp[j]) <= limit
            a, b = fp[i[near]], fp[j[near]]
            a, b = _forest(a, b) if len(a) > 50_000 else (a, b)
            found_a.append(a)
            found_b.append(b)
            at = stop
        if found_a:
            a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows[4] = rows[4].view(np.uint64)
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from links([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
            if len(held[0]) > HELD:  # a group of very many probes passes by; its index rows stay
                yield from links(held)
                held = [x[~held[3]] for x in held]
        if held is not None and len(held[0]):
            yield from links(held)

    return run


def near_links(prints: DataFrame, chosen: list[tuple[list[int], int]], limit: int = LIMIT, cell: int = CELL) -> DataFrame:
    """a, b: links among distinct fingerprints (column fp) that connect all that are within `limit` bits of each other."""
    keys = prints.select("fp").mapInArrow(_spread(chosen), "key long, part byte, probe boolean, fp long")
    # counts of index rows by key, combined before the shuffle; few keys are large
    index = [prints.select(_key_column(bits).alias("key"), F.lit(p).cast("byte").alias("part")) for p, (bits, t) in enumerate(chosen) if t >= 0]
    every = index[0]
    for x in index[1:]:
        every = every.unionByName(x)
    large = written(every.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > cell).select("key", "part", F.ceil(F.col("c") / cell).cast("int").alias("blocks")), "large")
    if large.isEmpty():
        dealt = keys.withColumn("cell", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        joined = keys.join(large, ["key", "part"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
        # an index row goes to the cells of its block with every block, a probe row to each block's cell with itself
        pairs = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        at = F.when(F.col("probe"), F.col("other") * (F.col("blocks") + 1)).otherwise(low * F.col("blocks") + high)
        dealt = pairs.select("key", "part", "probe", "fp", at.cast("long").alias("cell"))
    order = ["key", "part", "cell", "probe", "fp"]
    sorted_rows = dealt.select(*order).repartition("key", "part", "cell").sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(_verify(limit), "a long, b long")


def rooted(classes: DataFrame, limit: int = LIMIT, parts: tuple[int, ...] = PARTS, cell: int = CELL) -> DataFrame:
    """classes (distinct fingerprints in fp, other columns as they are) with root, one fingerprint for each component."""
    chosen = plan(classes, limit, parts)
    links = written(near_links(classes, chosen, limit, cell), "near")
    if links.isEmpty():
        return classes.withColumn("root", F.col("fp"))
    roots = written(components(links).withColumnsRenamed({"node": "fp"}), "roots")
    remove(links)
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def cluster(docs: DataFrame, limit: int = LIMIT, parts: tuple[int, ...] = PARTS, cell: int = CELL) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long) and component_id, the smallest doc_id reachable by links.

    A null or blank text has fingerprint 0, which links like any other. A text of any length is read whole. A null doc_id is
    never the smallest unless a component has no other; repeated rows are equal and share a component. Only doc_id and
    text are read, so other columns may have any names. An empty table gives an empty result.
    """
    rows = written(fingerprints(docs), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = rooted(classes, limit, parts, cell)
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(found.join(least, "root").select("fp", "component_id"), "named")
    remove(classes)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame, limit: int = LIMIT, parts: tuple[int, ...] = PARTS, cell: int = CELL) -> DataFrame:
    """One row of docs for each component of fingerprints, all columns: that of the smallest doc_id, null last.

    Rows without words (null and blank texts too) all stay and link to none. The choice is by row, not by id: of rows that
    share an id, or are alike, one stays. An empty table gives an empty result. Columns may have any names but _row.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    kind = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64())])
    work = lambda columns: [columns[0], *_fingerprints(columns[1:])]
    prints = written(rows.select("_row", F.col("doc_id").cast("long"), text_bytes()).mapInArrow(by_slices(work, kind), "row long, doc_id long, fp long").where("fp <> 0"), "fingerprints")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    classes = written(prints.groupBy("fp").agg(one.alias("one")), "classes")
    # what goes is fewer than what stays
    stays = written(rooted(classes, limit, parts, cell).groupBy("root").agg(F.min("one").alias("one")).select("one.row"), "stays")
    goes = written(prints.select("row").join(stays, "row", "left_anti").select(F.col("row").alias("_gone")), "goes")
    for done in (prints, classes, stays):
        remove(done)
    return rows.join(goes, F.col("_row") == F.col("_gone"), "left_anti").drop("_row")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal and component_id."""
    return cluster(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
