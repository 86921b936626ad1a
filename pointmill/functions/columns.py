"""Column functions of point records: bit fields, labels, colour bytes, a streaming median."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointmill.codec.items import RETURNS8

#: The labels of the classification codes from 0 on; codes beyond them have none.
CLASSES = [
    "Created, never classified", "Unclassified", "Ground", "Low vegetation", "Medium vegetation", "High vegetation", "Building", "Low point",
    "Model key point", "Water", "Rail", "Road surface", "Overlap points", "Wire guard", "Wire conductor", "Transmission tower", "Wire structure connector",
    "Bridge deck", "High noise", "Overhead structure", "Ignored ground", "Snow", "Temporal exclusion",
]


def bits(byte: Column | str, at: int, width: int) -> Column:
    """The bit field of `width` bits that starts at bit `at`."""
    return F.shiftright(byte, at).bitwiseAND(F.lit((1 << width) - 1))


def packed(*fields: tuple[Column | str, int]) -> Column:
    """One number of several (value, first bit); values must fit their fields."""
    out = F.lit(0)
    for value, at in fields:
        out = out.bitwiseOR(F.shiftleft(value, at))
    return out


def class_label(code: Column | str) -> Column:
    """The name of a classification code, null beyond the known ones."""
    names = F.array(*map(F.lit, CLASSES))
    return F.get(names, F.col(code).cast("int") if isinstance(code, str) else code.cast("int"))


def colour_bytes(colour: Column | str) -> tuple[Column, Column]:
    """The low and the high byte of a colour of 16 bits."""
    return bits(colour, 0, 8), bits(colour, 8, 8)


def colour_of(low: Column | str, high: Column | str) -> Column:
    """The colour of 16 bits from its bytes."""
    return packed((low, 0), (high, 8))


def array_text(values: Column | str) -> Column:
    """An array's values in brackets, separated by commas; nulls in it are left out, a null array is null."""
    return F.concat(F.lit("["), F.array_join(F.col(values) if isinstance(values, str) else values, ", "), F.lit("]"))


#: Meaning of the bits of the global encoding, by the published layout.
ENCODINGS = ["GPS time", "Waveform data internal", "Waveform data external", "Synthetic return numbers", "WKT"]


def encoding_text(flags: Column | str) -> Column:
    """The set bits of a global encoding in words, separated by commas."""
    return F.concat_ws(", ", *(F.when(bits(flags, k, 1) == 1, F.lit(name)) for k, name in enumerate(ENCODINGS)))


def return_context(number_of_returns: Column | str, return_number: Column | str) -> Column:
    """The context of a record of formats 0 to 5, by which intensities are compared."""
    at = packed((return_number, 0), (number_of_returns, 3))
    return F.get(F.array(*(F.lit(c) for row in RETURNS8 for c in row)), at)


def change_masks14(rows: DataFrame, chunk: str, order: str) -> DataFrame:
    """chunk, order and mask of each record of formats 6 to 10 but a chunk's first: which values differ from the last ones.

    Bits: 0 and 1 how the return number turns (0 the same, 1 one more, 2 one less, 3 else, modulo 16), 2 number of returns, 3 scan
    angle, 4 GPS time, 5 source id, 6 the scanner channel of the record before. The last values are those of the last
    record of the same channel in the chunk; a channel that is met first takes over those of the record before. GPS times are compared
    as numbers. Columns are those of the format; a window sees one chunk.
    """
    fields = ["return_number", "number_of_returns", "scan_angle", "gps_time", "point_source_id"]
    own, before = Window.partitionBy(chunk, "scanner_channel").orderBy(order), Window.partitionBy(chunk).orderBy(order)
    last = F.coalesce(F.lag(F.struct(*fields)).over(own), F.lag(F.struct(*fields)).over(before))
    seen = rows.select(chunk, order, "scanner_channel", *fields, last.alias("_last"), F.lag("scanner_channel").over(before).alias("_channel")).where("_last IS NOT NULL")
    turn = F.pmod(F.col("return_number") - F.col("_last.return_number"), F.lit(16))
    bit = lambda c, at: F.when(F.col(c) != F.col(f"_last.{c}"), F.lit(1 << at)).otherwise(F.lit(0))
    mask = F.when(turn == 0, 0).when(turn == 1, 1).when(turn == 15, 2).otherwise(3)
    mask = mask + bit("number_of_returns", 2) + bit("scan_angle", 3) + bit("gps_time", 4) + bit("point_source_id", 5) + F.when(F.col("scanner_channel") != F.col("_channel"), 64).otherwise(0)
    return seen.select(chunk, order, mask.alias("mask"))


def digitized(sample: Column, gain: Column | float, offset: Column | float) -> Column:
    """The units of a digitizer's sample."""
    return sample * gain + offset


def saturated(value: Column) -> Column:
    """The value within 0 to 255."""
    return F.least(F.greatest(value, F.lit(0)), F.lit(255))


def wrapped32(value: Column) -> Column:
    """A long as the signed 32-bit number of the same low bits."""
    return F.pmod(value + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def streaming_medians(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order and median: for each key's numbers in order, the approximate median after each.

    Five sorted slots, from which the largest or the smallest goes, by turns that the last values set. Rows are sorted
    within tasks and stream through them, so a key of any length takes the memory of one batch.
    """
    from pointmill.codec.coder import Median

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, median = None, Median()
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != now:
                    now, median = k, Median()
                median.add(v)
                out.append(median.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=[key, order, "median"])

    dealt = rows.select(*(F.col(c).cast("long") for c in (key, order, value))).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(run, f"{key} long, {order} long, median long")


def streaming_median(values: Column | str) -> Column:
    """For an array of numbers in order, the approximate median after each, as an array. A null array gives null.

    For short arrays; streaming_medians does the same for rows.
    """
    kind = "struct<slots:array<bigint>,largest:boolean,out:array<bigint>>"
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), 5).alias("slots"), F.lit(True).alias("largest"), F.array().cast("array<bigint>").alias("out")).cast(kind)

    def step(a: Column, v: Column) -> Column:
        v, median = v.cast("long"), F.get(a["slots"], F.lit(2))
        left = F.when(a["largest"], F.slice(a["slots"], 1, 4)).otherwise(F.slice(a["slots"], 2, 4))
        slots = F.array_sort(F.concat(left, F.array(v)))
        largest = F.when(v > median, F.lit(False)).when(v < median, F.lit(True)).otherwise(~a["largest"])
        return F.struct(slots.alias("slots"), largest.alias("largest"), F.concat(a["out"], F.array(F.get(slots, F.lit(2)))).alias("out")).cast(kind)

    return F.aggregate(values, start, step, lambda a: a["out"])
