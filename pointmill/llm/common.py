"""What the corpus operators share: reading tables, the shared folder, Arrow batches of texts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five control characters from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one slice of an Arrow batch that are held as Python objects at once.
SLICE = 256
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The file of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and one machine does all (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pointmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path  # noqa: SLF001
    return out


def remove(df: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    spark, path = df.sparkSession, df._written_at  # noqa: SLF001
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what nothing refers to any more, as it does only after garbage collections.

    For steps of many rounds whose results are written: without it the files of all rounds lie on disk until the end.
    """
    gc.collect()
    spark._jvm.System.gc()  # noqa: SLF001


def text_bytes(text: Column | str = "text") -> Column:
    """The text in UTF-8 as binary; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text, F.lit("")).cast("binary")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


@contextmanager
def uncollected() -> Iterator[None]:
    """No garbage collection meanwhile: large stores of small objects, none in cycles, would be gone through again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def by_slices(
    work: Callable[[list[list]], list[list]], schema: pa.Schema, most_bytes: int = 4 << 20
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: work gets the columns of a few rows as lists and returns the output's columns.

    A slice ends at SLICE rows or once its buffers reach most_bytes, so memory follows the longest text only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, step = 0, max(1, min(SLICE, batch.num_rows * most_bytes // max(1, batch.nbytes)))
            while start < batch.num_rows:
                part = batch.slice(start, step)
                start += step
                out = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run
