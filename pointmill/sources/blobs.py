"""Point files from any store that Spark reads: whole files as rows of bytes, decoded in the tasks.

For stores that the data source "las" can't open. Each file is one row, so files should be of moderate size (folders of parts
are); their points come with the file's path and their place in it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pointmill.codec import chunks as codec
from pointmill.sources import las, layout

FILES = "path string, modificationTime timestamp, length long, content binary"


def schema(fmt: int, extra: int = 0) -> T.StructType:
    """path, and the points' columns of the format."""
    own = layout.schema(fmt, layout.record(fmt).itemsize + extra)
    return T.StructType([T.StructField("path", T.StringType()), *own.fields])


def _records(content: bytes) -> Iterator[tuple[dict, int, bytes]]:
    """(header, first point, records) of parts of a file."""
    f = io.BytesIO(content)
    head = layout.read_header(f)
    start, length, n = head["point_offset"], head["record_length"], head["n_points"]
    if not head["compressed"]:
        if len(content) < start + n * length:
            raise ValueError("the file ends within its points")
        for at in range(0, n, las.BATCH):
            yield head, at, content[start + at * length : start + min(n, at + las.BATCH) * length]
    elif n:
        d = las._codec_record(f, head)  # noqa: SLF001
        for count, first, size, place in las.chunk_table(f, head, d):
            if count:
                yield head, first, np.ascontiguousarray(codec.decode(content[place : place + size], count, d)).tobytes()


def decoded(files: DataFrame, fmt: int, extra: int = 0) -> DataFrame:
    """The points of files (path, content), all of one format and number of extra bytes; another kind of file raises."""
    out = schema(fmt, extra)
    arrow = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.ShortType(): pa.int16(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.FloatType(): pa.float32(), T.BinaryType(): pa.binary()}
    kinds = [(f.name, arrow[f.dataType]) for f in out.fields]
    length = layout.record(fmt).itemsize + extra

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path = batch.column(0)[k].as_py()
                for head, first, raw in _records(batch.column(1)[k].as_py()):
                    if (head["format"], head["record_length"]) != (fmt, length):
                        raise ValueError(f"{path} has records of format {head['format']} and {head['record_length']} bytes")
                    n = len(raw) // length
                    cols = layout.decode(raw, fmt, length) | {"point_index": np.arange(first, first + n), "path": [path] * n}
                    yield pa.RecordBatch.from_arrays([pa.array(cols[c] if isinstance(cols[c], list) else cols[c].astype(t.to_pandas_dtype()), t) for c, t in kinds], names=[c for c, _ in kinds])

    return files.select("path", "content").mapInArrow(work, out)


def read(spark: SparkSession, path: str, fmt: int, extra: int = 0) -> DataFrame:
    """The points of all .las and .laz files under a path of any store."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", "*.la[sz]").load(path), fmt, extra)
