"""One file from many tasks without passing points through the driver.

    write(df, "/shared/a.laz", format="6", compressed="true")

Tasks write their parts and report counts, extremes and sizes. The driver reserves the target's full length, and puts header,
records, table of chunks and extended records in their places; a second Spark stage copies each part, in pieces, to the place
that the sum of the sizes before it gives. A piece that is copied twice, as after a lost executor, is the same bytes in the same
place. Only then does the file take the target's name. The folder must be a file system that allows writing at a place.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pointmill.sources.las import LasSource, Part, Writer, replace

#: Bytes of one piece of a part, and of one read.
PIECE, BUFFER = 1 << 27, 1 << 22
COPIED = pa.schema([("place", pa.int64()), ("size", pa.int64())])


def _copy(target: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            with open(row["path"], "rb") as source, open(target, "r+b") as out:
                source.seek(row["start"])
                out.seek(row["place"])
                left = row["size"]
                while left:
                    data = source.read(min(left, BUFFER))
                    if not data:
                        raise ValueError(f"{row['path']} ends before its size")
                    out.write(data)
                    left -= len(data)
                out.flush()
                os.fsync(out.fileno())
            done.append(row["size"])
        yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(done, pa.int64())], schema=COPIED)


class OneFile:
    """The steps of a write: stage(), reserve(), place(), finish(), in this order; another one raises ValueError."""

    ORDER = ("new", "staged", "reserved", "placed", "finished")

    def __init__(self, target: str, **options: str):
        self.target = target.removeprefix("file://").removeprefix("file:")
        self.options = {k: str(v) for k, v in options.items()}
        self.writer = Writer(self.options | {"path": self.target})
        self.state, self.staged, self.new = "new", f"{self.target}.staged-{uuid.uuid4().hex}", f"{self.target}.new-{uuid.uuid4().hex}"

    def _step(self, to: str) -> None:
        at = self.ORDER.index(to)
        if self.state != self.ORDER[at - 1]:
            raise ValueError(f"a file that is {self.state} can't become {to}")
        self.state = to

    def stage(self, df: DataFrame) -> OneFile:
        """Writes the parts, one for each task, in the order of df's partitions."""
        self._step("staged")
        df.sparkSession.dataSource.register(LasSource)
        df.write.format("las").options(**self.options | {"stage": "true"}).mode("overwrite").save(self.staged)
        with open(f"{self.staged}/parts.json", encoding="utf-8") as f:
            self.parts = [Part(**p) for p in json.load(f)]
        return self

    def reserve(self) -> OneFile:
        """Makes the file in its full length with all but the points; its bytes here don't grow with them but for the table of chunks."""
        self._step("reserved")
        before, after = self.writer.frame(self.parts)
        sizes = [os.path.getsize(p.path) for p in self.parts]
        self.pieces, place = [], len(before)
        for p, size in zip(self.parts, sizes, strict=True):
            self.pieces += [(p.path, at, place + at, min(PIECE, size - at)) for at in range(0, size, PIECE)]
            place += size
        self.framed = len(before) + len(after)
        with open(self.new, "wb") as f:
            f.write(before)
            f.truncate(place + len(after))
            f.seek(place)
            f.write(after)
        return self

    def place(self, spark: SparkSession) -> OneFile:
        """Copies the pieces to their places, a task for each few."""
        self._step("placed")
        if self.pieces:
            new, tasks = self.new, min(len(self.pieces), 10 * spark.sparkContext.defaultParallelism)
            rows = spark.createDataFrame(self.pieces, "path string, start long, place long, size long").repartition(tasks, "place")
            done = rows.mapInArrow(lambda batches: _copy(new, batches), "place long, size long").groupBy().sum("size").first()[0]
            if done != sum(p[3] for p in self.pieces):
                raise ValueError("not all bytes were copied")
        return self

    def finish(self) -> None:
        """Gives the file its name and removes the parts."""
        self._step("finished")
        replace(self.new, self.target)
        shutil.rmtree(self.staged, ignore_errors=True)


def write(df: DataFrame, target: str, **options: str) -> OneFile:
    """df's points as one file; options are those of the data source's writer. What was there before is replaced at the end."""
    one = OneFile(target, **options)
    try:
        one.stage(df).reserve().place(df.sparkSession).finish()
    except BaseException:
        shutil.rmtree(one.staged, ignore_errors=True)
        if os.path.exists(one.new):
            os.remove(one.new)
        raise
    return one
