"""Reductions with a state of the user's own type, in two levels: a state for each task, merged as a tree in Spark.

    reduce(points, start=Moments, step=Moments.add, combine=Moments.merge, finish=Moments.row, schema="n long, ...")

start() makes an empty state, step(state, batch) takes an Arrow batch, combine(a, b) joins the states of earlier and later
rows, finish(state) gives the result as a dictionary. Functions and states must pickle. combine must be associative; it
need not be commutative, as states are joined in the order of df's partitions. No task holds more than FAN states.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that one task merges, and how often: enough for 64^3 tasks.
FAN, LEVELS = 64, 3
STATES = pa.schema([("at", pa.int64()), ("state", pa.binary())])


def reduce(df: DataFrame, start: Callable[[], Any], step: Callable[[Any, pa.RecordBatch], Any], combine: Callable[[Any, Any], Any], finish: Callable[[Any], dict], schema: str) -> DataFrame:
    """One row: the reduction of all rows of df. A table without rows gives finish(start()). Nulls come to step as they are."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            if batch.num_rows:
                state = step(state, batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], schema=STATES)

    def merge(states: pa.Table) -> pa.Table:
        states = states.sort_by("at")
        first, *rest = map(pickle.loads, states["state"].to_pylist())
        for s in rest:
            first = combine(first, s)
        return pa.table([pa.array([states["at"][0].as_py() // FAN]), pa.array([pickle.dumps(first)], pa.binary())], schema=STATES)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("state").to_pylist():
                yield pa.RecordBatch.from_pylist([finish(pickle.loads(s))], schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    kind = "at long, state binary"
    none = df.sparkSession.createDataFrame([(0, bytearray(pickle.dumps(start())))], kind)  # df may have no partitions
    states = none.unionByName(df.mapInArrow(partial, kind).withColumn("at", F.col("at") + 1))
    for _ in range(LEVELS - 1):
        states = states.groupBy(F.expr(f"at div {FAN}")).applyInArrow(merge, kind)
    return states.groupBy().applyInArrow(merge, kind).mapInArrow(last, schema)


class Bounds:
    """Bounds of x and y that grow with what they are shown; nothing is within those that were shown nothing. Nulls don't count."""

    def __init__(self) -> None:
        self.min_x = self.min_y = math.inf
        self.max_x = self.max_y = -math.inf

    def update(self, x: float, y: float) -> Bounds:
        self.min_x, self.min_y = min(self.min_x, x), min(self.min_y, y)
        self.max_x, self.max_y = max(self.max_x, x), max(self.max_y, y)
        return self

    def contains(self, x: float, y: float) -> bool:
        return self.min_x <= x <= self.max_x and self.min_y <= y <= self.max_y

    def add(self, batch: pa.RecordBatch) -> Bounds:
        whole = batch.filter(pc.and_(batch.column("x").is_valid(), batch.column("y").is_valid()))
        if whole.num_rows:
            ends = [pc.min_max(whole.column(a)).as_py() for a in "xy"]
            self.update(ends[0]["min"], ends[1]["min"]).update(ends[0]["max"], ends[1]["max"])
        return self

    def merge(self, other: Bounds) -> Bounds:
        return self.update(other.min_x, other.min_y).update(other.max_x, other.max_y) if other.min_x <= other.max_x else self

    def row(self) -> dict:
        return {k: float(v) if math.isfinite(v) else None for k, v in vars(self).items()}

    KIND = "min_x double, min_y double, max_x double, max_y double"
