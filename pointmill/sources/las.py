"""The data source "las": LAS and compressed LAS files as tables of points and of file facts, and a writer.

    spark.dataSource.register(LasSource)
    spark.read.format("las").load(path)                                   points, with point_index
    spark.read.format("las").option("columns", "x,y").load(path)          only these columns, only they are made
    spark.read.format("las").option("chunks", "0,7").load(path)           only these chunks of a compressed file
    spark.read.format("las").option("chunk_list", "7,0,7").load(path)     these chunks in this order, repeats too, with position
    spark.read.format("las").option("pushdown", "true").load(path)        conditions on point_index choose partitions
    spark.read.format("las").option("table", name).load(path)             header, vlr (extended ones too), chunks, items (of
                                                                          the codec), index (cells and runs), geo_keys, wkt
    spark.read.format("las").option("table", "vlr").option("payloads", "false").load(path)    records without their payloads
    df.write.format("las").option("format", 3).mode("overwrite").save(path)
    df.write.format("las").option("compressed", "true").option("parts", "true").mode("overwrite").save(folder)

A path is a file, or a folder of .las and .laz files, which count on from each other in the order of their names. A raw file
is read by ranges of records, a compressed one by chunks, each a partition, or several small ones of very many. With pushdown, which needs the session's
spark.sql.python.filterPushdown.enabled, conditions on point_index leave out partitions before they are read, those on records
leave their payloads unread; without, they
hold as well, on all partitions. Paths to read are plain ones or URIs (see stores); those to write are plain ones of a file
system that driver and executors share.

With parts, every writing task makes a whole file of its own, and commit only gives the files their names: that is the way
for large tables. Without, commit joins the tasks' parts on the driver in the order of tasks and puts the header in front, as
one file has one header; onefile.write() makes one file with the parts copied by tasks. Either way a lost task leaves nothing behind. Sort by point_index before a write where order matters.
"""

from __future__ import annotations

import base64
import json
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from pointmill.codec import chunks as codec
from pointmill.sources import index as spatial
from pointmill.sources import layout
from pointmill.sources.stores import files_of, opened

#: Records of one read partition of a raw file, of one Arrow batch, and of a written chunk.
SPLIT, BATCH, CHUNK = 1 << 20, 1 << 16, 50_000
#: Chunks or ranges that are a partition each; beyond, consecutive small ones share one, up to CHUNK points.
APART = 256
_AXES = [f"{p}_{a}" for p in ("scale", "offset", "min", "max") for a in "xyz"]
_TABLES: dict[str, T.StructType | str] = {
    "header": "file string, version string, system_id string, software string, source_id int, global_encoding int, project_id string, day int, year int, format int, compressed boolean, record_length int, extra_bytes int, point_offset long, "
    "wave_offset long, evlr_offset long, n_vlrs long, n_evlrs long, n_points long, by_return array<long>, " + ", ".join(f"{a} double" for a in _AXES),
    "vlr": "file string, kind string, ordinal int, reserved int, user_id string, record_id int, description string, length long, payload_offset long, payload binary",
    "chunks": "file string, chunk_id long, n_points long, first_point long, compressed_size long, compressed_offset long",
    "items": "file string, compressor int, chunk_size long, ordinal int, item_type int, item_size int, item_version int",
    "index": "file string, source string, levels int, min_x double, max_x double, min_y double, max_y double, cell long, number_points long, intervals array<struct<start long, end long>>",
    "geo_keys": "file string, key int, short_value int, double_values array<double>, ascii_value string",
    "wkt": "file string, math string, coordinate string",
}


def replace(new: str, target: str) -> None:
    """Gives a file or folder the target's name. What had it is kept aside until then, so a stop in between loses neither."""
    aside = f"{target.rstrip('/')}.old-{uuid.uuid4().hex}"
    if os.path.lexists(target):
        os.rename(target, aside)
    os.rename(new, target)
    if os.path.isdir(aside):
        shutil.rmtree(aside)
    elif os.path.exists(aside):
        os.remove(aside)


def _codec_record(f, head: dict) -> codec.Descriptor:  # noqa: ANN001
    for r in layout.read_vlrs(f, head | {"n_evlrs": 0}, is_codec):
        if is_codec(r):
            return codec.described(r["payload"])
    raise ValueError("a compressed file without a record of its items")


def is_codec(record: dict) -> bool:
    """Whether a record describes the codec's items; both spellings of its user occur in files."""
    return record["kind"] == "vlr" and record["reserved"] in (0, codec.MARK) and record["user_id"] in ("laszip encoded", "LAZ encoded") and record["record_id"] == codec.NUMBER


def _projection(record: dict) -> bool:
    return record["user_id"] == layout.PROJECTION


def chunk_table(f, head: dict, d: codec.Descriptor) -> list[tuple[int, int, int, int]]:  # noqa: ANN001
    """(points, first point, bytes, place in the file) of each chunk."""
    f.seek(head["point_offset"])
    raw = f.read(8)
    at = struct.unpack("<q", raw)[0] if len(raw) == 8 else -1
    if at < head["point_offset"] + 8:
        raise ValueError("the place of the table of chunks isn't known")
    f.seek(at)
    # two numbers of 33 symbols, each at most 32 bits and a class, per chunk
    n = struct.unpack("<II", f.read(8))[1]
    f.seek(at)
    rows = codec.read_table(f.read(8 + 16 * n + 64), d.chunk_size, head["n_points"])
    return [(n, first, size, head["point_offset"] + place) for n, first, size, place in rows]


def index_of(path: str, records: list[dict]) -> tuple[str, spatial.Index] | None:
    """The index in the first extended record that holds one, else in a sidecar file; a damaged one counts as none."""
    for r in records:
        if r["kind"] == "evlr" and r["user_id"] == spatial.USER and r["record_id"] == spatial.NUMBER:
            try:
                return "evlr", spatial.parsed(r["payload"])
            except ValueError:
                break
    try:
        with opened(os.path.splitext(path)[0] + ".lax") as f:
            return "sidecar", spatial.parsed(f.read())
    except (OSError, ValueError):
        return None


def wkt_of(records: list[dict]) -> tuple[str | None, str | None]:
    """The texts of the mathematical transform and of the coordinate system, without closing zeros; two of a kind raise."""
    out = []
    for number in (layout.MATH_WKT, layout.COORDINATE_WKT):
        own = [r["payload"] for r in records if r["user_id"] == layout.PROJECTION and r["record_id"] == number]
        if len(own) > 1:
            raise ValueError(f"record {number} occurs {len(own)} times")
        out.append(own[0].rstrip(b"\0").decode() if own else None)
    return out[0], out[1]


@dataclass
class Range:
    """Records first to last of a file, whose own count begins at base; a chunk's place and bytes, or none in a raw file."""

    path: str
    base: int
    first: int
    last: int
    place: int = -1
    size: int = 0
    position: int = 0


@dataclass
class Ranges(InputPartition):
    """Ranges of one file that one task reads, one after the other."""

    path: str
    own: list[Range]


def shared(ranges: list[Range]) -> list[Ranges]:
    """The partitions of ranges, in their order; a chunk of few points costs less than a task of its own."""
    most, out, held = -(-len(ranges) // APART), [], 0
    for r in ranges:
        n = r.last - r.first
        if out and out[-1].path == r.path and len(out[-1].own) < most and held + n <= CHUNK:
            out[-1].own.append(r)
            held += n
        else:
            out.append(Ranges(r.path, [r]))
            held = n
    return out or [Ranges("", [])]


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: order, file, count, raw extremes, counts by return, points and bytes of chunks."""

    task: int
    path: str
    n: int = 0
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    by_return: list[int] = field(default_factory=lambda: [0] * 16)
    chunks: list[tuple[int, int]] = field(default_factory=list)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def _head(self) -> dict:
        files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no .las or .laz file in {self.options['path']}")
        with opened(files[0]) as f:
            return layout.read_header(f)

    def schema(self) -> T.StructType | str:
        table = self.options.get("table", "points")
        if table != "points":
            return _TABLES[table]
        h = self._head()
        out = layout.schema(h["format"], h["record_length"])
        wanted = self.options.get("columns")
        out = T.StructType([out[c.strip()] for c in wanted.split(",")]) if wanted else out
        return out.add("position", T.LongType()) if "chunk_list" in self.options else out

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if self.options.get("table", "points") == "points":
            kind = PrunedPoints if self.options.get("pushdown", "false").lower() == "true" else Points
            return kind(self.options["path"], self.options.get("chunks"), schema, self.options.get("chunk_list"))
        pruned = self.options["table"] == "vlr" and self.options.get("pushdown", "false").lower() == "true"
        return (PrunedFacts if pruned else Facts)(self.options["path"], self.options["table"], schema, self.options.get("payloads", "true").lower() == "true")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if os.path.exists(self.options["path"]) and not overwrite:
            raise FileExistsError(self.options["path"])
        return Writer(dict(self.options))


class Points(DataSourceReader):
    def __init__(self, path: str, chosen: str | None, schema: T.StructType, listed: str | None = None):
        self.path, self.names = path, schema.names
        self.listed = None if listed is None else [int(c) for c in listed.split(",") if c.strip()]
        self.chosen = None if chosen is None else {int(c) for c in chosen.split(",") if c.strip()}
        self.low, self.high, self.only = 0, 1 << 62, None

    def _wanted(self, first: int, last: int) -> bool:
        inside = self.only is None or any(first <= v < last for v in self.only)
        return inside and first <= self.high and last > self.low

    def _list(self) -> list[Ranges]:
        """The listed chunks in the list's order, repeats included, each with the place of its first point in the output."""
        (path,) = files_of(self.path)
        with opened(path) as f:
            head = layout.read_header(f)
            n = head["n_points"]
            table = chunk_table(f, head, _codec_record(f, head)) if head["compressed"] and n else [(n, 0, 0, -1)]
        out, position = [], 0
        for k in self.listed or ():
            if not 0 <= k < len(table):
                raise ValueError(f"chunk {k} of {len(table)}")
            n, first, size, place = table[k]
            out.append(Range(path, 0, first, first + n, place, size, position))
            position += n
        return shared([r for r in out if r.first < r.last and self._wanted(r.first, r.last)])

    def partitions(self) -> list[Ranges]:
        if self.listed is not None:
            return self._list()
        out, base = [], 0
        for path in files_of(self.path):
            with opened(path) as f:
                head = layout.read_header(f)
                if head["compressed"]:
                    table = chunk_table(f, head, _codec_record(f, head)) if head["n_points"] else []
                    own = [(k, Range(path, base, first, first + n, place, size)) for k, (n, first, size, place) in enumerate(table) if n]
                else:
                    n = head["n_points"]
                    own = [(0, Range(path, base, a, min(a + SPLIT, n))) for a in range(0, n, SPLIT)]
            out += [r for k, r in own if (self.chosen is None or k in self.chosen) and self._wanted(base + r.first, base + r.last)]
            base += head["n_points"]
        return shared(out)

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        if not part.own:
            return
        with opened(part.path) as f:
            head = layout.read_header(f)
            d = _codec_record(f, head) if head["compressed"] and head["n_points"] else None
            for r in part.own:
                yield from self._points(f, head, d, r) if d else self._records(f, head, r)

    def _points(self, f, head: dict, d: codec.Descriptor, r: Range) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        """A chunk."""
        f.seek(r.place)
        whole = codec.decode(f.read(r.size), r.last - r.first, d)
        if whole.shape[1] != head["record_length"]:
            raise ValueError("the items make records of another length than the header says")
        for at in range(0, len(whole), BATCH):
            yield self._batch(np.ascontiguousarray(whole[at : at + BATCH]).tobytes(), head["format"], head["record_length"], r.base + r.first + at, r.position + at)

    def _records(self, f, head: dict, r: Range) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        """A range of a raw file."""
        length = head["record_length"]
        for at in range(r.first, r.last, BATCH):
            n = min(BATCH, r.last - at)
            f.seek(head["point_offset"] + at * length)
            raw = f.read(n * length)
            if len(raw) < n * length:
                raise ValueError("the file ends within its points")
            yield self._batch(raw, head["format"], length, r.base + at, r.position + at - r.first)

    def _batch(self, raw: bytes, fmt: int, length: int, first: int, position: int = 0) -> pa.RecordBatch:
        kinds = {f.name: f.dataType for f in layout.schema(fmt, length)}
        arrow = {T.IntegerType(): pa.int32(), T.ShortType(): pa.int16(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.FloatType(): pa.float32(), T.BinaryType(): pa.binary()}
        n, kinds["position"] = len(raw) // length, T.LongType()
        cols = layout.decode(raw, fmt, length, set(self.names)) | {"point_index": np.arange(first, first + n), "position": np.arange(position, position + n)}
        return pa.RecordBatch.from_arrays([pa.array(cols[c] if isinstance(cols[c], list) else cols[c].astype(arrow[kinds[c]].to_pandas_dtype()), arrow[kinds[c]]) for c in self.names], names=list(self.names))


class PrunedPoints(Points):
    """Takes conditions; Spark refuses readers that do in a session without spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds on point_index choose partitions; Spark still applies every condition."""
        for f in filters:
            if getattr(f, "attribute", None) == ("point_index",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
                if isinstance(f, In):
                    self.only = sorted(v for v in f.value if v is not None)
            yield f


class Facts(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, payloads: bool = True):
        self.path, self.table, self.names, self.payloads = path, table, schema.names, payloads
        self.only: list[tuple[str, set]] = []

    def _wants(self, record: dict) -> bool:
        """Whether a record's payload is read; else it is passed over."""
        return self.payloads and all(record[c] in values for c, values in self.only)

    def read(self, part: InputPartition) -> Iterator[tuple]:
        for path in files_of(self.path):
            with opened(path) as f:
                head = layout.read_header(f)
                for row in getattr(self, f"_{self.table}")(f, head, path):
                    row["file"] = os.path.basename(path)
                    yield tuple(row[c] for c in self.names)

    def _header(self, f, head: dict, path: str) -> list[dict]:  # noqa: ANN001, ARG002
        return [head | {"extra_bytes": head["record_length"] - layout.record(head["format"]).itemsize}]

    def _vlr(self, f, head: dict, path: str) -> list[dict]:  # noqa: ANN001, ARG002
        return layout.read_vlrs(f, head, self._wants)

    def _chunks(self, f, head: dict, path: str) -> list[dict]:  # noqa: ANN001, ARG002
        """A raw file is one chunk."""
        n = head["n_points"]
        rows = chunk_table(f, head, _codec_record(f, head)) if head["compressed"] and n else [(n, 0, n * head["record_length"], head["point_offset"])] if n else []
        return [{"chunk_id": k, "n_points": n, "first_point": a, "compressed_size": size, "compressed_offset": at} for k, (n, a, size, at) in enumerate(rows)]

    def _items(self, f, head: dict, path: str) -> list[dict]:  # noqa: ANN001, ARG002
        if not head["compressed"]:
            return []
        d = _codec_record(f, head)
        return [{"compressor": d.compressor, "chunk_size": d.chunk_size, "ordinal": k, "item_type": i.type, "item_size": i.size, "item_version": i.version} for k, i in enumerate(d.items)]

    def _index(self, f, head: dict, path: str) -> list[dict]:  # noqa: ANN001
        found = index_of(path, layout.read_vlrs(f, head, lambda r: r["kind"] == "evlr" and (r["user_id"], r["record_id"]) == (spatial.USER, spatial.NUMBER)))
        if found is None:
            return []
        source, i = found
        box = {"source": source, "levels": i.levels, "min_x": i.min_x, "max_x": i.max_x, "min_y": i.min_y, "max_y": i.max_y}
        return [box | {"cell": c, "number_points": sum(b - a + 1 for a, b in runs), "intervals": runs} for c, runs in i.cells.items()]

    def _geo_keys(self, f, head: dict, path: str) -> list[dict]:  # noqa: ANN001, ARG002
        own = {r["record_id"]: r["payload"] for r in layout.read_vlrs(f, head, _projection) if r["user_id"] == layout.PROJECTION and r["kind"] == "vlr"}
        if layout.DIRECTORY not in own:
            return []
        return layout.geo_keys(own[layout.DIRECTORY], own.get(layout.DOUBLES, b""), own.get(layout.TEXT, b""))

    def _wkt(self, f, head: dict, path: str) -> list[dict]:  # noqa: ANN001, ARG002
        math, coordinate = wkt_of(layout.read_vlrs(f, head, _projection))
        return [{"math": math, "coordinate": coordinate}]


class PrunedFacts(Facts):
    """Records whose conditions don't hold aren't read further than their headers; Spark leaves them out."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("kind",), ("user_id",), ("record_id",), ("ordinal",)):
                self.only.append((f.attribute[0], set(f.value) if isinstance(f, In) else {f.value}))
            yield f


class Writer(DataSourceArrowWriter):
    """Options: format, extrabytes, scale_x.., offset_x.., compressed, chunk_size, parts, stage (leave the parts), wkt and wkt_math (texts), header (fields
    as JSON: source_id, global_encoding, project_id, system_id), records (JSON list of user_id, record_id, description,
    payload in base 64, extended). Columns that are not there are zero; nulls raise."""

    def __init__(self, options: dict):
        self.path, self.fmt = options["path"], int(options.get("format", 0))
        self.extra = int(options.get("extrabytes", 0))
        self.length = layout.record(self.fmt).itemsize + self.extra
        self.scale, self.offset = ([float(options.get(f"{k}_{a}", d)) for a in "xyz"] for k, d in (("scale", 0.001), ("offset", 0.0)))
        self.compressed, self.whole, self.stage = (options.get(k, "false").lower() == "true" for k in ("compressed", "parts", "stage"))
        self.chunk = int(options.get("chunk_size", CHUNK))
        if self.compressed:
            codec.items_of(self.fmt, self.extra)
        self.head = json.loads(options.get("header", "{}"))
        if "system_id" in options:
            self.head["system_id"] = options["system_id"]
        self.records = [(options[k], n) for k, n in (("wkt_math", layout.MATH_WKT), ("wkt", layout.COORDINATE_WKT)) if options.get(k)]
        self.more = json.loads(options.get("records", "[]"))
        self.parts = f"{self.path.rstrip('/')}.parts-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.parts, exist_ok=True)
        out = Part(context.partitionId(), f"{self.parts}/{context.partitionId()}-{context.taskAttemptId()}")
        with open(out.path, "wb") as f:
            held: list[np.ndarray] = []
            waiting = 0
            for batch in batches:
                rows = self._rows(batch, out)
                if not self.compressed:
                    f.write(rows.tobytes())
                    continue
                held.append(rows)
                waiting += len(rows)
                while waiting >= self.chunk:
                    rows = np.concatenate(held)
                    self._chunk(f, rows[: self.chunk], out)
                    held, waiting = [rows[self.chunk :]], waiting - self.chunk
            if waiting:
                self._chunk(f, np.concatenate(held), out)
        if self.whole and out.n:
            self._assemble(f"{out.path}.whole", [out])
            os.remove(out.path)
        return out

    def _rows(self, batch: pa.RecordBatch, out: Part) -> np.ndarray:
        if not batch.num_rows:
            return np.zeros(0, layout.record(self.fmt, self.length))
        for name, c in zip(batch.schema.names, batch.columns, strict=True):
            if c.null_count and name != "extra_bytes":
                raise ValueError(f"{name} has nulls; a record has none")
        cols = {n: c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        rows = layout.encode(cols, self.fmt, self.length)
        low, high = [int(rows[a].min()) for a in "xyz"], [int(rows[a].max()) for a in "xyz"]
        out.low = list(map(min, out.low, low)) if out.n else low
        out.high = list(map(max, out.high, high)) if out.n else high
        out.n += len(rows)
        if "return_number" in cols:
            out.by_return = [a + int(b) for a, b in zip(out.by_return, np.bincount(np.array(cols["return_number"], np.int64), minlength=16), strict=True)]
        return rows

    def _chunk(self, f, rows: np.ndarray, out: Part) -> None:  # noqa: ANN001
        data = codec.encode(np.frombuffer(rows.tobytes(), np.uint8).reshape(len(rows), self.length), codec.items_of(self.fmt, self.extra))
        f.write(data)
        out.chunks.append((len(rows), len(data)))

    def frame(self, parts: list[Part]) -> tuple[bytes, bytes]:
        """What comes before the parts' points in one file, header and records, and after them, table of chunks and extended records."""
        counts, sizes = [n for m in parts for n, _ in m.chunks], [s for m in parts for _, s in m.chunks]
        records = [layout.vlr(layout.PROJECTION, n, t.encode() + b"\0") for t, n in self.records]
        records += [layout.vlr(r["user_id"], r["record_id"], base64.b64decode(r["payload"]), r.get("description", "")) for r in self.more if not r.get("extended")]
        if self.compressed:
            size = codec.chunk_size_of(counts)
            records.append(layout.vlr(codec.USER, codec.NUMBER, codec.items_of(self.fmt, self.extra, size or self.chunk).payload(), "items of the codec", reserved=codec.MARK))
        before = b"".join(records)
        extended = [layout.vlr(r["user_id"], r["record_id"], base64.b64decode(r["payload"]), r.get("description", ""), extended=True) for r in self.more if r.get("extended")]
        head = self.head | {"format": self.fmt, "compressed": self.compressed, "record_length": self.length, "scale": self.scale, "offset": self.offset, "n_vlrs": len(records), "point_offset": layout.HEADER_14 + len(before)}
        head |= {"n_points": sum(m.n for m in parts), "by_return": [sum(m.by_return[r] for m in parts) for r in range(1, 16)]}
        for k, a in enumerate("xyz"):  # a negative scale turns the ends round; no points: all zero
            ends = [f(getattr(m, s)[k] for m in parts) * self.scale[k] + self.offset[k] for f, s in ((min, "low"), (max, "high"))] if parts else [0.0]
            head |= {f"min_{a}": min(ends), f"max_{a}": max(ends)}
        table = codec.table_bytes(counts, sizes) if self.compressed else b""
        end = head["point_offset"] + (8 + sum(sizes) + len(table) if self.compressed else head["n_points"] * self.length)
        head |= {"n_evlrs": len(extended), "evlr_offset": end if extended else 0}
        pointer = struct.pack("<q", head["point_offset"] + 8 + sum(sizes)) if self.compressed else b""
        return layout.write_header(head) + before + pointer, table + b"".join(extended)

    def _assemble(self, to: str, parts: list[Part]) -> None:
        """One file of the tasks' parts."""
        before, after = self.frame(parts)
        with open(to, "wb") as f:
            f.write(before)
            for m in parts:
                with open(m.path, "rb") as part:
                    shutil.copyfileobj(part, f, 1 << 24)
            f.write(after)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.n), key=lambda m: m.task)
        if self.stage:
            os.makedirs(self.parts, exist_ok=True)
            with open(f"{self.parts}/parts.json", "w", encoding="utf-8") as f:
                json.dump([asdict(m) | {"path": f"{self.path}/{os.path.basename(m.path)}"} for m in parts], f)
            replace(self.parts, self.path)
            return
        if self.whole:
            end, folder = "laz" if self.compressed else "las", f"{self.parts}.new"
            if not parts:
                os.makedirs(self.parts, exist_ok=True)
                self._assemble(f"{self.parts}/none.whole", [])
                parts = [Part(0, f"{self.parts}/none")]
            os.makedirs(folder)
            for m in parts:
                os.replace(f"{m.path}.whole", f"{folder}/part-{m.task:06d}.{end}")
            replace(folder, self.path)
        else:
            self._assemble(whole := f"{self.parts}.whole", parts)
            replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)
