"""Compressed chunks, the table of chunks, and the record that describes the items."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from pointmill.codec.coder import Decoder, Encoder, Integers
from pointmill.codec.items import Bytes, Core10, Gps, Plain, Rgb12
from pointmill.codec.layered import Bytes14, Core14, Rgb14, RgbNir14

# fixed values: item types of the published format, with size (None: any) and the versions that are known
BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, POINT10, GPSTIME11, RGB12, WAVE13, POINT14, RGB14, RGBNIR14, WAVE14, BYTE14 = range(15)
ITEMS = {
    BYTE: (Bytes, None, (2,)), SHORT: (Plain, 2, (0, 1, 2)), INT: (Plain, 4, (0, 1, 2)), LONG: (Plain, 8, (0, 1, 2)), FLOAT: (Plain, 4, (0, 1, 2)), DOUBLE: (Plain, 8, (0, 1, 2)),
    POINT10: (Core10, 20, (2,)), GPSTIME11: (Gps, 8, (2,)), RGB12: (Rgb12, 6, (1, 2)),
    POINT14: (Core14, 30, (3, 4)), RGB14: (Rgb14, 6, (3, 4)), RGBNIR14: (RgbNir14, 8, (3, 4)), BYTE14: (Bytes14, None, (3, 4)),
}
POINTWISE, LAYERED = 2, 3
VARIABLE = (1 << 32) - 1
USER, NUMBER, MARK = "laszip encoded", 22204, 0xAABB
_HEAD, _ITEM = struct.Struct("<HHBBHIIqqH"), struct.Struct("<HHH")
_BYTES = {POINT10: np.dtype("<i4,<i4,<i4,<u2,u1,u1,u1,u1,<u2"), POINT14: np.dtype("<i4,<i4,<i4,<u2,u1,u1,u1,u1,<i2,<u2,<u8"), GPSTIME11: np.dtype([("t", "<u8")])}
_COUNT = struct.Struct("<I")


@dataclass(frozen=True)
class Item:
    type: int
    size: int
    version: int


@dataclass(frozen=True)
class Descriptor:
    """compressor, points of a chunk (VARIABLE: the table has them), items in the order of the record's bytes."""

    compressor: int
    chunk_size: int
    items: tuple[Item, ...]

    def __post_init__(self) -> None:
        for i in self.items:
            if i.type not in ITEMS:
                raise ValueError(f"items of type {i.type} can't be decoded")
            _, size, versions = ITEMS[i.type]
            if (size or i.size) != i.size or not i.size:
                raise ValueError(f"an item of type {i.type} has {i.size} bytes")
            if i.version not in versions:
                raise ValueError(f"an item of type {i.type} in version {i.version}")
        if self.compressor not in (POINTWISE, LAYERED):
            raise ValueError(f"compressor {self.compressor}")

    @property
    def length(self) -> int:
        return sum(i.size for i in self.items)

    def payload(self) -> bytes:
        return _HEAD.pack(self.compressor, 0, 1, 4, 0, 0, self.chunk_size, -1, -1, len(self.items)) + b"".join(_ITEM.pack(i.type, i.size, i.version) for i in self.items)


def described(payload: bytes) -> Descriptor:
    """The descriptor of a record's payload; raises where the file can't be read."""
    if len(payload) < _HEAD.size:
        raise ValueError("the record of items is too short")
    compressor, coder, _, _, _, options, chunk_size, _, _, n = _HEAD.unpack_from(payload)
    if coder or options & 1:
        raise ValueError("another coder" if coder else "points in compatibility mode can't be read")
    if len(payload) < _HEAD.size + n * _ITEM.size:
        raise ValueError("the record of items is too short")
    return Descriptor(compressor, chunk_size, tuple(Item(*_ITEM.unpack_from(payload, _HEAD.size + k * _ITEM.size)) for k in range(n)))


def items_of(fmt: int, extra: int = 0, chunk_size: int = VARIABLE) -> Descriptor:
    """The items of a record format, with so many extra bytes. Formats with wave packets have none."""
    parts = {0: (), 1: (GPSTIME11,), 2: (RGB12,), 3: (GPSTIME11, RGB12), 6: (), 7: (RGB14,), 8: (RGBNIR14,)}
    if fmt not in parts:
        raise ValueError(f"points of format {fmt} can't be compressed")
    types, version = [POINT14 if fmt >= 6 else POINT10, *parts[fmt]], 3 if fmt >= 6 else 2
    items = [Item(t, ITEMS[t][1], version) for t in types] + ([Item(BYTE14 if fmt >= 6 else BYTE, extra, version)] if extra else [])
    return Descriptor(LAYERED if fmt >= 6 else POINTWISE, chunk_size, tuple(items))


def _columns(raw: np.ndarray, items: tuple[Item, ...]) -> list[list[tuple]]:
    out, at = [], 0
    for i in items:
        part = np.ascontiguousarray(raw[:, at : at + i.size])
        at += i.size
        out.append(part.view(_BYTES[i.type]).ravel().tolist() if i.type in _BYTES else list(map(tuple, part.tolist())))
    return out


def _raw(columns: list[list[tuple]], items: tuple[Item, ...]) -> np.ndarray:
    parts = []
    for i, rows in zip(items, columns, strict=True):
        part = np.array(rows, _BYTES[i.type]).view(np.uint8) if i.type in _BYTES else np.array(rows, np.uint8)
        parts.append(part.reshape(len(rows), i.size))
    return np.concatenate(parts, axis=1)


def _coders(d: Descriptor, seeds: list[tuple]) -> list:
    out, context = [], None
    for i, seed in zip(d.items, seeds, strict=True):
        kind = ITEMS[i.type][0]
        if hasattr(kind, "step") and kind in (Rgb14, RgbNir14, Bytes14):
            if context is None:
                raise ValueError("the core item must come first")
            out.append(kind(seed, i.version, context))
        else:
            out.append(kind(seed, i.version))
            context = out[-1].context if kind is Core14 else context
    return out


def encode(raw: np.ndarray, d: Descriptor) -> bytes:
    """One chunk of records (n x length bytes)."""
    if not len(raw):
        raise ValueError("a chunk has one point at least")
    columns = _columns(raw, d.items)
    coders = _coders(d, [c[0] for c in columns])
    head = raw[0].tobytes()
    if d.compressor == POINTWISE:
        io = Encoder()
        for row in zip(*(c[1:] for c in columns), strict=True):
            for coder, want in zip(coders, row, strict=True):
                coder.step(io, want)
        return head + io.finish()
    ios = [[Encoder() for _ in range(c.layers)] for c in coders]
    core = next(c for c in coders if isinstance(c, Core14))
    for row in zip(*(c[1:] for c in columns), strict=True):
        for coder, own, want in zip(coders, ios, row, strict=True):
            coder.step(own, want, core.context)
    layers = [io.finish() for own in ios for io in own]
    return head + _COUNT.pack(len(raw)) + b"".join(_COUNT.pack(len(x)) for x in layers) + b"".join(layers)


def decode(data: bytes, n: int, d: Descriptor) -> np.ndarray:
    """The n records of a chunk."""
    seed = np.frombuffer(data, np.uint8, d.length).reshape(1, -1)
    columns = _columns(seed, d.items)
    coders, at = _coders(d, [c[0] for c in columns]), d.length
    if d.compressor == POINTWISE:
        io = Decoder(memoryview(data)[at:])
        for _ in range(n - 1):
            for coder, rows in zip(coders, columns, strict=True):
                rows.append(coder.step(io, None))
        return _raw(columns, d.items)
    if _COUNT.unpack_from(data, at)[0] != n:
        raise ValueError("a chunk has another number of points than the table says")
    count = sum(c.layers for c in coders)
    sizes = struct.unpack_from(f"<{count}I", data, at + 4)
    at += 4 + 4 * count
    if at + sum(sizes) != len(data):
        raise ValueError("the layers don't fill the chunk")
    streams = []
    for size in sizes:
        # an empty layer was never written to
        streams.append(Decoder(memoryview(data)[at : at + size]) if size >= 4 else None)
        at += size
    ios = []
    for c in coders:
        ios.append(streams[: c.layers])
        streams = streams[c.layers :]
    core = next(c for c in coders if isinstance(c, Core14))
    for _ in range(n - 1):
        for coder, own, rows in zip(coders, ios, columns, strict=True):
            rows.append(coder.step(own, None, core.context))
    return _raw(columns, d.items)


def chunk_size_of(counts: list[int]) -> int:
    """The size of all chunks if all but the last are alike and the last is no larger, else VARIABLE."""
    if not counts:
        return 0
    return counts[0] if all(c == counts[0] for c in counts[:-1]) and counts[-1] <= counts[0] else VARIABLE


def table_bytes(counts: list[int], sizes: list[int]) -> bytes:
    """The table: differences of byte sizes and, for chunks of variable size, of point counts."""
    io, points, bytes_ = Encoder(), Integers(32), Integers(32)
    variable = chunk_size_of(counts) == VARIABLE
    for k in range(len(sizes)):
        if variable:
            points.code(io, counts[k] - (counts[k - 1] if k else 0))
        bytes_.code(io, sizes[k] - (sizes[k - 1] if k else 0))
    return struct.pack("<II", 0, len(sizes)) + io.finish()


def read_table(data: bytes, chunk_size: int, total: int) -> list[tuple[int, int, int, int]]:
    """(points, first point, bytes, offset of the bytes after the start of the points) of each chunk."""
    version, n = struct.unpack_from("<II", data)
    if version:
        raise ValueError(f"a table of chunks in version {version}")
    if chunk_size != VARIABLE and n != (-(-total // chunk_size) if chunk_size else 0):
        raise ValueError("the table has another number of chunks than the points need")
    io, points, bytes_ = Decoder(data[8:]) if n else None, Integers(32), Integers(32)
    out, count, size, first, at = [], 0, 0, 0, 8
    for k in range(n):
        count = count + points.code(io) if chunk_size == VARIABLE else min(chunk_size, total - k * chunk_size)
        size += bytes_.code(io)
        if count < 0 or size < 0:
            raise ValueError("the table of chunks is damaged")
        out.append((count, first, size, at))
        first, at = first + count, at + size
    if first != total:
        raise ValueError("the chunks have another number of points than the header says")
    return out
