"""Records of the user's own making: how they take over the parts of a file's records, and how they are stored.

A file's record consists of parts (PARTS). For each part that it has, in their order, a user record takes, if it has one,
the hook for that part; else, if it names the part, the part's columns under other names; else, if the part is one of its
bases, the part's columns. Fields that nothing sets have their default. A later part replaces what an earlier one has set.

Fields besides the bases' are stored as extra bytes, with the published record of their names and types, by which they are
read again.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of each part of a record.
PARTS = {
    "core10": ["x", "y", "z", "intensity", "return_number", "number_of_returns", "scan_direction_flag", "edge_of_flight_line", "classification", "synthetic", "key_point", "withheld", "scan_angle_rank", "user_data", "point_source_id"],
    "core14": ["x", "y", "z", "intensity", "return_number", "number_of_returns", "classification_flags", "scanner_channel", "scan_direction_flag", "edge_of_flight_line", "classification", "user_data", "scan_angle", "point_source_id", "gps_time"],
    "gps": ["gps_time"],
    "rgb": ["red", "green", "blue"],
    "nir": ["nir"],
}
#: Numbers of the types of extra bytes from 1 on, by the published layout, and the Spark types that hold them.
TYPES = [("u1", "short"), ("i1", "byte"), ("u2", "int"), ("i2", "short"), ("u4", "long"), ("i4", "int"), ("u8", "decimal(20,0)"), ("i8", "long"), ("f4", "float"), ("f8", "double")]
Hook = Callable[[DataFrame], dict[str, Column]]


@dataclass(frozen=True)
class UserRecord:
    """fields: name to one of the types of TYPES and default; bases: parts taken as they are; assigned: part to (own name to
    the part's column); hooks: part to a function of the table that gives columns by own name."""

    name: str
    fields: dict[str, tuple[str, float]] = field(default_factory=dict)
    bases: tuple[str, ...] = ()
    assigned: dict[str, dict[str, str]] = field(default_factory=dict)
    hooks: dict[str, Hook] = field(default_factory=dict)

    def __post_init__(self) -> None:
        unknown = {*self.bases, *self.assigned, *self.hooks} - set(PARTS)
        if unknown:
            raise ValueError(f"no parts of records: {sorted(unknown)}")
        if any(kind not in dict(TYPES) for kind, _ in self.fields.values()):
            raise ValueError("a field's type is none of extra bytes")


def mapped(points: DataFrame, record: UserRecord) -> DataFrame:
    """The points as user records: point_index if there, the columns of the bases, the fields. Nulls stay null."""
    have = set(points.columns)
    held = [p for p, columns in PARTS.items() if have.issuperset(columns)]
    if not any(p in held for p in (*record.hooks, *record.assigned, *record.bases)):
        raise ValueError(f"{record.name} takes no part of these records")
    out: dict[str, Column] = {c: F.lit(0) for p in record.bases for c in PARTS[p]}
    out |= {n: F.lit(default).cast(dict(TYPES)[kind]) for n, (kind, default) in record.fields.items()}
    for p in held:
        if p in record.hooks:
            new = record.hooks[p](points)
        elif p in record.assigned:
            new = {own: points[c] for own, c in record.assigned[p].items()}
        else:
            new = {c: points[c] for c in PARTS[p]} if p in record.bases else {}
        if not set(new) <= set(out):
            raise ValueError(f"{record.name} has no {sorted(set(new) - set(out))}")
        out |= {n: c.cast(dict(TYPES)[record.fields[n][0]]) if n in record.fields else c for n, c in new.items()}
    index = ["point_index"] if "point_index" in have else []
    return points.select(*index, *(c.alias(n) for n, c in out.items()))


#: Fields of records, the fields of a point of the common C interface that they come from, and their bits there.
_PLACE = {"x": ("X", 32), "y": ("Y", 32), "z": ("Z", 32), "intensity": ("intensity", 16), "user_data": ("user_data", 8), "point_source_id": ("point_source_ID", 16), "scan_direction_flag": ("scan_direction_flag", 1), "edge_of_flight_line": ("edge_of_flight_line", 1)}
FOREIGN = {
    "core10": _PLACE | {
        "return_number": ("return_number", 3), "number_of_returns": ("number_of_returns", 3), "classification": ("classification", 5), "synthetic": ("synthetic_flag", 1),
        "key_point": ("keypoint_flag", 1), "withheld": ("withheld_flag", 1), "scan_angle_rank": ("scan_angle_rank", 8),
    },
    "core14": _PLACE | {
        "return_number": ("extended_return_number", 4), "number_of_returns": ("extended_number_of_returns", 4), "classification_flags": ("extended_classification_flags", 4), "scanner_channel": ("extended_scanner_channel", 2),
        "classification": ("extended_classification", 8), "scan_angle": ("extended_scan_angle", 16), "gps_time": ("gps_time", 64),
    },
    "gps": {"gps_time": ("gps_time", 64)},
    "rgb": {"red": ("rgb", 0), "green": ("rgb", 1), "blue": ("rgb", 2)},
}
FORMATS = {0: ["core10"], 1: ["core10", "gps"], 2: ["core10", "rgb"], 3: ["core10", "gps", "rgb"], 6: ["core14"], 7: ["core14", "rgb"]}
_SIGNED = ("x", "y", "z", "scan_angle", "scan_angle_rank")


def from_foreign(points: DataFrame, fmt: int) -> DataFrame:
    """Points as other programs' interface holds them, as records of a format: wider fields lose what has no place in the record.

    Columns are those of FOREIGN, rgb an array; point_index is kept if there. Formats 0, 1, 2, 3, 6 and 7; others raise ValueError.
    Signed fields keep their low bits with the sign. A null stays null.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt}")
    out = ["point_index"] if "point_index" in points.columns else []
    for part in FORMATS[fmt]:
        for name, (own, bits) in FOREIGN[part].items():
            if part == "rgb":
                value = F.col(own)[bits].cast("long").bitwiseAND(0xFFFF).cast("int")
            elif bits == 64:
                value = F.col(own).cast("double")
            else:
                low, half = F.col(own).cast("long"), 1 << (bits - 1)
                value = (F.pmod(low + half, F.lit(1 << bits)) - half if name in _SIGNED else F.pmod(low, F.lit(1 << bits))).cast("int")
            out.append(value.alias(name))
    return points.select(*out)


def size(record: UserRecord) -> int:
    """Bytes of the record's fields as extra bytes."""
    return sum(np.dtype(kind).itemsize for kind, _ in record.fields.values())


def description(record: UserRecord) -> bytes:
    """The payload of the published record on extra bytes: 192 bytes for each field."""
    numbers = {kind: n + 1 for n, (kind, _) in enumerate(TYPES)}
    return b"".join(struct.pack("<2xBB32s156x", numbers[kind], 0, name.encode()) for name, (kind, _) in record.fields.items())


def described(payload: bytes) -> dict[str, str]:
    """Names and types of fields from the payload; a type of undocumented bytes or a broken payload raises ValueError."""
    if len(payload) % 192:
        raise ValueError("the record on extra bytes is cut off")
    out = {}
    for at in range(0, len(payload), 192):
        number, _, name = struct.unpack_from("<2xBB32s", payload, at)
        if not 1 <= number <= len(TYPES):
            raise ValueError(f"type {number} of extra bytes")
        out[name.split(b"\0")[0].decode()] = TYPES[number - 1][0]
    return out


def stored(rows: DataFrame, record: UserRecord) -> DataFrame:
    """rows with the record's fields packed as extra_bytes; a null in a field raises."""
    kept = [f for f in rows.schema if f.name not in record.fields]
    kinds = np.dtype([(n, "<" + kind) for n, (kind, _) in record.fields.items()])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.zeros(batch.num_rows, kinds)
            for n in kinds.names:
                if batch.column(n).null_count:
                    raise ValueError(f"{n} has nulls; a record has none")
                raw[n] = batch.column(n).to_numpy(zero_copy_only=False)
            own = pa.array([raw[k : k + 1].tobytes() for k in range(len(raw))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), own], names=[*(f.name for f in kept), "extra_bytes"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(pack, f"{kind}, extra_bytes binary")


def unpacked(points: DataFrame, fields: dict[str, str]) -> DataFrame:
    """points with the fields that extra_bytes holds, instead of it."""
    kept = [f for f in points.schema if f.name != "extra_bytes"]
    kinds = np.dtype([(n, "<" + kind) for n, kind in fields.items()])
    arrow = {"short": pa.int16(), "byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0)}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("extra_bytes").to_pylist()), kinds)
            own = [pa.array(raw[n].astype(object) if kind == "u8" else np.ascontiguousarray(raw[n])).cast(arrow[dict(TYPES)[kind]]) for n, kind in fields.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *own], names=[*(f.name for f in kept), *fields])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + "".join(f", `{n}` {dict(TYPES)[kind]}" for n, kind in fields.items())
    return points.mapInArrow(unpack, kind)
