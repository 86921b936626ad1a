"""Bytes of LAS files: records of formats 0 to 10, the header, and variable length records."""

from __future__ import annotations

import struct
from collections.abc import Callable
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import types as T

_XYZ = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2")]
_CORE10 = [*_XYZ, ("bits", "u1"), ("class_byte", "u1"), ("scan_angle_rank", "u1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_CORE14 = [*_XYZ, ("returns", "u1"), ("bits", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_GPS, _NIR = [("gps_time", "<f8")], [("nir", "<u2")]
_RGB = [(c, "<u2") for c in ("red", "green", "blue")]
_WAVE = [("descriptor_index", "u1"), ("byte_offset", "<u8"), ("packet_size", "<u4"), *((c, "<f4") for c in ("return_location", "x_t", "y_t", "z_t"))]
#: Parts of each record format after the core, in the published order.
_PARTS = {0: [], 1: _GPS, 2: _RGB, 3: _GPS + _RGB, 4: _GPS + _WAVE, 5: _GPS + _RGB + _WAVE, 6: [], 7: _RGB, 8: _RGB + _NIR, 9: _WAVE, 10: _RGB + _NIR + _WAVE}
#: Bit fields: byte of the record, then (name, first bit, width).
_BITS10 = {"bits": [("return_number", 0, 3), ("number_of_returns", 3, 3), ("scan_direction_flag", 6, 1), ("edge_of_flight_line", 7, 1)], "class_byte": [("classification", 0, 5), ("synthetic", 5, 1), ("key_point", 6, 1), ("withheld", 7, 1)]}
_BITS14 = {"returns": [("return_number", 0, 4), ("number_of_returns", 4, 4)], "bits": [("classification_flags", 0, 4), ("scanner_channel", 4, 2), ("scan_direction_flag", 6, 1), ("edge_of_flight_line", 7, 1)]}
_SPARK = {"<i4": T.IntegerType(), "<u2": T.IntegerType(), "u1": T.ShortType(), "<i2": T.ShortType(), "<f8": T.DoubleType(), "<f4": T.FloatType(), "<u4": T.LongType(), "<u8": T.LongType()}
# fixed values: records of the projection, by number
PROJECTION, MATH_WKT, COORDINATE_WKT, DIRECTORY, DOUBLES, TEXT = "LASF_Projection", 2111, 2112, 34735, 34736, 34737
SIGNATURE, HEADER_14, HEADER_OLD = b"LASF", 375, 227
_HEADER = struct.Struct("<4sHH16sBB32s32sHHHIIBHI5I12d")
_TAIL = struct.Struct("<QQIQ15Q")
_VLR, _EVLR = struct.Struct("<H16sHH32s"), struct.Struct("<H16sHQ32s")


def record(fmt: int, length: int | None = None) -> np.dtype:
    """The record's bytes; a length beyond the format's own adds extra_bytes."""
    if fmt not in _PARTS:
        raise ValueError(f"no record format {fmt}")
    fields = (_CORE10 if fmt < 6 else _CORE14) + _PARTS[fmt]
    own = np.dtype(fields).itemsize
    if length is not None and length < own:
        raise ValueError(f"records of {length} bytes are too short for format {fmt}")
    return np.dtype([*fields, ("extra_bytes", f"V{length - own}")]) if length and length > own else np.dtype(fields)


def _bits(fmt: int) -> dict[str, list[tuple[str, int, int]]]:
    return _BITS10 if fmt < 6 else _BITS14


def schema(fmt: int, length: int | None = None) -> T.StructType:
    """point_index, chunk-free columns of the format with bit fields apart, and extra_bytes where records have them."""
    out = T.StructType([T.StructField("point_index", T.LongType(), False)])
    for name, kind in ((n, d[0]) for n, d in record(fmt, length).fields.items()):
        for field, _, _ in _bits(fmt).get(name, [(name, 0, 0)]):
            wide = T.ShortType() if name in _bits(fmt) else T.BinaryType() if kind.kind == "V" else _SPARK[kind.str.replace("|", "")]
            out.add(field, wide, False)
    return out


def decode(raw: bytes, fmt: int, length: int, wanted: set[str] | None = None) -> dict[str, np.ndarray | list[bytes]]:
    """Columns of whole records, all or the wanted ones."""
    rows, out = np.frombuffer(raw, record(fmt, length)), {}
    asked = lambda name: wanted is None or name in wanted
    for name in rows.dtype.names:
        if name in _bits(fmt):
            out |= {field: (rows[name] >> at & ((1 << width) - 1)).astype(np.int16) for field, at, width in _bits(fmt)[name] if asked(field)}
        elif asked(name):
            out[name] = [x.tobytes() for x in rows[name]] if name == "extra_bytes" else rows[name]
    return out


def encode(columns: dict[str, list], fmt: int, length: int) -> np.ndarray:
    """Records of the columns; a column that is not there is zero. Values beyond a field's range raise."""
    n = len(next(iter(columns.values())))
    rows = np.zeros(n, record(fmt, length))
    for name in rows.dtype.names:
        if name in _bits(fmt):
            for field, at, width in _bits(fmt)[name]:
                v = np.array(columns.get(field, [0] * n), np.int64)
                if ((v < 0) | (v >= 1 << width)).any():
                    raise ValueError(f"{field} does not fit {width} bits")
                rows[name] |= (v << at).astype(np.uint8)
        elif name in columns:
            if name == "extra_bytes":
                rows[name] = np.array([x or b"" for x in columns[name]], rows.dtype[name])
            else:
                kind = rows.dtype[name]
                v = np.array(columns[name], np.float64 if kind.kind == "f" else np.int64)
                if kind.kind != "f" and len(v) and (v.min() < np.iinfo(kind).min or int(v.max()) > np.iinfo(kind).max):
                    raise ValueError(f"{name} does not fit its field")
                rows[name] = v
    return rows


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("latin-1")


def read_header(f) -> dict:  # noqa: ANN001
    """The header's fields; raises where the file is none of this kind."""
    f.seek(0)
    raw = f.read(HEADER_14)
    if len(raw) < HEADER_OLD or raw[:4] != SIGNATURE:
        raise ValueError("not a LAS file")
    v = _HEADER.unpack_from(raw)
    h = dict(zip(("source_id", "global_encoding"), v[1:3], strict=True)) | {"project_id": v[3].hex(), "version": f"{v[4]}.{v[5]}", "system_id": _text(v[6]), "software": _text(v[7]), "day": v[8], "year": v[9], "header_size": v[10], "point_offset": v[11], "n_vlrs": v[12]}
    h |= {"format": v[13] & 0x7F, "compressed": bool(v[13] & 0x80), "record_length": v[14], "n_points": v[15], "by_return": list(v[16:21])}
    h |= dict(zip(("scale_x", "scale_y", "scale_z", "offset_x", "offset_y", "offset_z", "max_x", "min_x", "max_y", "min_y", "max_z", "min_z"), v[21:33], strict=True))
    if h["header_size"] != (HEADER_14 if h["version"] == "1.4" else HEADER_OLD):
        raise ValueError(f"a header of {h['header_size']} bytes in version {h['version']}")
    h |= {"wave_offset": 0, "evlr_offset": 0, "n_evlrs": 0}
    if h["version"] == "1.4":
        tail = _TAIL.unpack_from(raw, HEADER_OLD)
        h |= {"wave_offset": tail[0], "evlr_offset": tail[1], "n_evlrs": tail[2]}
        if not h["n_points"]:
            h |= {"n_points": tail[3], "by_return": list(tail[4:])}
    return h


def write_header(h: dict) -> bytes:
    """A header of version 1.4; 32-bit counts are zero for formats from 6 on and for counts that don't fit.

    Day and year are today's where h has none.
    """
    today = datetime.now(UTC).timetuple()
    legacy = h["format"] < 6 and h["n_points"] < 2**32 - 1
    by = [*h["by_return"], *[0] * 15][:15]
    ends = [h[f"{m}_{a}"] for a in "xyz" for m in ("max", "min")]
    head = _HEADER.pack(
        SIGNATURE, h.get("source_id", 0), h.get("global_encoding", 0), bytes.fromhex(h.get("project_id", "")), 1, 4, h.get("system_id", "").encode("latin-1"), h.get("software", "pointmill").encode("latin-1"), h.get("day") or today.tm_yday, h.get("year") or today.tm_year, HEADER_14, h["point_offset"], h["n_vlrs"],
        h["format"] | (0x80 if h.get("compressed") else 0), h["record_length"], h["n_points"] if legacy else 0, *(by[:5] if legacy else [0] * 5), *h["scale"], *h["offset"], *ends,
    )
    return head + _TAIL.pack(0, h.get("evlr_offset", 0), h.get("n_evlrs", 0), h["n_points"], *by)


def read_vlrs(f, h: dict, wanted: Callable[[dict], bool] = lambda r: True) -> list[dict]:  # noqa: ANN001
    """All variable length records, extended ones last. Payloads of those not wanted are not read and are null."""
    out = []
    for kind, head, at, n in (("vlr", _VLR, h["header_size"], h["n_vlrs"]), ("evlr", _EVLR, h["evlr_offset"], h["n_evlrs"])):
        f.seek(at)
        for k in range(n):
            raw = f.read(head.size)
            if len(raw) < head.size:
                raise ValueError("the file ends within a record header")
            reserved, user, number, length, text = head.unpack(raw)
            row = {"kind": kind, "ordinal": k, "reserved": reserved, "user_id": _text(user), "record_id": number, "description": _text(text), "length": length, "payload_offset": f.tell(), "payload": None}
            if wanted(row):
                row["payload"] = f.read(length)
                if len(row["payload"]) < length:
                    raise ValueError("the file ends within a record")
            else:
                f.seek(length, 1)
            out.append(row)
    return out


def geo_keys(directory: bytes, doubles: bytes = b"", text: bytes = b"") -> list[dict]:
    """The keys of a directory record: each has a number of its own, or some of the doubles, or a part of the text."""
    head, out = struct.unpack_from("<4H", directory), {}
    if len(directory) != 8 + 8 * head[3] or len(doubles) % 8:
        raise ValueError("the directory of geo-keys has another length than its number of keys")
    for k in range(head[3]):
        key, place, count, at = struct.unpack_from("<4H", directory, 8 + 8 * k)
        row = {"key": key, "short_value": None, "double_values": None, "ascii_value": None}
        if place == 0:
            row["short_value"] = at
        elif place == DOUBLES and 8 * (at + count) <= len(doubles):
            row["double_values"] = list(struct.unpack_from(f"<{count}d", doubles, 8 * at))
        elif place == TEXT and at + count <= len(text):
            row["ascii_value"] = text[at : at + count].decode("latin-1")
        else:
            raise ValueError(f"geo-key {key} points to values that aren't there")
        out[key] = row  # a later one replaces an earlier one
    return [out[k] for k in sorted(out)]


def vlr(user: str, number: int, payload: bytes, text: str = "", extended: bool = False, reserved: int = 0) -> bytes:
    return (_EVLR if extended else _VLR).pack(reserved, user.encode("latin-1"), number, len(payload), text.encode("latin-1")) + payload
