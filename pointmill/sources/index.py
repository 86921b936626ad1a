"""The spatial index as bytes: the quadtree's header and, for each cell, its runs of points."""

from __future__ import annotations

import struct
from dataclasses import dataclass

USER, NUMBER = "LAStools", 30
#: Bounds on what a file may claim.
MOST_LEVELS, MOST_CELLS, MOST_RUNS = 16, 1_000_000, 1_000_000
# fixed values: signatures of the published format
_HEAD = struct.Struct("<4sI4sI4sIIII4f4sII")
_CELL = struct.Struct("<iII")


@dataclass(frozen=True)
class Index:
    """Levels, bounds (32-bit floats) and cells: number to its runs (first, last), in order."""

    levels: int
    min_x: float
    max_x: float
    min_y: float
    max_y: float
    cells: dict[int, list[tuple[int, int]]]

    def payload(self) -> bytes:
        """Cell numbers beyond 31 bits, which level 16 has, are stored wrapped."""
        out = [_HEAD.pack(b"LASX", 0, b"LASS", 0, b"LASQ", 0, self.levels, 0, 0, self.min_x, self.max_x, self.min_y, self.max_y, b"LASV", 0, len(self.cells))]
        for cell, runs in sorted(self.cells.items()):
            out.append(_CELL.pack((cell + (1 << 31)) % (1 << 32) - (1 << 31), len(runs), sum(b - a + 1 for a, b in runs)))
            out += [struct.pack("<II", a, b) for a, b in runs]
        return b"".join(out)


def parsed(data: bytes) -> Index:
    """The index in a payload or sidecar; raises ValueError for anything that isn't a sound one."""
    try:
        lasx, v1, lass, kind, lasq, v2, levels, _, _, min_x, max_x, min_y, max_y, lasv, v3, n = _HEAD.unpack_from(data)
        if (lasx, lass, lasq, lasv) != (b"LASX", b"LASS", b"LASQ", b"LASV") or v1 or v2 or v3 or kind:
            raise ValueError("not a spatial index")
        if levels > MOST_LEVELS:
            raise ValueError(f"{levels} levels")
        if min_x > max_x or min_y > max_y:
            raise ValueError("bounds the wrong way round")
        if n > MOST_CELLS:
            raise ValueError(f"{n} cells")
        at, cells = _HEAD.size, {}
        for _ in range(n):
            cell, k, points = _CELL.unpack_from(data, at)
            at += _CELL.size
            if k > MOST_RUNS:
                raise ValueError(f"{k} runs in cell {cell}")
            flat = struct.unpack_from(f"<{2 * k}I", data, at)
            at += 8 * k
            runs = list(zip(flat[::2], flat[1::2], strict=True))
            if any(a > b for a, b in runs):
                raise ValueError(f"a run that ends before it starts in cell {cell}")
            if sum(b - a + 1 for a, b in runs) != points:
                raise ValueError(f"cell {cell} has another number of points than its runs")
            if cell in cells:
                raise ValueError(f"cell {cell} twice")
            cells[cell] = runs
    except struct.error as e:
        raise ValueError("the index ends too early") from e
    return Index(levels, min_x, max_x, min_y, max_y, cells)
