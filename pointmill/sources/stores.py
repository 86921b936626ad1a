"""Files by plain path or by URI: `file://`, and what the installed pyarrow opens besides (hdfs, s3, gs, abfs).

Only byte ranges that are asked for are read, so a partition reads its own range of a file in a store as it does of a local one.
"""

from __future__ import annotations

import os
import re
from typing import BinaryIO


def _store(path: str):  # noqa: ANN202
    """(file system, path in it) of a URI; None for a plain path."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def opened(path: str) -> BinaryIO:
    """A file to read, with seek and tell; FileNotFoundError (an OSError) if there is none."""
    at = _store(path)
    return open(path.removeprefix("file:"), "rb") if at is None else at[0].open_input_file(at[1])


def files_of(path: str) -> list[str]:
    """The file itself, or the .las and .laz files of a folder in the order of their names."""
    at = _store(path)
    if at is None:
        path = path.removeprefix("file:")
        if not os.path.isdir(path):
            return [path]
        names = os.listdir(path)
    else:
        from pyarrow import fs

        if at[0].get_file_info(at[1]).type != fs.FileType.Directory:
            return [path]
        names = [f.base_name for f in at[0].get_file_info(fs.FileSelector(at[1])) if f.is_file]
    return [f"{path.rstrip('/')}/{f}" for f in sorted(names) if f.lower().endswith((".las", ".laz"))]
