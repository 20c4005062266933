"""Where paths lie, for Python code that reads and writes files."""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path and its name there; plain paths and file: are local."""
    if "://" in path and not path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(quote(path, safe=":/"))
    return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/") if path.startswith("file:") else path
