"""Files of any store that Arrow reaches, for data sources written in Python.

Spark's own readers go through Hadoop and are the way to stores that only it
knows; the sources here need byte offsets and commits of their own.
"""

from __future__ import annotations

import glob
import gzip
import io
from collections.abc import Iterator

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it; a path without scheme is local."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path, folder or local pattern names, sorted; hidden ones are left out."""
    store, inner = store_of(path)
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    names = sorted(glob.glob(inner)) if any(c in inner for c in "*?[") and isinstance(store, fs.LocalFileSystem) else [inner]
    out = []
    for name in names:
        info = store.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(name, recursive=True))
        out += [(prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return sorted(out)


def opened(path: str) -> io.BufferedIOBase:
    """A readable file; one whose name ends in ``.gz`` is inflated."""
    store, inner = store_of(path)
    raw = store.open_input_file(inner)
    return gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(_Raw(raw), 1 << 20)


class _Raw(io.RawIOBase):
    """An Arrow file as Python's own kind, so that lines can be read from it."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def records(file: io.BufferedIOBase, begins: bytes, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records of which the first line lies in [start, end).

    A record runs from a line that starts with ``begins`` to the next such
    line, so whoever owns its first byte reads past ``end`` for its rest.
    What precedes the first record of a file belongs to none.
    """
    at = start
    if start:
        file.seek(start - 1)
        at = start - 1 + len(file.readline())  # the line that runs over the border is someone else's
    held, first = [], None
    while line := file.readline():
        if line.startswith(begins):
            if first is not None:
                yield first, b"".join(held)
                held, first = [], None
            if end is not None and at >= end:
                return
            first = at
        if first is not None:
            held.append(line)
        elif end is not None and at >= end:
            return
        at += len(line)
    if first is not None:
        yield first, b"".join(held)
