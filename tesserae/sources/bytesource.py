"""Byte ranges of files, buffers and remote stores.

A path with a scheme (hdfs://, s3://, gs:// and whatever else pyarrow.fs knows) is read through
that store's file system; other paths are local.
"""

from __future__ import annotations

import fnmatch
import glob
import os
import posixpath

from pyarrow import fs

from tesserae.errors import SlideFormatError


class MemorySource:
    """A buffer; ranges beyond it are cut or empty."""

    def __init__(self, data: bytes):
        self.data = data
        self.bytes_read = 0

    def read(self, offset: int, length: int) -> bytes:
        got = self.data[max(0, offset) : max(0, offset) + max(0, length)] if offset >= 0 else b""
        self.bytes_read += len(got)
        return got

    def close(self) -> None:
        pass


class FileSource:
    """A local file; a short read at its end is allowed."""

    def __init__(self, path: str):
        self._file = open(path.removeprefix("file://"), "rb")
        self.bytes_read = 0

    def read(self, offset: int, length: int) -> bytes:
        self._file.seek(offset)
        got = self._file.read(max(0, length))
        self.bytes_read += len(got)
        return got

    def close(self) -> None:
        self._file.close()


class StoreSource:
    """A file of a remote store, read by ranges; a short read at its end is allowed."""

    def __init__(self, path: str):
        store, name = file_system(path)
        self._file = store.open_input_file(name)
        self._size = self._file.size()
        self.bytes_read = 0

    def read(self, offset: int, length: int) -> bytes:
        got = self._file.read_at(min(length, self._size - offset), offset) if 0 <= offset < self._size and length > 0 else b""
        self.bytes_read += len(got)
        return got

    def close(self) -> None:
        self._file.close()


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI, and the name in it."""
    return fs.FileSystem.from_uri(path)


def source_of(path: str):
    return StoreSource(path) if is_remote(path) else FileSource(path)


def exactly(source, offset: int, length: int) -> bytes:
    got = source.read(offset, length)
    if len(got) != length:
        raise SlideFormatError(f"{length} bytes at {offset} lie beyond the file")
    return got


def expand(paths: str) -> list[str]:
    """Files of a comma-separated list of files, folders and patterns."""
    out: list[str] = []
    for p in filter(None, (x.strip().removeprefix("file://").removeprefix("file:") for x in paths.split(","))):
        if is_remote(p):
            out += _listed(p)
        elif os.path.isdir(p):
            out += sorted(f for f in (os.path.join(p, n) for n in os.listdir(p)) if os.path.isfile(f))
        else:
            out += sorted(glob.glob(p)) or [p]
    return out


def _listed(uri: str) -> list[str]:
    """Files of a remote folder, or of a pattern in its last part."""
    folder, last = uri.rsplit("/", 1)
    pattern = last if glob.has_magic(last) else None
    store, name = file_system(folder if pattern else uri)
    if not pattern and store.get_file_info(name).type != fs.FileType.Directory:
        return [uri]
    found = sorted(posixpath.basename(f.path) for f in store.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File)
    root = folder if pattern else uri.rstrip("/")
    return [f"{root}/{f}" for f in found if not pattern or fnmatch.fnmatch(f, pattern)]
