"""Binary files in folders that the driver and all executors share, by URI."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path; Hadoop's file:/x is read as file:///x, a bare path as a local one."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_whole(uri: str, chunks: Iterable[bytes]) -> int:
    """Writes under a name of its own, then renames: a lost or repeated task leaves one whole file. Returns its size."""
    where, path = resolve(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with where.open_output_stream(own, compression=None) as out:
        for c in chunks:
            out.write(c)
            size += len(c)
    where.move(own, path)
    return size


def blocks(uri: str, size: int = 4 << 20) -> Iterator[bytes]:
    """The bytes of a file, some at a time."""
    where, path = resolve(uri)
    with where.open_input_stream(path, compression=None) as f:
        while block := f.read(size):
            yield block


def remove(uri: str) -> None:
    """A folder and what is in it, if there is one."""
    where, path = resolve(uri)
    if where.get_file_info(path).type == fs.FileType.Directory:
        where.delete_dir(path)


def read_whole(uri: str) -> bytes:
    where, path = resolve(uri)
    with where.open_input_stream(path, compression=None) as f:
        return f.read()


class Source:
    """A file of which parts are read."""

    def __init__(self, uri: str):
        where, path = resolve(uri)
        self.file = where.open_input_file(path)
        self.size = self.file.size()

    def read_at(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)


class Held:
    """The same for bytes at hand."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read_at(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


def list_files(uri: str, suffix: str) -> list[tuple[str, int]]:
    """URIs and sizes of the files below a folder, in order of name; none if there is no such folder."""
    where, path = resolve(uri)
    found = where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    head = uri[: len(uri) - len(path)] if uri.endswith(path) else "file://"
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))
