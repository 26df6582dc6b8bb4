"""Listing and reading files from inside tasks, a folder or a few bytes at a time.

Paths without a scheme lie on a file system that every machine mounts; those with one
(s3, gs, hdfs, file) are opened by Arrow's file systems.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and its name there."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file://")


def listed(folder: str) -> Iterator[tuple[str, str, int, float]]:
    """(kind, path, size, seconds) of a folder's entries by name; links to folders are left out, all other names stay.

    kind: file or folder. An entry that can't be read is ('error', path, ...), and the others follow.
    """
    if is_local(folder):
        top = opened(folder)[1] if "://" in folder else folder.removeprefix("file:")
        with os.scandir(top) as found:
            entries = sorted(found, key=lambda e: e.name)
        for e in entries:
            path = f"{folder.rstrip('/')}/{e.name}"
            try:
                if e.is_dir():
                    if not e.is_symlink():
                        yield "folder", path, 0, 0.0
                elif e.is_file():
                    s = e.stat()
                    yield "file", path, s.st_size, s.st_mtime
                else:
                    yield "error", path, 0, 0.0
            except OSError:
                yield "error", path, 0, 0.0
        return
    system, inner = opened(folder)
    for info in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda i: i.base_name):
        path = f"{folder.rstrip('/')}/{info.base_name}"
        if info.type == fs.FileType.Directory:
            yield "folder", path, 0, 0.0
        elif info.type == fs.FileType.File:
            yield "file", path, info.size or 0, (info.mtime_ns or 0) / 1e9
        else:
            yield "error", path, 0, 0.0


class Ranged:
    """A file as a sequence of bytes that is read by pages where it is asked for; taken counts the bytes read."""

    def __init__(self, path: str, page: int = 1024):
        system, inner = opened(path)
        self.file, self.page, self.pages, self.taken = system.open_input_file(inner), page, {}, 0
        self.size = self.file.size()

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def __len__(self) -> int:
        return self.size

    def _read(self, start: int, stop: int) -> bytes:
        """Bytes past the pages already held; only a few pages stay."""
        out = []
        for k in range(start // self.page, -(-stop // self.page)):
            if k not in self.pages:
                if len(self.pages) >= 16:
                    self.pages.clear()
                self.pages[k] = self.file.read_at(min(self.page, self.size - k * self.page), k * self.page)
                self.taken += len(self.pages[k])
            out.append(self.pages[k])
        first = start // self.page * self.page
        return b"".join(out)[start - first : stop - first]

    def __getitem__(self, at):
        if isinstance(at, slice):
            start, stop, _ = at.indices(self.size)
            return self._read(start, stop) if stop > start else b""
        if not 0 <= at < self.size:
            raise IndexError(at)
        return self._read(at, at + 1)[0]
