"""Files that tasks open themselves, by byte offsets, on any file system that pyarrow knows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (of this machine's where it names none), and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str, ending: str | tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder that end so, in order of their names; names that begin with _ or . are not data."""
    system, inner = located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    base = path.rstrip("/")
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted((f"{base}/{f.base_name}", f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(ending) and f.base_name[0] not in "._")


class Bytes:
    """A file read by offsets through one block that is kept, so that neighbouring reads cost one call."""

    def __init__(self, path: str, block: int = 1 << 20):
        system, inner = located(path)
        self.size = system.get_file_info(inner).size
        self.file, self.block = system.open_input_file(inner), block
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from an offset; fewer at the file's end."""
        n = max(0, min(n, self.size - at))
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, min(self.block, self.size - at)))
        return self.held[at - self.at : at - self.at + n]

    def find(self, patterns: tuple[bytes, ...], at: int) -> int:
        """The first offset from `at` on where one of the patterns begins; the file's size where none does."""
        longest = max(map(len, patterns))
        while at < self.size:
            part = self.read(at, self.block)
            found = [i for i in (part.find(p) for p in patterns) if i >= 0]
            if found:
                return at + min(found)
            if at + len(part) >= self.size:
                break
            at += len(part) - longest + 1
        return self.size

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def batches(rows: Iterator[tuple], schema: pa.Schema, many: int, weight=None, heavy: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of up to `many`, or of `heavy` by the weight of a row."""
    held, load = [], 0
    for row in rows:
        held.append(row)
        load += weight(row) if weight else 0
        if len(held) >= many or load >= heavy:
            yield _batch(held, schema)
            held, load = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
