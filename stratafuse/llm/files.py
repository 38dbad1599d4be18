"""Binary files in the shared folder, through the file system that its URI names."""

from __future__ import annotations

import io

import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def task_name(prefix: str, number: int = 0) -> str:
    """A file name that no other attempt of any task uses: a retry leaves no half-written file in use."""
    c = TaskContext.get()
    return f"{prefix}-{c.partitionId() if c else 0:06d}-{number:04d}-{c.taskAttemptId() if c else 0}"


class FrameWriter:
    """Items gathered into independent Zstandard frames of about ``frame`` raw bytes."""

    def __init__(self, uri: str, frame: int, level: int = 1):
        self.fs, path = open_fs(uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.frame, self.at = self.fs.open_output_stream(path, compression=None), frame, 0
        self.pack, self.part, self.raw, self.frames, self.total = zstandard.ZstdCompressor(level=level), io.BytesIO(), 0, [], 0

    def add(self, item: bytes) -> tuple[int, int]:
        """(number of the frame, offset in it) of the item."""
        if self.raw >= self.frame:
            self.flush()
        at = self.raw
        self.part.write(item)
        self.raw += len(item)
        self.total += len(item)
        return len(self.frames), at

    def flush(self) -> None:
        if self.raw:
            data = self.pack.compress(self.part.getvalue())
            self.out.write(data)
            self.frames.append((self.at, len(data), self.raw))
            self.at += len(data)
            self.part, self.raw = io.BytesIO(), 0

    def close(self, footer: bytes = b"") -> None:
        self.flush()
        self.out.write(footer)
        self.out.close()


def read_range(uri: str, ranges: list[tuple[int, int]]):
    """Bytes of each (offset, length) of one file."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        for at, n in ranges:
            f.seek(at)
            yield f.read(n)
