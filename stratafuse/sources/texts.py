"""Single small files (JSON, JSON lines, SVG, HTML, NPZ) on any file system that a URI names."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
from pyarrow import fs as pafs


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def is_file(path: str) -> bool:
    fs, at = open_fs(path)
    return fs.get_file_info(at).type == pafs.FileType.File


def write_bytes(path: str, data: bytes) -> None:
    fs, at = open_fs(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as f:
        f.write(data)


def read_bytes(path: str) -> bytes:
    fs, at = open_fs(path)
    try:
        with fs.open_input_stream(at, compression=None) as f:
            return f.read()
    except FileNotFoundError as e:
        raise ValueError(f"{path}: missing file") from e


def write_text(path: str, text: str) -> None:
    write_bytes(path, text.encode())


def write_json(path: str, record: dict) -> None:
    """One deterministic JSON object (sorted keys, a newline at the end)."""
    write_text(path, json.dumps(record, indent=2, sort_keys=True) + "\n")


def read_json(path: str) -> dict:
    try:
        out = json.loads(read_bytes(path))
    except ValueError as e:
        raise ValueError(f"{path}: {e}" if str(path) not in str(e) else str(e)) from e
    if not isinstance(out, dict):
        raise ValueError(f"{path}: not a JSON object")
    return out


def write_json_lines(path: str, lines: Iterable[str]) -> None:
    """One file of given JSON texts, a line each."""
    fs, at = open_fs(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as f:
        for line in lines:
            f.write(line.encode() + b"\n")


def append_json_line(path: str, record: dict) -> None:
    """Add one line to a file of JSON lines; on stores without appending it is written anew."""
    line = (json.dumps(record, sort_keys=True) + "\n").encode()
    fs, at = open_fs(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    try:
        with fs.open_append_stream(at, compression=None) as f:
            f.write(line)
    except (NotImplementedError, OSError):
        before = read_bytes(path) if fs.get_file_info(at).type != pafs.FileType.NotFound else b""
        write_bytes(path, before + line)


def write_npz(path: str, **arrays: np.ndarray) -> None:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    write_bytes(path, buffer.getvalue())


def read_npz(data: bytes, path: str) -> dict[str, np.ndarray]:
    """All arrays of an NPZ file (no pickled objects)."""
    try:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            return {str(k): np.asarray(z[k]) for k in z.files}
    except Exception as e:  # broken archives raise errors of several modules
        raise ValueError(f"{path}: not a readable NPZ file: {e}") from e


def json_lines(path: str) -> Iterator[tuple[int, str]]:
    """(line number, text) of the lines that aren't blank."""
    for n, line in enumerate(read_bytes(path).decode().split("\n"), 1):
        if line.strip():
            yield n, line
