"""FASTQ files as a data source: a split of a file is a task, and no line is shuffled.

Plain files are split at any byte, block-gzipped ones (BGZF) at their blocks; a file of ordinary gzip
cannot be split and is one task.  A split owns the records whose header begins after its first byte
and up to the first byte of the next one, so neighbours agree without talking to each other.
Files are opened through ``pyarrow.fs``: local paths and the URIs that it knows (hdfs, s3, gs).
"""

from __future__ import annotations

import fnmatch
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES, CHUNK, ROWS = 64 << 20, 1 << 20, 4096
SCHEMA = "read_id string, seq string, qual string, file string"
_MAGIC = b"\x1f\x8b"
_BLOCK = b"\x1f\x8b\x08\x04"
_FOLLOWED = (b"@", b"+")


class Split(InputPartition):
    """Bytes ``start`` to ``end`` of a file, and how it is packed: plain, blocks or gzip."""

    def __init__(self, file: str, start: int, end: int, kind: str):
        self.file, self.start, self.end, self.kind = file, start, end, kind


def block_size(head: bytes) -> int | None:
    """The size of the BGZF block that begins with these bytes; null if none does."""
    if len(head) < 18 or not head.startswith(_BLOCK):
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def _files(path: str) -> Iterator[tuple[str, str, fs.FileSystem, int]]:
    """Name, path, file system and size of the files of a path: a file, a folder or a pattern in the last part."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    folder, _, pattern = place.rpartition("/")
    if any(c in pattern for c in "*?["):
        infos = [i for i in system.get_file_info(fs.FileSelector(folder or ".")) if fnmatch.fnmatch(i.base_name, pattern)]
    else:
        info = system.get_file_info(place)
        infos = system.get_file_info(fs.FileSelector(place)) if info.type == fs.FileType.Directory else [info]
    for info in sorted(infos, key=lambda i: i.path):
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
            yield prefix + info.path, info.path, system, info.size


def _open(name: str):
    system, place = fs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (fs.LocalFileSystem(), name)
    return system.open_input_file(place)


def _plain(file, start: int) -> Iterator[tuple[int, bytes]]:
    file.seek(start)
    while chunk := file.read(CHUNK):
        yield start, chunk
        start += len(chunk)


def _gzip(file) -> Iterator[tuple[int, bytes]]:
    """The members of a gzip file, one after another."""
    state, at = zlib.decompressobj(31), 0
    while chunk := file.read(CHUNK):
        while chunk:
            if text := state.decompress(chunk):
                yield at, text
                at += len(text)
            chunk = state.unused_data
            if chunk:
                state = zlib.decompressobj(31)
            elif state.eof:
                state = zlib.decompressobj(31)
                break


def _first_block(file, start: int, size: int) -> int:
    """Where the first block at or after ``start`` begins: its header is followed by another one or the file's end."""
    while start < size:
        file.seek(start)
        near = file.read((1 << 16) + 64)
        at = near.find(_BLOCK)
        while at >= 0:
            file.seek(start + at)
            length = block_size(file.read(64))
            if length:
                file.seek(start + at + length)
                after = file.read(64)
                if not after or block_size(after):
                    return start + at
            at = near.find(_BLOCK, at + 1)
        start += max(1, len(near) - len(_BLOCK) + 1)
    return size


def _blocks(file, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Offset and text of the blocks from ``start`` on; empty ones are left out."""
    at = _first_block(file, start, size) if start else 0
    while at < size:
        file.seek(at)
        head = file.read(64)
        length = block_size(head)
        if not length:
            raise ValueError(f"no block at byte {at}")
        file.seek(at)
        text = zlib.decompress(file.read(length), 31)
        if text:
            yield at, text
        at += length


def _lines(parts: Iterator[tuple[int, bytes]], end: int, by_block: bool) -> Iterator[tuple[bytes, bool]]:
    """Lines without their ends, and whether a record that begins there belongs to a split up to ``end``."""
    rest, owned, fresh, before = b"", False, True, None
    for offset, text in parts:
        at = 0
        while True:
            if fresh and at < len(text):
                # the first byte of what follows the split still counts: the next split leaves its first line out
                owned = (offset < end or at == 0 and before is not None and before < end) if by_block else offset + at <= end
                fresh = False
            cut = text.find(b"\n", at)
            if cut < 0:
                rest += text[at:]
                break
            yield (rest + text[at:cut]).rstrip(b"\r"), owned
            rest, at, fresh = b"", cut + 1, True
        before = offset
    if rest:
        yield rest.rstrip(b"\r"), owned


def records(split: Split) -> Iterator[tuple[str, str, str]]:
    """Header without "@", sequence and quality of a split's records."""
    with _open(split.file) as file:
        if split.kind == "gzip":
            lines = _lines(_gzip(file), 1 << 62, False)
        elif split.kind == "blocks":
            lines = _lines(_blocks(file, split.start, file.size()), split.end, True)
        else:
            lines = _lines(_plain(file, split.start), split.end, False)
        held: list[tuple[bytes, bool]] = []
        if split.start:
            next(lines, None)  # belongs to the split before
            for line in lines:  # a line that begins with "@" and has one with "+" two below it is a header: letters of a sequence never begin with "+"
                held.append(line)
                if len(held) >= 3 and (held[-3][0][:1], held[-1][0][:1]) == _FOLLOWED:
                    held = held[-3:]
                    break
            else:
                return

        def chained():
            yield from held
            yield from lines

        every = chained()
        for header, owned in every:
            if not header:
                continue
            if not owned:
                return
            seq, _, qual = (next(every, (b"", False))[0] for _ in range(3))
            yield header[1:].decode(), seq.decode(), qual.decode()


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[Split]:
        splits = []
        for path in self.paths:
            for name, place, system, size in _files(path):
                with system.open_input_file(place) as file:
                    head = file.read(64)
                kind = "blocks" if block_size(head) else "gzip" if head.startswith(_MAGIC) else "plain"
                step = size if kind == "gzip" else self.split_bytes
                splits += [Split(name, at, min(size, at + step), kind) for at in range(0, size, max(1, step))]
        return splits or [Split("", 0, 0, "none")]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.kind == "none":
            return
        held: list[tuple[str, str, str]] = []

        def batch():
            read_id, seq, qual = (pa.array(c, pa.string()) for c in zip(*held))
            return pa.RecordBatch.from_arrays([read_id, seq, qual, pa.array([partition.file] * len(held), pa.string())], names=["read_id", "seq", "qual", "file"])

        for record in records(partition):
            held.append(record)
            if len(held) >= ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)``; option ``splitBytes`` sets the size of a task."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)
