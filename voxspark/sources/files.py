"""Random access to files on any file system the executors can reach, and splits by size."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import InputPartition

SPLIT_BYTES = 32 * 1024 * 1024
#: Files smaller than this are read several by one task, which costs more to start than to read one of them.
PACK_BYTES = 4 * 1024 * 1024


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a plain path or URI as Spark writes them: nothing in them is percent-encoded."""
    parts = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]*):(//[^/]*)?(/.*|)$", path, re.DOTALL)
    if parts is None or parts[1].lower() == "file":
        return pafs.LocalFileSystem(), path if parts is None else parts[3]
    filesystem, base = pafs.FileSystem.from_uri(f"{parts[1]}:{parts[2] or '//'}/")
    return filesystem, base.rstrip("/") + parts[3]


def open_file(path: str):
    filesystem, inner = resolve(path)
    return filesystem.open_input_file(inner)


def read_range(handle, start: int, length: int) -> bytes:
    handle.seek(start)
    return handle.read(length)


@dataclass(frozen=True)
class FileInfo:
    path: str
    name: str
    size: int


def list_files(root: str, suffixes: tuple[str, ...]) -> list[FileInfo]:
    """Files below a folder (or one file) with a suffix, sorted; names are relative to the folder, without suffix."""
    filesystem, inner = resolve(root)
    info = filesystem.get_file_info(inner)
    if info.type == pafs.FileType.File:
        entries, base = [info], inner.rsplit("/", 1)[0]
    else:
        entries, base = filesystem.get_file_info(pafs.FileSelector(inner, recursive=True)), inner.rstrip("/")
    prefix = root[: -len(inner)] if root.endswith(inner) and root != inner else ""
    found = [e for e in entries if e.type == pafs.FileType.File and e.path.lower().endswith(suffixes)]
    return [
        FileInfo(prefix + e.path, e.path[len(base) :].lstrip("/"), e.size) for e in sorted(found, key=lambda e: e.path)
    ]


@dataclass
class FileSplit(InputPartition):
    """The part-th of ``parts`` equal shares of a file."""

    path: str
    name: str
    size: int
    part: int
    parts: int


def size_splits(root: str, suffixes: tuple[str, ...], split_bytes: int = SPLIT_BYTES) -> list[FileSplit]:
    """Splits from file sizes alone: no file is opened while planning."""
    splits = []
    for file in list_files(root, suffixes):
        parts = max(1, -(-file.size // split_bytes))
        splits += [FileSplit(file.path, file.name, file.size, part, parts) for part in range(parts)]
    return splits


@dataclass
class FileGroup(InputPartition):
    """Splits that one task reads one after the other."""

    splits: list[FileSplit]


def pack(splits: list[FileSplit], pack_bytes: int = PACK_BYTES) -> list[FileGroup]:
    """Groups of neighbouring splits of about ``pack_bytes``; a split of that size or more stays alone."""
    groups, filled = [], pack_bytes
    for split in splits:
        size = split.size // split.parts
        if filled + size > pack_bytes:
            groups.append(FileGroup([]))
            filled = 0
        groups[-1].splits.append(split)
        filled += max(size, 1)
    return groups


def share(count: int, part: int, parts: int) -> tuple[int, int]:
    """Half-open range of the part-th share of ``count`` items."""
    return count * part // parts, count * (part + 1) // parts


def stem(name: str) -> str:
    return name.rsplit(".", 1)[0]
