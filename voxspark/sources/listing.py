"""Folder trees as tables: a walk that lists the folders of one depth after the other, in tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from voxspark.operators.catalog import listing_ordinals
from voxspark.schemas import LISTING
from voxspark.session import discard, settle
from voxspark.sources.files import resolve

_ROWS = to_arrow_schema(LISTING)
#: Entries that travel in one Arrow batch.
LISTED_ROWS = 1 << 13
#: Folders of one depth per task; a folder is one task's work, however many entries it has.
TASK_FOLDERS = 256


def _local_entries(folder: str) -> Iterator[dict]:
    """Entries of a local folder; links are followed, and entries that cannot be looked at are left out."""
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                is_dir, stat = entry.is_dir(), entry.stat()
                # A link to a folder above itself is listed, but walking into it would not end.
                loop = is_dir and entry.is_symlink() and (folder + "/").startswith(os.path.realpath(entry.path).rstrip("/") + "/")
            except OSError:
                continue
            yield {
                "name": entry.name,
                "type": "directory" if is_dir else "file",
                "size": None if is_dir else stat.st_size,
                "mtime_ms": int(stat.st_mtime * 1000),
                "walked": is_dir and not loop,
            }


def _remote_entries(filesystem: pafs.FileSystem, folder: str) -> Iterator[dict]:
    for info in filesystem.get_file_info(pafs.FileSelector(folder)):
        if info.type not in (pafs.FileType.File, pafs.FileType.Directory):
            continue
        is_dir = info.type == pafs.FileType.Directory
        modified = None if info.mtime_ns is None else info.mtime_ns // 1_000_000
        yield {
            "name": info.base_name,
            "type": "directory" if is_dir else "file",
            "size": None if is_dir else info.size,
            "mtime_ms": modified,
            "walked": is_dir,
        }


def _entries(row: dict) -> Iterator[dict]:
    """The rows of one folder; a folder that cannot be listed is a row that says why."""
    base = {"root": row["root"], "dir": row["dir"]}
    try:
        filesystem, inner = resolve(row["path"])
        inner = inner.rstrip("/") or "/"
        found = _local_entries(inner) if isinstance(filesystem, pafs.LocalFileSystem) else _remote_entries(filesystem, inner)
        for entry in found:
            yield {**base, **entry, "path": f"{row['path'].rstrip('/')}/{entry['name']}"}
    except (OSError, ValueError, pa.ArrowException) as error:
        up, _, name = row["dir"].rpartition("/")
        told = f"{type(error).__name__}: {error}"
        yield {"root": row["root"], "dir": up, "name": name, "path": row["path"], "type": "unreadable", "walked": False, "error": told}


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            for entry in _entries(row):
                held.append(entry)
                if len(held) >= LISTED_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=_ROWS)
                    held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ROWS)


def list_tree(roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every entry below the folders of ``roots`` (root, path): root, dir, name, path, type, size, mtime_ms, error, ordinal.

    ``dir`` is the folder inside the root, '' for the root itself. ``type`` is directory, file or unreadable: the last is
    a folder that could not be listed, with the reason in ``error``; an unreadable root has an empty name. Sizes of
    folders are null. Links are followed, except into a folder above them; entries that cannot be looked at are left out.
    ``ordinal`` is the place in the root: folder by folder, folders before files, then by lower-cased name.

    The folders of a depth are listed by tasks, and the next depth starts from what they found; nothing of it is gathered
    on the driver, which only asks whether there is a next depth. ``max_depth`` is the number of depths to list.
    """
    frontier = roots.select(F.col("root").cast("string").alias("root"), F.lit("").alias("dir"), F.col("path").cast("string").alias("path"))
    depths: list[DataFrame] = []
    folders = frontier.count()
    while folders and (max_depth is None or len(depths) < max_depth):
        tasks = -(-folders // TASK_FOLDERS)
        tasks = max(tasks, min(folders, frontier.sparkSession.sparkContext.defaultParallelism))
        found = settle(frontier.repartition(tasks, "root", "path").mapInArrow(_list_folders, LISTING))
        depths.append(found)
        inside = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
        frontier = found.where("walked").select("root", inside.alias("dir"), "path")
        folders = frontier.count()
    rows = roots.sparkSession.createDataFrame([], LISTING)
    for found in depths:
        rows = rows.unionByName(found)
    numbered = listing_ordinals(rows.drop("walked"))  # settles the rows, so the depths are read for the last time
    discard(*depths)
    return numbered
