"""From folder trees to the volumes worth looking at, with their labels: listing, selection, manifest, cells, histograms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.operators.catalog import default_volumes, folder_selection, roots_without_volumes
from voxspark.operators.manifest import label_rows, manifest_entries
from voxspark.operators.volumes import category_histogram, label_histogram
from voxspark.session import settle
from voxspark.sources.files import open_file
from voxspark.sources.npy import Box, VolumeSet, load_volumes


@dataclass(frozen=True)
class Folders:
    """What is loaded of every root: the selected files with their paths, the volumes, the label texts (volume_id, code,
    text), the volume to show first (root, name), and the roots without a volume (root, reason)."""

    selection: DataFrame
    volumes: VolumeSet
    labels: DataFrame
    first: DataFrame
    left_out: DataFrame


def _file_id(*parts: str) -> Column:
    return F.concat_ws("/", *[F.when(F.col(p) != "", F.col(p)) for p in parts])


def read_texts(files: DataFrame) -> DataFrame:
    """(manifest_id, text) of listed documents (manifest_id, path); one that cannot be read has a null text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with open_file(row["path"]) as handle:
                        text = handle.read().decode("utf-8", "replace")
                except (OSError, ValueError):
                    text = None
                yield pa.RecordBatch.from_pylist([{"manifest_id": row["manifest_id"], "text": text}], schema=_TEXTS)

    return files.select("manifest_id", "path").repartition("path").mapInArrow(read, "manifest_id string, text string")


_TEXTS = pa.schema([("manifest_id", pa.string()), ("text", pa.string())])


def load_folders(files: DataFrame, box: Box | None = None) -> Folders:
    """Select one folder per root of a listing and load its volumes and label texts.

    ``files`` is what ``list_tree`` returned. Only files of the selection are ever opened. A volume's id is root, folder
    and name; label texts come from the folder's manifest, matched by file name. Volumes that cannot be read have a
    status and stop no others; a manifest that cannot be read gives no texts. Meshes are in the selection.
    """
    chosen = folder_selection(files)
    places = files.where("type = 'file'").select("root", "dir", "name", "path")
    selection = settle(chosen.join(places, ["root", "dir", "name"]).withColumn("file_id", _file_id("root", "dir", "name")))
    wanted = selection.where("kind = 'volume'").select(F.col("file_id").alias("volume_id"), "path")
    volumes = load_volumes(wanted, box)
    manifests = selection.where("kind = 'manifest'").select(_file_id("root", "dir").alias("manifest_id"), "path")
    described = manifest_entries(settle(read_texts(manifests))).withColumn("volume_id", F.concat_ws("/", "manifest_id", "file"))
    labels = settle(label_rows(described, "volume_id"))
    return Folders(selection, volumes, labels, default_volumes(selection), roots_without_volumes(files))


def folder_categories(folders: Folders) -> DataFrame:
    """Cells per category of every loaded volume, as its legend shows them."""
    return category_histogram(folders.volumes.cells, folders.volumes.volumes)


def folder_labels(folders: Folders) -> DataFrame:
    """Cells per whole label of every loaded volume, with colour and manifest text."""
    return label_histogram(folders.volumes.cells, folders.labels)
