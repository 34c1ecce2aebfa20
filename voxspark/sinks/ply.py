"""Binary PLY files, many meshes at once, each written by many tasks.

Records have fixed widths, so every record knows its byte offset. Records are grouped by stretches of the files, and
tasks write whole stretches straight into a staged file of the mesh; the commit checks the byte counts and renames.
Nothing but counts passes through the driver. The target is a folder all executors share; writing a stretch twice writes
the same bytes, so retried and speculative tasks are harmless.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from voxspark.operators.lookup import lookup_join
from voxspark.session import settle

VERTEX = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4")])
FACE = np.dtype([("n", "u1"), ("a", "<i4"), ("b", "<i4"), ("c", "<i4")])
#: Records whose offsets agree above these bits make one row: 128 KiB of a file, at most 11,000 records.
STRETCH_BITS = 17
SCHEMA = (
    "mesh_id string, stretch long, header string, total_bytes long, "
    "points array<struct<offset:long,x:float,y:float,z:float>>, faces array<struct<offset:long,a:int,b:int,c:int>>"
)

HEADER = (
    "ply\nformat binary_little_endian 1.0\ncomment source %s\ncomment resolution %d\nelement vertex %d\n"
    "property float x\nproperty float y\nproperty float z\nelement face %d\n"
    "property list uchar int vertex_indices\nend_header\n"
)


def ply_rows(meshes: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Rows the sink writes: the records of one stretch of a file each. The first stretch has the header and the file's size.

    ``meshes`` has mesh_id, source and resolution; ``vertices`` a dense vertex_id and float x, y, z per mesh_id;
    ``faces`` a dense face_id and a, b, c.
    """
    counts = meshes
    for table, name in ((vertices, "vertex_count"), (faces, "face_count")):
        counts = counts.join(table.groupBy("mesh_id").agg(F.count("*").alias(name)), "mesh_id", "left")
    counts = counts.fillna(0, ["vertex_count", "face_count"])
    header = F.format_string(HEADER, "source", "resolution", "vertex_count", "face_count")
    layout = counts.withColumn("header", header).withColumn("start", F.octet_length("header").cast("long"))
    face_start = F.col("start") + VERTEX.itemsize * F.col("vertex_count")
    layout = settle(layout.select(
        "mesh_id",
        "header",
        "start",
        face_start.alias("face_start"),
        (face_start + FACE.itemsize * F.col("face_count")).alias("total_bytes"),
    ))
    heads = layout.select("mesh_id", F.lit(0).cast("long").alias("offset"), "header", "total_bytes")
    small = layout.select("mesh_id", "start", "face_start")
    points = lookup_join(vertices, small, ["mesh_id"]).select(
        "mesh_id",
        (F.col("start") + VERTEX.itemsize * F.col("vertex_id")).alias("offset"),
        F.struct(*[F.col(c).cast("float").alias(c) for c in "xyz"]).alias("point"),
    )
    corners = lookup_join(faces, small, ["mesh_id"]).select(
        "mesh_id",
        (F.col("face_start") + FACE.itemsize * F.col("face_id")).alias("offset"),
        F.struct(*[F.col(c).cast("int").alias(c) for c in "abc"]).alias("face"),
    )
    rows = heads.unionByName(points, allowMissingColumns=True).unionByName(corners, allowMissingColumns=True)

    def records(name: str, fields: str) -> Column:
        return F.collect_list(F.when(F.col(name).isNotNull(), F.struct("offset", *[F.col(name)[f].alias(f) for f in fields])))

    return rows.groupBy("mesh_id", F.shiftright("offset", STRETCH_BITS).alias("stretch")).agg(
        F.max("header").alias("header"),
        F.max("total_bytes").alias("total_bytes"),
        records("point", "xyz").alias("points"),
        records("face", "abc").alias("faces"),
    )


def write_ply(meshes: DataFrame, vertices: DataFrame, faces: DataFrame, folder: str) -> None:
    """Write ``<folder>/<mesh_id>.ply`` for every mesh."""
    rows = ply_rows(meshes, vertices, faces).sortWithinPartitions("mesh_id", "stretch")
    rows.write.format("ply").mode("append").save(folder)


@dataclass
class Written(WriterCommitMessage):
    written: dict[str, int] = field(default_factory=dict)
    expected: dict[str, int] = field(default_factory=dict)


def _runs(starts: np.ndarray, width: int) -> Iterator[slice]:
    """Stretches of rows that are neighbours in the file."""
    breaks = np.flatnonzero(np.diff(starts) != width) + 1
    for low, high in zip([0, *breaks], [*breaks, len(starts)]):
        yield slice(low, high)


def _write_records(descriptor: int, rows: pa.StructArray, kind: np.dtype) -> int:
    """Write records in the order of their offsets, neighbours at once; the number of bytes."""
    columns = dict(zip(rows.type.names, rows.flatten()))
    if any(column.null_count for column in columns.values()):
        raise ValueError("a vertex or face with a NULL in it")
    starts = columns["offset"].to_numpy()
    order = np.argsort(starts, kind="stable")
    records, starts = np.empty(len(starts), kind), starts[order]
    for name in kind.names:
        records[name] = 3 if name == "n" else columns[name].to_numpy()[order]
    return sum(os.pwrite(descriptor, records[run].tobytes(), int(starts[run.start])) for run in _runs(starts, kind.itemsize) if len(records))


class PlyWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.token = re.sub(r"^file:/+", "/", folder), uuid.uuid4().hex

    def _staged(self, mesh_id: str) -> str:
        folder, name = os.path.split(os.path.join(self.folder, mesh_id))
        return os.path.join(folder, f".{name}.{self.token}.tmp")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        message = Written(Counter(), {})
        current, descriptor = None, None
        try:
            for batch in iterator:
                for row, mesh_id in enumerate(batch.column("mesh_id").to_pylist()):
                    if mesh_id != current:
                        done, current, descriptor = descriptor, mesh_id, None
                        self._close(done)
                        descriptor = self._open(mesh_id)
                    if (header := batch.column("header")[row].as_py()) is not None:
                        message.written[mesh_id] += os.pwrite(descriptor, header.encode(), 0)
                        message.expected[mesh_id] = batch.column("total_bytes")[row].as_py()
                    for column, kind in (("points", VERTEX), ("faces", FACE)):
                        message.written[mesh_id] += _write_records(descriptor, batch.column(column)[row].values, kind)
        finally:
            self._close(descriptor)
        return message

    def _open(self, mesh_id: str) -> int:
        path = self._staged(mesh_id)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return os.open(path, os.O_WRONLY | os.O_CREAT, 0o644)

    def _close(self, descriptor: int | None) -> None:
        """A task's stretches of a mesh follow each other, so their file is flushed to disk once."""
        if descriptor is not None:
            try:
                os.fsync(descriptor)
            finally:
                os.close(descriptor)

    def commit(self, messages: list[Written | None]) -> None:
        written, expected = Counter(), {}
        for message in messages:
            if message is not None:
                written.update(message.written)
                expected.update(message.expected)
        broken = [mesh_id for mesh_id in written.keys() | expected.keys() if written[mesh_id] != expected.get(mesh_id)]
        if broken:
            self._discard(written)
            raise RuntimeError(f"incomplete PLY output: {broken[:5]}")
        for mesh_id in expected:
            os.replace(self._staged(mesh_id), os.path.join(self.folder, f"{mesh_id}.ply"))

    def _discard(self, mesh_ids) -> None:
        for mesh_id in mesh_ids:
            if os.path.exists(self._staged(mesh_id)):
                os.unlink(self._staged(mesh_id))

    def abort(self, messages: list[Written | None]) -> None:
        self._discard({mesh_id for message in messages if message is not None for mesh_id in message.written})


class PlyDataSource(DataSource):
    """Write-only format for the rows of ``ply_rows``."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"])
