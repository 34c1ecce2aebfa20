"""Voxel file corpora: listings, headers, and voxels chunk by chunk."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema

from voxspark.schemas import VOXELS, VXZ_DIRECTORY, VXZ_HEADERS
from voxspark.sources.files import SPLIT_BYTES, FileSplit, open_file, share, size_splits, stem
from voxspark.sources.vxz_format import Bounds, Chunk, locate, read_chunk, read_header

DECODED = T.StructType(
    [T.StructField(f.name, f.dataType, f.name != "model_id") for f in VOXELS.fields]
    + [T.StructField("error", T.StringType(), True)]
)
_DIRECTORY = to_arrow_schema(VXZ_DIRECTORY)
#: Bounds of an axis without any.
EVERYWHERE = (-(1 << 40), 1 << 40)
#: Chunks of a directory that travel in one Arrow batch.
DIRECTORY_ROWS = 1024
_ARROW = pa.schema(
    [("model_id", pa.string()), ("chunk_no", pa.int32()), ("chunk_rank", pa.int32())]
    + [(c, pa.int32()) for c in "xyz"]
    + [(c, pa.int16()) for c in ("dx", "dy", "dz", "flags", "ovoxel_type", "qef_rank")]
)


# --- corpus listings ---------------------------------------------------------------------------------


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """model_id, path, length, modified of every voxel file below a folder; file contents are not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.vxz")
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    inside = F.regexp_replace("path", r"^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/") + "/"
    relative = F.when(inside.startswith(base), F.substring(inside, len(base) + 1, 2**31 - 1))
    name = F.coalesce(relative, F.substring_index("path", "/", -1))
    return listed.select(F.regexp_replace(name, r"(?i)\.vxz$", "").alias("model_id"), "path", "length", "modified")


def listed_files(spark: SparkSession, list_path: str, root: str) -> DataFrame:
    """model_id, path and problem of every entry of a text list.

    Text after # is a comment; relative paths are taken from ``root``. Entries that are no voxel files or repeat a
    file stem carry a problem.
    """
    entry = F.trim(F.substring_index("value", "#", 1))
    path = F.when(F.col("entry").startswith("/") | F.col("entry").contains("://"), F.col("entry")).otherwise(
        F.concat(F.lit(root.rstrip("/") + "/"), "entry")
    )
    entries = (
        spark.read.text(list_path)
        .select(entry.alias("entry"))
        .where(F.col("entry") != "")
        .withColumn("path", path)
        .withColumn("model_id", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    )
    repeated = entries.groupBy("model_id").agg((F.count("*") > 1).alias("__repeated"))
    problem = F.when(~F.lower("path").endswith(".vxz"), "not a .vxz path").when(F.col("__repeated"), "duplicate stem")
    return entries.join(repeated, "model_id").select("model_id", "path", problem.alias("problem"))


# --- headers and voxels of listed files ---------------------------------------------------------------


def _file_rows(path: str) -> Iterator[dict]:
    """The header of a file, then its chunks; faults become an error of the file, or of the chunk."""
    row: dict = {}
    try:
        with open_file(path) as handle:
            header, size = read_header(handle), handle.size()
        row = {f: getattr(header, f) for f in VXZ_HEADERS.names if hasattr(header, f)}
        row["attributes"] = [{"name": n, "channels": c} for n, c in header.attributes]
        row["chunk_count"] = len(header.chunks)
        # Numbers that no column holds fail the file here, before they can fail the task.
        pa.RecordBatch.from_pylist([row], schema=pa.schema([f for f in _DIRECTORY if f.name in row]))
    except (ValueError, OSError, OverflowError, pa.ArrowException) as error:
        yield {"error": f"{type(error).__name__}: {error}"}
        return
    yield row
    for chunk_no in range(len(header.chunks)):
        try:
            chunk = locate(header, chunk_no, size)
            streams = [{"name": n, "start": start, "length": length} for n, (start, length) in chunk.streams.items()]
            yield {**row, "chunk_no": chunk_no, "origin": list(chunk.origin), "streams": streams}
        except ValueError as error:
            yield {**row, "chunk_no": chunk_no, "error": str(error)}


def _directory_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.select(["model_id", "path"]).to_pylist():
            for rows in itertools.batched(_file_rows(file["path"]), DIRECTORY_ROWS):
                yield pa.RecordBatch.from_pylist([{**file, **row} for row in rows], schema=_DIRECTORY)


def read_directory(files: DataFrame) -> DataFrame:
    """Headers and chunk directories of listed files; each header is parsed once, in a task.

    A file's own row has no chunk_no; a file that cannot be read has only that row, with an error.
    """
    return files.select("model_id", "path").mapInArrow(_directory_rows, VXZ_DIRECTORY)


def headers_of(directory: DataFrame) -> DataFrame:
    return directory.where(F.col("chunk_no").isNull()).select(*VXZ_HEADERS.names)


def read_headers(files: DataFrame) -> DataFrame:
    """Header of every listed file; a file that cannot be read has only an error. Headers are read in tasks."""
    return headers_of(read_directory(files))


def _chunk_batch(model_id: str, chunk_no: int, columns: dict[str, np.ndarray]) -> list[pa.Array]:
    count = len(columns["x"])
    full = {
        "model_id": pa.array([model_id] * count, pa.string()),
        "chunk_no": np.full(count, chunk_no, np.int32),
        **columns,
    }
    return [
        pa.nulls(count, f.type) if f.name not in full else pa.array(full[f.name], f.type, safe=False) for f in _ARROW
    ]


def _decode_chunks(batches: Iterator[pa.RecordBatch], bounds: Bounds | None) -> Iterator[pa.RecordBatch]:
    schema = _ARROW.append(pa.field("error", pa.string()))
    for batch in batches:
        for row in batch.to_pylist():
            try:
                if row["error"] is not None:
                    raise ValueError(row["error"])
                shared = SimpleNamespace(**{**row, "attributes": [(a["name"], a["channels"]) for a in row["attributes"]]})
                chunk = Chunk(tuple(row["origin"]), {s["name"]: (s["start"], s["length"]) for s in row["streams"]})
                with open_file(row["path"]) as handle:
                    columns = read_chunk(handle, shared, chunk, bounds)
                arrays = _chunk_batch(row["model_id"], row["chunk_no"], columns)
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(arrays[0]), pa.string())], schema=schema)
            except (ValueError, OSError, RuntimeError, OverflowError) as error:
                failed = {"model_id": row["model_id"], "chunk_no": row["chunk_no"], "error": str(error)}
                yield pa.RecordBatch.from_pylist([failed], schema=schema)


def _reaches(bounds: Bounds) -> Column:
    """Whether a chunk of the directory reaches into bounds."""
    inside = F.lit(True)
    for axis, (low, high) in enumerate(bounds):
        start = F.col("origin")[axis].cast("long")
        inside = inside & (start < high) & (start + F.col("chunk_size") > low)
    return inside


def decode(files: DataFrame, directory: DataFrame | None = None, bounds: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """Voxels of all listed files, plus one row with an error for every chunk or file that cannot be read.

    Chunks are the unit of work: the chunk list is spread evenly over tasks, however large single files are, and a task
    goes straight to the bytes of its chunks. ``bounds`` holds half-open cell ranges of x, y or z: chunks outside are
    left out by the directory, and in the others the parts of the octree outside are stepped over. Ranks in a chunk
    stay those of the whole chunk.
    """
    if unknown := set(bounds or {}) - set("xyz"):
        raise ValueError(f"no axes {sorted(unknown)}")
    box = None if not bounds else [bounds.get(axis, EVERYWHERE) for axis in "xyz"]
    directory = read_directory(files) if directory is None else directory
    problem = F.coalesce("error", F.when(F.col("chunk_count") == 0, "no chunks"))
    chunks = directory.withColumn("error", problem).where(F.col("chunk_no").isNotNull() | F.col("error").isNotNull())
    if box is not None:
        chunks = chunks.where(F.col("error").isNotNull() | _reaches(box))
    spark = files.sparkSession
    tasks = spark.sparkContext.defaultParallelism * 4
    if "length" in files.columns:
        total = files.agg(F.sum("length")).first()[0] or 0
        tasks = max(tasks, -(-total // SPLIT_BYTES))
    # A fixed task count: chunk rows are tiny and adaptive execution would merge them, but their decoding is not.
    return chunks.repartition(tasks, "path", "chunk_no").mapInArrow(lambda batches: _decode_chunks(batches, box), DECODED)


# --- spark.read.format("vxz") --------------------------------------------------------------------------


class VxzReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        self.bounds: dict[str, tuple[int, int]] = {}
        self.models: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        """Note coordinate and model bounds for pruning; Spark still applies every filter to the rows."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in ("x", "y", "z") and isinstance(f.value, int):
                low, high = self.bounds.get(name, EVERYWHERE)
                if isinstance(f, EqualTo):
                    low, high = max(low, f.value), min(high, f.value + 1)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    high = min(high, f.value + isinstance(f, LessThanOrEqual))
                self.bounds[name] = (low, high)
            elif name == "model_id" and isinstance(f, EqualTo):
                self.models = {f.value} if self.models is None else self.models & {f.value}
            yield f

    def partitions(self):
        splits = size_splits(self.path, (".vxz",), self.split_bytes)
        return [s for s in splits if self.models is None or stem(s.name) in self.models]

    def _wanted(self, header, chunk_no: int) -> bool:
        index = header.chunks[chunk_no].get("idx")
        if not isinstance(index, list) or len(index) != 3:
            return True
        starts = [int(i) * header.chunk_size for i in index]
        return all(
            start < self.bounds[c][1] and start + header.chunk_size > self.bounds[c][0]
            for c, start in zip("xyz", starts)
            if c in self.bounds
        )

    def read(self, split: FileSplit):
        box = [self.bounds.get(c, EVERYWHERE) for c in "xyz"] if self.bounds else None
        with open_file(split.path) as handle:
            header = read_header(handle)
            for chunk_no in range(*share(len(header.chunks), split.part, split.parts)):
                if self._wanted(header, chunk_no):
                    columns = read_chunk(handle, header, locate(header, chunk_no, split.size), box)
                    yield pa.RecordBatch.from_arrays(_chunk_batch(stem(split.name), chunk_no, columns), schema=_ARROW)


class VxzDataSource(DataSource):
    """Voxels of one file or all files below a folder; an unreadable file fails the job (see ``decode`` otherwise)."""

    @classmethod
    def name(cls) -> str:
        return "vxz"

    def schema(self) -> T.StructType:
        return VOXELS

    def reader(self, schema: T.StructType) -> VxzReader:
        return VxzReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))
