"""NumPy label volumes as cells or as volume records."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
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

from voxspark import constants as C
from voxspark.operators.volumes import volume_warnings
from voxspark.schemas import VOLUME_CELLS, VOLUME_FILES, VOLUMES
from voxspark.session import settle
from voxspark.sources.files import SPLIT_BYTES, FileSplit, open_file, read_range, share, size_splits, stem

BATCH_CELLS = 1 << 20
#: Bytes between two wanted runs up to which both are read at once instead of one by one.
GAP_BYTES = 1 << 12
#: Half-open bounds of node indices on some of the axes i, j and k.
Box = Mapping[str, tuple[int, int]]
# Kinds and item sizes that volumes may have.
DTYPES = {"i": (1, 2, 4, 8), "u": (1, 2, 4, 8), "b": (1,), "f": (2, 4, 8)}
_CELLS = pa.schema(
    [("volume_id", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("k", pa.int32()), ("value", pa.float64())]
)


@dataclass(frozen=True)
class NpyHeader:
    descr: str
    fortran: bool
    shape: tuple[int, ...]
    offset: int
    kind: str

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.descr)


def volume_kind(name: str) -> str | None:
    base = re.sub(r"\.npy$", "", name.rsplit("/", 1)[-1], flags=re.IGNORECASE).lower()
    return next((kind for pattern, kind in C.VOLUME_KIND_PATTERNS if re.match(pattern, base)), None)


#: Entries of an array header, which is written as a Python dictionary, and their types.
HEADER_FIELDS = {"descr": str, "fortran_order": bool, "shape": tuple}


def _literal(text: str) -> dict:
    try:
        fields = ast.literal_eval(text.strip())
    except (SyntaxError, ValueError, MemoryError, RecursionError) as error:
        raise ValueError("unreadable NumPy header") from error
    if not isinstance(fields, dict) or any(type(fields.get(name)) is not kind for name, kind in HEADER_FIELDS.items()):
        raise ValueError("unreadable NumPy header")
    return fields


def read_npy_header(handle, size: int, name: str) -> NpyHeader:
    prefix = read_range(handle, 0, 12)
    if len(prefix) < 12 or prefix[:6] != b"\x93NUMPY":
        raise ValueError("not a NumPy file")
    if prefix[6] not in (1, 2, 3):
        raise ValueError(f"unsupported NumPy file version {prefix[6]}")
    start, width = (10, 2) if prefix[6] == 1 else (12, 4)
    length = int.from_bytes(prefix[8 : 8 + width], "little")
    text = read_range(handle, start, length).decode("latin1")
    fields = _literal(text)
    descr, sides = fields["descr"], fields["shape"]
    if not sides or any(type(side) is not int or side <= 0 for side in sides):
        raise ValueError("invalid array shape")
    try:
        dtype = np.dtype(descr)
    except TypeError as error:
        raise ValueError(f"unsupported dtype {descr}") from error
    if dtype.itemsize not in DTYPES.get(dtype.kind, ()):
        raise ValueError(f"unsupported dtype {descr}")
    header = NpyHeader(descr, fields["fortran_order"], sides, start + length, volume_kind(name) or "")
    if size - header.offset < dtype.itemsize * int(np.prod(sides, dtype=np.int64)):
        raise ValueError(f"data is shorter than expected for dtype {descr}")
    if not header.kind:
        raise ValueError("file name is not a known volume name")
    if len(sides) != 3:
        raise ValueError(f"expected three dimensions, got {sides}")
    return header


# --- boxes of an array --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Spans:
    """Equally long runs of flat offsets that hold a box of an array, and what between them is read along.

    ``sides`` and ``box`` go from the slowest to the fastest axis. There are ``planes`` x ``rows`` runs of ``length``.
    """

    sides: tuple[int, int, int]
    box: tuple[tuple[int, int], tuple[int, int], tuple[int, int]]
    planes: int
    rows: int
    length: int

    @staticmethod
    def of(sides: tuple[int, int, int], box: tuple[tuple[int, int], ...], gap: int) -> Spans:
        (s0, s1), (m0, m1), (f0, f1) = clipped = tuple((max(0, low), min(high, side)) for (low, high), side in zip(box, sides, strict=True))
        if any(low >= high for low, high in clipped):
            return Spans(sides, clipped, 0, 0, 0)
        row_gap = sides[2] - (f1 - f0)
        plane = (m1 - m0 - 1) * sides[2] + (f1 - f0)
        if row_gap > gap:
            return Spans(sides, clipped, s1 - s0, m1 - m0, f1 - f0)
        if sides[1] * sides[2] - plane > gap:
            return Spans(sides, clipped, s1 - s0, 1, plane)
        return Spans(sides, clipped, 1, 1, (s1 - s0 - 1) * sides[1] * sides[2] + plane)

    def __len__(self) -> int:
        return self.planes * self.rows

    def pieces(self, part: int, parts: int) -> Iterator[tuple[int, int]]:
        """Half-open flat ranges of the part-th of equal shares; a single run is shared by its elements."""
        (s0, _), (m0, _), (f0, _) = self.box
        if len(self) == 1:
            low, high = share(self.length, part, parts)
            runs = [(low, high)] if high > low else []
        else:
            runs = ((0, self.length) for _ in range(*share(len(self), part, parts)))
        first = share(len(self), part, parts)[0] if len(self) != 1 else 0
        for number, (low, high) in enumerate(runs, first):
            plane, row = divmod(number, self.rows)
            start = ((s0 + plane) * self.sides[1] + m0 + row) * self.sides[2] + f0
            for at in range(start + low, start + high, BATCH_CELLS):
                yield at, min(at + BATCH_CELLS, start + high)


def _spans(header: NpyHeader, box: Box) -> Spans:
    axes = "kji" if header.fortran else "ijk"
    sides = header.shape[::-1] if header.fortran else header.shape
    return Spans.of(sides, tuple(box.get(axis, (0, side)) for axis, side in zip(axes, sides, strict=True)), GAP_BYTES // header.dtype.itemsize)


def _cells(handle, header: NpyHeader, volume_id: str, box: Box, part: int, parts: int) -> Iterator[list[pa.Array]]:
    """Columns of the cells of a share of a box, about BATCH_CELLS read at a time."""
    spans, item = _spans(header, box), header.dtype.itemsize
    dtype = np.dtype("u1") if header.dtype.kind == "b" else header.dtype
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for start, end in spans.pieces(part, parts):
        raw = read_range(handle, header.offset + start * item, (end - start) * item)
        if len(raw) < (end - start) * item:
            raise ValueError(f"data is shorter than expected for dtype {header.descr}")
        held.append((np.arange(start, end, dtype=np.int64), np.frombuffer(raw, dtype).astype(np.float64)))
        count += end - start
        if count >= BATCH_CELLS:
            yield _columns(held, spans, header, volume_id)
            held, count = [], 0
    if held:
        yield _columns(held, spans, header, volume_id)


def _columns(held: list[tuple[np.ndarray, np.ndarray]], spans: Spans, header: NpyHeader, volume_id: str) -> list[pa.Array]:
    offsets, values = (np.concatenate(parts) for parts in zip(*held, strict=True))
    rest, fast = np.divmod(offsets, spans.sides[2])
    slow, middle = np.divmod(rest, spans.sides[1])
    wanted = np.ones(len(offsets), bool)
    for axis, (low, high) in zip((slow, middle, fast), spans.box, strict=True):
        wanted &= (axis >= low) & (axis < high)
    i, j, k = (fast, middle, slow) if header.fortran else (slow, middle, fast)
    number = int(wanted.sum())
    return [pa.array([volume_id] * number, pa.string()), *[pa.array(axis[wanted].astype(np.int32)) for axis in (i, j, k)], pa.array(values[wanted])]


# --- volumes of a table of files ----------------------------------------------------------------------


VOLUME_FAULTS = (ValueError, OSError, OverflowError, pa.ArrowException)


def _volume_row(row: dict) -> dict:
    """Shape, dtype, order, kind and data offset of a listed file, or why it cannot be used."""
    try:
        with open_file(row["path"]) as handle:
            size = handle.size()
            header = read_npy_header(handle, size, row["name"])
        if max(header.shape) >= 1 << 31:
            raise ValueError(f"sides {header.shape} are beyond 32 bits")
    except VOLUME_FAULTS as error:
        return {**row, "error": f"{type(error).__name__}: {error}"}
    nx, ny, nz = header.shape
    told = {"dtype": header.descr, "fortran_order": header.fortran, "visualization": header.kind, "data_offset": header.offset}
    return {**row, "nx": nx, "ny": ny, "nz": nz, **told, "size": size}


def read_volumes(files: DataFrame) -> DataFrame:
    """Shape, dtype, order, kind and place of every listed volume file, or the reason it cannot be used; headers are read
    in tasks. ``files`` has volume_id and path; the kind comes from the file's name, the last part of its path."""
    schema = to_arrow_schema(VOLUME_FILES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_volume_row({**row, "name": row["path"].rsplit("/", 1)[-1]}) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("volume_id", "path").repartition("path").mapInArrow(read, VOLUME_FILES)


def _part_cells(batches: Iterator[pa.RecordBatch], box: Box) -> Iterator[pa.RecordBatch]:
    names = [*VOLUME_CELLS.names, "error"]
    for batch in batches:
        for row in batch.to_pylist():
            header = NpyHeader(row["dtype"], row["fortran_order"], (row["nx"], row["ny"], row["nz"]), row["data_offset"], "")
            try:
                with open_file(row["path"]) as handle:
                    for columns in _cells(handle, header, row["volume_id"], box, row["part"], row["parts"]):
                        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.string())], names=names)
            except VOLUME_FAULTS as error:
                failed = [row["volume_id"], None, None, None, None, f"{type(error).__name__}: {error}"]
                kinds = [pa.string(), *[pa.int32()] * 3, pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(failed, kinds, strict=True)], names=names)


def decode_volumes(volumes: DataFrame, box: Box | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Cells of the usable volumes of ``read_volumes``, plus a row with an error for every part that cannot be read.

    ``box`` holds half-open bounds of i, j and k. Only its byte runs are read, whichever axis they cut: a slab on the
    slowest axis is one run, on the middle axis one run a plane, on the fastest axis one run a row, where gaps up to
    GAP_BYTES are read along. Shares of about ``split_bytes`` are the units of work, so one large volume is read by
    many tasks, and a volume that holds a third of all cells is spread like the others.
    """
    wanted = dict(box or {})
    if unknown := set(wanted) - set("ijk"):
        raise ValueError(f"no axes {sorted(unknown)}")
    fraction = F.lit(1.0)
    for axis, side in zip("ijk", ("nx", "ny", "nz")):
        low, high = wanted.get(axis, (None, None))
        if low is not None:
            inside = F.greatest(F.lit(0), F.least(F.lit(high), F.col(side)) - F.greatest(F.lit(low), F.lit(0)))
            fraction = fraction * inside / F.col(side)
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") * fraction / split_bytes)).cast("int")
    shares = (
        volumes.where(F.col("error").isNull())
        .withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("volume_id", "path", "nx", "ny", "nz", "dtype", "fortran_order", "data_offset", "part", "parts")
    )
    total = volumes.agg(F.sum(F.col("size") * fraction)).first()[0] or 0
    # A fixed task count: these rows are tiny and adaptive execution would merge them, but their decoding is not.
    tasks = max(volumes.sparkSession.sparkContext.defaultParallelism * 4, int(-(-total // split_bytes)))
    schema = T.StructType([*[T.StructField(f.name, f.dataType, f.name != "volume_id") for f in VOLUME_CELLS.fields], T.StructField("error", T.StringType())])
    return shares.repartition(tasks, "volume_id", "part").mapInArrow(lambda batches: _part_cells(batches, wanted), schema)


@dataclass(frozen=True)
class VolumeSet:
    """Usable volumes with their warnings, their cells, and a status for every listed file."""

    volumes: DataFrame
    cells: DataFrame
    statuses: DataFrame


def load_volumes(files: DataFrame, box: Box | None = None) -> VolumeSet:
    """Cells of every listed volume that can be read whole, and a status for every entry; one bad file stops no other.

    ``files`` has volume_id and path. Statuses are (volume_id, path, status, reason): loaded or failed. A volume id that
    several entries claim fails, as does a file of which any part cannot be read. ``warnings`` of a volume tells of
    64-bit labels that a DOUBLE does not hold exactly, among the cells that were read.
    """
    listed = files.select("volume_id", "path")
    claimed = listed.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("volume_id")
    found = settle(read_volumes(listed.join(claimed, "volume_id", "left_anti")))
    decoded = settle(decode_volumes(found, box))
    broken = decoded.where(F.col("error").isNotNull()).groupBy("volume_id").agg(F.min("error").alias("reason"))
    unusable = found.where(F.col("error").isNotNull()).select("volume_id", F.col("error").alias("reason"))
    failures = settle(unusable.unionByName(broken).unionByName(claimed.select("volume_id", F.lit("duplicate volume_id").alias("reason"))))
    cells = decoded.where(F.col("error").isNull()).drop("error").join(failures, "volume_id", "left_anti")
    good = found.join(failures, "volume_id", "left_anti").drop("error", "data_offset", "size")
    volumes = settle(good.join(volume_warnings(cells, good), "volume_id", "left"))
    statuses = listed.join(failures, "volume_id", "left").select(
        "volume_id", "path", F.when(F.col("reason").isNull(), "loaded").otherwise("failed").alias("status"), "reason"
    )
    return VolumeSet(volumes, cells, statuses)


# --- spark.read.format("npy") -------------------------------------------------------------------------


class NpyReader(DataSourceReader):
    """Cells in shares of the wanted box; bounds on i, j and k read only the byte runs that hold them."""

    def __init__(self, options):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.skip_invalid = options.get("skipinvalid", "false").lower() == "true"
        self.box: dict[str, tuple[int, int]] = {}
        self.volume_id: str | None = None

    def pushFilters(self, filters: list[Filter]):
        """Note bounds of indices and the volume; Spark still applies every filter to the rows."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "volume_id" and isinstance(f, EqualTo):
                self.volume_id = f.value
            elif name in ("i", "j", "k") and isinstance(f.value, int):
                low, high = self.box.get(name, (0, 1 << 62))
                if isinstance(f, EqualTo):
                    low, high = max(low, f.value), min(high, f.value + 1)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    high = min(high, f.value + isinstance(f, LessThanOrEqual))
                self.box[name] = (low, high)
            yield f

    def partitions(self):
        splits = size_splits(self.path, (".npy",), self.split_bytes)
        return [s for s in splits if self.volume_id is None or stem(s.name) == self.volume_id]

    def read(self, split: FileSplit):
        with open_file(split.path) as handle:
            try:
                header = read_npy_header(handle, split.size, split.name)
            except ValueError:
                if self.skip_invalid:
                    return
                raise
            for columns in _cells(handle, header, stem(split.name), self.box, split.part, split.parts):
                yield pa.RecordBatch.from_arrays(columns, schema=_CELLS)


class NpyVolumes(NpyReader):
    """One record per file: shape, dtype, order and kind, or the reason it cannot be used."""

    def partitions(self):
        return [s for s in super().partitions() if s.part == 0]

    def read(self, split: FileSplit):
        row = {"volume_id": stem(split.name), "name": split.name}
        with open_file(split.path) as handle:
            try:
                header = read_npy_header(handle, split.size, split.name)
                row.update(zip(("nx", "ny", "nz"), header.shape))
                row.update(dtype=header.descr, fortran_order=header.fortran, visualization=header.kind)
            except ValueError as error:
                row["error"] = str(error)
        yield pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(VOLUMES))


class NpyDataSource(DataSource):
    """Cells of volumes below a folder, or with option content=volumes one record per file."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _volumes(self) -> bool:
        return self.options.get("content", "cells") == "volumes"

    def schema(self) -> T.StructType:
        return VOLUMES if self._volumes() else VOLUME_CELLS

    def reader(self, schema: T.StructType) -> NpyReader:
        return (NpyVolumes if self._volumes() else NpyReader)(self.options)
