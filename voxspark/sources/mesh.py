"""Vertices and faces of PLY, OBJ and STL files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.pandas.types import to_arrow_schema

from voxspark.schemas import MESH_FACES, MESH_VERTICES, MESHES
from voxspark.sources.files import SPLIT_BYTES, FileGroup, FileSplit, open_file, pack, read_range, share, size_splits, stem

BATCH_ROWS = 1 << 18
SUFFIXES = (".ply", ".obj", ".stl")
PLY_TYPES = {
    **dict.fromkeys(("char", "int8"), "i1"),
    **dict.fromkeys(("uchar", "uint8"), "u1"),
    **dict.fromkeys(("short", "int16"), "i2"),
    **dict.fromkeys(("ushort", "uint16"), "u2"),
    **dict.fromkeys(("int", "int32"), "i4"),
    **dict.fromkeys(("uint", "uint32"), "u4"),
    **dict.fromkeys(("float", "float32"), "f4"),
    **dict.fromkeys(("double", "float64"), "f8"),
}
STL_FACET = np.dtype([("normal", "<f4", 3), ("points", "<f4", (3, 3)), ("extra", "<u2")])
_MESHES = to_arrow_schema(MESHES)
Rows = Iterator[tuple[int, np.ndarray]]


def _steps(low: int, high: int) -> Iterator[tuple[int, int]]:
    for start in range(low, high, BATCH_ROWS):
        yield start, min(start + BATCH_ROWS, high)


def _exactly(handle, start: int, length: int) -> bytes:
    raw = read_range(handle, start, length)
    if len(raw) != length:
        raise ValueError("data is shorter than announced")
    return raw


def fan(polygons: list[list[int]]) -> np.ndarray:
    triangles = [(p[0], p[n], p[n + 1]) for p in polygons for n in range(1, len(p) - 1)]
    return np.asarray(triangles, np.int64).reshape(-1, 3)


# --- PLY -------------------------------------------------------------------------------------------------


class Ply:
    """Binary files with three corners per face are read in equal shares; others in one pass."""

    def __init__(self, handle, size: int):
        head, end = read_range(handle, 0, 1 << 16), None
        while head.startswith(b"ply") and (end := re.search(rb"end_header\r?\n", head)) is None:
            more = handle.read(len(head))  # doubles, so that a long header is searched a few times only
            if not more:
                break
            head += more
        if not head.startswith(b"ply") or end is None:
            raise ValueError("not a PLY file")
        self.handle, self.size, self.start = handle, size, end.end()
        self.elements: list[tuple[str, int, list[tuple[str, ...]]]] = []
        for line in head[: end.start()].decode("ascii", "replace").splitlines():
            words = line.split()
            if words[:1] == ["format"]:
                self.format = words[1]
            elif words[:1] == ["element"]:
                self.elements.append((words[1], int(words[2]), []))
            elif words[:1] == ["property"]:
                self.elements[-1][2].append(tuple(words[1:]))
        if [e[0] for e in self.elements][:1] != ["vertex"] or any(p[0] == "list" for p in self.elements[0][2]):
            raise ValueError("the first PLY element must be plain vertices")
        self.order = ">" if self.format == "binary_big_endian" else "<"
        self.vertex = np.dtype([(name, self.order + PLY_TYPES[kind]) for kind, name in self.elements[0][2]])
        self.vertex_count = self.elements[0][1]

    def _faces(self):
        if len(self.elements) < 2 or self.elements[1][0] != "face":
            return 0, None
        lists = self.elements[1][2]
        if len(lists) != 1 or lists[0][0] != "list":
            raise ValueError("PLY faces must have one list property")
        return self.elements[1][1], (self.order + PLY_TYPES[lists[0][1]], self.order + PLY_TYPES[lists[0][2]])

    def face_count(self) -> int:
        return self._faces()[0]

    def fixed(self) -> bool:
        """Whether the file has no faces, or only faces of three corners and nothing behind them."""
        count, kinds = self._faces()
        start = self.start + self.vertex_count * self.vertex.itemsize
        if start > self.size:
            raise ValueError("PLY data is shorter than announced")
        if count == 0:
            return True
        return len(self.elements) == 2 and self.size - start == count * np.dtype([("n", kinds[0]), ("v", kinds[1], 3)]).itemsize

    def vertices(self, part: int, parts: int) -> Rows:
        if self.format == "ascii":
            names = [p[1] for p in self.elements[0][2]]
            if part == 0:
                yield from self._ascii(0, self.vertex_count, lambda w: [float(w[names.index(c)]) for c in "xyz"])
            return
        for low, high in _steps(*share(self.vertex_count, part, parts)):
            width = self.vertex.itemsize
            rows = np.frombuffer(_exactly(self.handle, self.start + low * width, (high - low) * width), self.vertex)
            yield low, np.column_stack([rows[c].astype(np.float32) for c in "xyz"])

    def faces(self, part: int, parts: int) -> Rows:
        count, kinds = self._faces()
        if count == 0:
            return
        if self.format == "ascii":
            if part == 0:
                yield from self._ascii(self.vertex_count, count, lambda w: [int(v) for v in w[1 : int(w[0]) + 1]], polygons=True)
            return
        start = self.start + self.vertex_count * self.vertex.itemsize
        triangle = np.dtype([("n", kinds[0]), ("v", kinds[1], 3)])
        fixed = len(self.elements) == 2 and self.size - start == count * triangle.itemsize
        if fixed:
            for low, high in _steps(*share(count, part, parts)):
                raw = _exactly(self.handle, start + low * triangle.itemsize, (high - low) * triangle.itemsize)
                rows = np.frombuffer(raw, triangle)
                if (rows["n"] != 3).any():
                    raise ValueError("PLY faces of mixed sizes")
                yield low, rows["v"].astype(np.int64)
        elif part == 0:
            yield from self._mixed(start, count, kinds)

    def _mixed(self, start: int, count: int, kinds) -> Rows:
        size_type, index_type = np.dtype(kinds[0]), np.dtype(kinds[1])
        self.handle.seek(start)
        face, polygons = 0, []
        for _ in range(count):
            corners = int(np.frombuffer(self.handle.read(size_type.itemsize), size_type)[0])
            polygons.append(np.frombuffer(self.handle.read(corners * index_type.itemsize), index_type).tolist())
            if len(polygons[-1]) != corners:
                raise ValueError("PLY data is shorter than announced")
            if len(polygons) == BATCH_ROWS:
                rows = fan(polygons)
                yield face, rows
                face, polygons = face + len(rows), []
        yield face, fan(polygons)

    def _ascii(self, skip: int, count: int, parse, polygons: bool = False) -> Rows:
        self.handle.seek(self.start)
        first, rows = 0, []
        for number, line in enumerate(_lines(self.handle)):
            if number < skip:
                continue
            if number >= skip + count:
                break
            rows.append(parse(line.split()))
            if len(rows) == BATCH_ROWS:
                block = fan(rows) if polygons else np.asarray(rows, np.float32)
                yield first, block
                first, rows = first + len(block), []
        if rows:
            yield first, fan(rows) if polygons else np.asarray(rows, np.float32)


def _lines(handle) -> Iterator[str]:
    """Lines of an open file from its current position, in bounded memory."""
    rest = b""
    while block := handle.read(1 << 20):
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            yield line.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


# --- OBJ and STL -------------------------------------------------------------------------------------------


class Obj:
    """Vertices in file order; polygons as triangle fans; negative indices count back from the last vertex."""

    def __init__(self, handle, size: int):
        self.handle = handle

    def vertices(self, part: int, parts: int) -> Rows:
        yield from self._rows(part, lambda words, seen: [words[1:4]] if words[0] == "v" else [], np.float32)

    def faces(self, part: int, parts: int) -> Rows:
        def fans(words, seen):
            if words[0] != "f":
                return []
            numbers = [int(w.split("/", 1)[0]) for w in words[1:]]
            return fan([[n - 1 if n > 0 else seen + n for n in numbers]]).tolist()

        yield from self._rows(part, fans, np.int64)

    def _rows(self, part: int, parse, dtype) -> Rows:
        if part:
            return
        self.handle.seek(0)
        first, rows, seen = 0, [], 0
        for line in _lines(self.handle):
            words = line.split()
            if not words:
                continue
            rows += parse(words, seen)
            seen += words[0] == "v"
            if len(rows) >= BATCH_ROWS:
                yield first, np.asarray(rows, dtype)
                first, rows = first + len(rows), []
        if rows:
            yield first, np.asarray(rows, dtype)


class Stl:
    """Three own vertices per facet. Binary files are read in equal shares, text files in one pass."""

    def __init__(self, handle, size: int):
        head = read_range(handle, 0, 84)
        self.handle = handle
        self.count = int.from_bytes(head[80:84], "little")
        self.binary = len(head) == 84 and size == 84 + self.count * STL_FACET.itemsize
        if not self.binary and not head.lstrip()[:5].lower() == b"solid":
            raise ValueError("not an STL file")

    def _points(self, part: int, parts: int) -> Rows:
        if self.binary:
            for low, high in _steps(*share(self.count, part, parts)):
                width = STL_FACET.itemsize
                rows = np.frombuffer(_exactly(self.handle, 84 + low * width, (high - low) * width), STL_FACET)
                yield 3 * low, rows["points"].reshape(-1, 3)
        elif part == 0:
            self.handle.seek(0)
            first, rows = 0, []
            for line in _lines(self.handle):
                words = line.split()
                if words[:1] == ["vertex"]:
                    rows.append([float(w) for w in words[1:4]])
                if len(rows) == 3 * BATCH_ROWS:
                    yield first, np.asarray(rows, np.float32)
                    first, rows = first + len(rows), []
            if rows:
                yield first, np.asarray(rows, np.float32)

    vertices = _points

    def faces(self, part: int, parts: int) -> Rows:
        for first, points in self._points(part, parts):
            yield first // 3, np.arange(first, first + len(points), dtype=np.int64).reshape(-1, 3)


PARSERS = {"ply": Ply, "obj": Obj, "stl": Stl}


class MeshReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.content = options["path"], options.get("content", "vertices")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self):
        return pack(size_splits(self.path, SUFFIXES, self.split_bytes))

    def read(self, group: FileGroup):
        schema = to_arrow_schema(MESH_FACES if self.content == "faces" else MESH_VERTICES)
        for split in group.splits:
            yield from self._read_split(split, schema)

    def _read_split(self, split: FileSplit, schema: pa.Schema):
        parser = PARSERS[split.name.rsplit(".", 1)[1].lower()]
        with open_file(split.path) as handle:
            rows = getattr(parser(handle, split.size), self.content)(split.part, split.parts)
            for first, block in rows:
                block = block.astype(np.int64 if self.content == "faces" else np.float32)
                ids = np.arange(first, first + len(block), dtype=np.int64)
                columns = [pa.repeat(split.name, len(block)), pa.array(ids)]
                columns += [pa.array(np.ascontiguousarray(block[:, n])) for n in range(3)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


class MeshFiles(MeshReader):
    """One record per file of any name: its size, and the reason if it is no mesh that can be read."""

    def partitions(self):
        return [s for s in size_splits(self.path, ("",), self.split_bytes) if s.part == 0]

    def read(self, split: FileSplit):
        row = {"mesh_id": split.name, "size": split.size}
        suffix = split.name.rsplit(".", 1)[-1].lower()
        try:
            if suffix not in PARSERS:
                raise ValueError(f"unsupported mesh format {suffix!r}")
            with open_file(split.path) as handle:
                PARSERS[suffix](handle, split.size)
        except (ValueError, KeyError, IndexError, OSError) as error:
            row["error"] = f"{type(error).__name__}: {error}"
        yield pa.RecordBatch.from_pylist([row], schema=_MESHES)


class MeshDataSource(DataSource):
    """Vertices of mesh files below a folder, with option content=faces their triangles, with content=files the files."""

    @classmethod
    def name(cls) -> str:
        return "mesh"

    def schema(self) -> T.StructType:
        return {"faces": MESH_FACES, "files": MESHES}.get(self.options.get("content"), MESH_VERTICES)

    def reader(self, schema: T.StructType) -> MeshReader:
        return (MeshFiles if self.options.get("content") == "files" else MeshReader)(self.options, schema)
