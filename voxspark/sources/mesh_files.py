"""Meshes of a table of files: every file is read by many tasks, text files too, and every entry gets a status."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxspark.schemas import MESH_FACES, MESH_VERTICES
from voxspark.session import settle
from voxspark.sources.files import SPLIT_BYTES, open_file, read_range
from voxspark.sources.mesh import BATCH_ROWS, PARSERS, Obj, Ply, Stl, fan

#: Heads of listed files: ``layout`` is text, records (equal shares of binary records) or whole (one pass).
HEADS = "mesh_id string, path string, suffix string, layout string, size long, start long, vertex_count long, face_count long, axes array<int>, error string"
SHARES = "mesh_id string, path string, suffix string, layout string, start long, vertex_count long, face_count long, axes array<int>, part int, parts int, low long, high long"
COUNTS = "mesh_id string, part int, lines long, vertices long, triangles long, error string"
FAULTS = (ValueError, KeyError, IndexError, OSError, OverflowError, UnicodeError, pa.ArrowException)
BLOCK = 1 << 20
#: What is read at first beyond a range, to find the end of its last line.
BEYOND = 1 << 10
#: Ends of lines; with a backslash before them the line goes on. A carriage return or a few may stand between.
NEWLINES, LINE_ENDS, LOOK_BACK = re.compile(rb"\n"), re.compile(rb"\\\r*\n|\n"), 16
ADDED = T.StructType([T.StructField("error", T.StringType())])


# --- lines of a byte range ------------------------------------------------------------------------------


def _joined(line: bytes) -> bool:
    """Whether a line goes on in the next one: it ends with a backslash."""
    return line.rstrip(b"\r").endswith(b"\\")


def text_lines(handle, low: int, high: int, continued: bool = False) -> Iterator[bytes]:
    """The lines that begin in a byte range, so that every line of a file is of exactly one of its ranges.

    A line may end beyond the range. With ``continued``, a line that ends with a backslash and its following lines are
    one line, which is of the range that its first byte is in. Memory holds one block and one line. Little more is read
    than the range and the rest of its last line, so all ranges of a file together cost about the file.
    """
    position = low
    if low:
        # The byte before the range tells whether a line begins at its first byte; with continued lines, the line
        # before it has to be looked at as well.
        position = _line_start(handle, low, high, continued)
    handle.seek(position)
    rest, start, held, at, beyond = b"", position, [], position, BEYOND
    while start < high or held:
        if at >= high:
            beyond *= 2
        block = handle.read(min(BLOCK, max(high - at, beyond)))
        if not block:
            break
        at += len(block)
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            if start >= high and not held:
                return
            start += len(line) + 1
            if continued and _joined(line):
                held.append(line.rstrip(b"\r")[:-1] + b" ")
                continue
            yield b"".join([*held, line])
            held = []
    if (rest or held) and (held or start < high):
        yield b"".join([*held, rest])


def _line_start(handle, low: int, high: int, continued: bool) -> int:
    """The first byte, from ``low`` on, at which a line begins; or any from ``high`` on if none begins before it."""
    at = max(0, low - LOOK_BACK)
    text, seen, more = read_range(handle, at, low - at), low - 1, BEYOND
    while True:
        for end in (LINE_ENDS if continued else NEWLINES).finditer(text):
            if end[0] == b"\n" and at + end.end() > seen:
                return at + end.end()
        seen = at + len(text)
        block = handle.read(min(BLOCK, more)) if seen < high else b""
        if not block:
            return seen
        at, text, more = max(at, seen - LOOK_BACK), text[-LOOK_BACK:] + block, 2 * more


# --- text formats ---------------------------------------------------------------------------------------


def _element_lines(row: dict, handle) -> Iterator[tuple[str, list[bytes]]]:
    """("v", coordinates) and ("f", corners) of the elements that a share of a text file holds, in order."""
    if row["suffix"] == "obj":
        for line in text_lines(handle, row["low"], row["high"], continued=True):
            words = line.split()
            if words and words[0] in (b"v", b"f"):
                yield words[0].decode(), words[1:]
    elif row["suffix"] == "stl":
        for line in text_lines(handle, row["low"], row["high"]):
            words = line.split()
            if words and words[0].lower() == b"vertex":
                yield "v", words[1:]
    else:
        number, vertices, end = row["line_start"], row["vertex_count"], row["vertex_count"] + row["face_count"]
        for line in text_lines(handle, max(row["low"], row["start"]), row["high"]):
            words = line.split()
            if not words:
                continue
            if number < vertices:
                yield "v", [words[axis] for axis in row["axes"]]
            elif number < end:
                yield "f", words[1 : int(words[0]) + 1]
            number += 1


def _count_share(row: dict) -> dict:
    told = {"mesh_id": row["mesh_id"], "part": row["part"], "lines": 0, "vertices": 0, "triangles": 0}
    try:
        with open_file(row["path"]) as handle:
            if "line_start" not in row:
                told["lines"] = sum(1 for line in text_lines(handle, max(row["low"], row["start"]), row["high"]) if line.strip())
                return told
            for kind, words in _element_lines(row, handle):
                if kind == "v":
                    told["vertices"] += 1
                else:
                    told["triangles"] += max(0, len(words) - 2)
    except FAULTS as error:
        told["error"] = f"{type(error).__name__}: {error}"
    return told


def _counted(shares: DataFrame, tasks: int) -> DataFrame:
    schema = to_arrow_schema(T.StructType.fromDDL(COUNTS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_count_share(row) for row in batch.to_pylist()], schema=schema)

    return settle(shares.repartition(tasks, "mesh_id", "part").mapInArrow(count, COUNTS))


def _text_vertices(row: dict, handle) -> Iterator[tuple[int, np.ndarray]]:
    first, rows = row["vertex_start"], []
    for kind, words in _element_lines(row, handle):
        if kind == "v":
            rows.append((float(words[0]), float(words[1]), float(words[2])))
            if len(rows) == BATCH_ROWS:
                yield first, np.asarray(rows, np.float32)
                first, rows = first + len(rows), []
    if rows:
        yield first, np.asarray(rows, np.float32)


def _text_faces(row: dict, handle) -> Iterator[tuple[int, np.ndarray]]:
    """Triangles of polygons as fans; negative corners of OBJ count back from the last vertex before the line, wherever
    in the file that is. STL has a face per three vertices, told by the share that holds its last one."""
    first, rows, seen = row["face_start"], [], row["vertex_start"]
    for kind, words in _element_lines(row, handle):
        if kind == "v":
            seen += 1
            if row["suffix"] == "stl" and seen % 3 == 0:
                rows.append((seen - 3, seen - 2, seen - 1))
        else:
            corners = [int(word.split(b"/", 1)[0]) for word in words]
            if row["suffix"] == "obj":
                corners = [n - 1 if n > 0 else seen + n for n in corners]
            rows += fan([corners]).tolist()
        if len(rows) >= BATCH_ROWS:
            yield first, np.asarray(rows, np.int64)
            first, rows = first + len(rows), []
    if rows:
        yield first, np.asarray(rows, np.int64)


# --- tables ---------------------------------------------------------------------------------------------


def _head(row: dict) -> dict:
    suffix = row["path"].rsplit(".", 1)[-1].lower()
    told = {**row, "suffix": suffix, "start": 0}
    try:
        if suffix not in PARSERS:
            raise ValueError(f"unsupported mesh format {suffix!r}")
        with open_file(row["path"]) as handle:
            told["size"] = size = handle.size()
            parsed = PARSERS[suffix](handle, size)
            told["layout"] = "records"
            if isinstance(parsed, Obj) or (isinstance(parsed, Stl) and not parsed.binary):
                told["layout"] = "text"
            elif isinstance(parsed, Ply):
                names = [p[1] for p in parsed.elements[0][2]]
                told.update(start=parsed.start, vertex_count=parsed.vertex_count, face_count=parsed.face_count(), axes=[names.index(c) for c in "xyz"])
                told["layout"] = "text" if parsed.format == "ascii" else "records" if parsed.fixed() else "whole"
    except FAULTS as error:
        told["error"] = f"{type(error).__name__}: {error}"
    return told


def read_heads(files: DataFrame) -> DataFrame:
    """Format, layout and announced counts of every listed mesh file (mesh_id, path), or the reason it is none."""
    schema = to_arrow_schema(T.StructType.fromDDL(HEADS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_head(row) for row in batch.to_pylist()], schema=schema)

    return files.select("mesh_id", "path").repartition("path").mapInArrow(read, HEADS)


def _shares(heads: DataFrame, split_bytes: int) -> DataFrame:
    parts = F.when(F.col("layout") == "whole", 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / split_bytes))).cast("int")
    edge = [F.floor(F.col("size") * (F.col("part") + n) / F.col("parts")).cast("long") for n in (0, 1)]
    usable = heads.where(F.col("error").isNull()).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return usable.withColumn("low", edge[0]).withColumn("high", edge[1]).select(*[c.split()[0] for c in SHARES.split(", ")])


def _starts(shares: DataFrame, counts: DataFrame, names: dict[str, str]) -> DataFrame:
    """Shares with the sums of counts over the shares of their file before them; a window has the shares of one file."""
    before = Window.partitionBy("mesh_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(counted).over(before), F.lit(0)).alias(start) for counted, start in names.items()]
    return shares.join(counts.select("mesh_id", "part", *sums), ["mesh_id", "part"])


def _binary(row: dict, handle, content: str) -> Iterator[tuple[int, np.ndarray]]:
    parsed = PARSERS[row["suffix"]](handle, handle.size())
    return getattr(parsed, content)(row["part"], row["parts"])


def _rows(shares: DataFrame, content: str, tasks: int) -> DataFrame:
    kinds, dtype = (MESH_FACES, np.int64) if content == "faces" else (MESH_VERTICES, np.float32)
    text: Callable = _text_faces if content == "faces" else _text_vertices
    fields = [T.StructField(f.name, f.dataType, f.name != "mesh_id") for f in kinds.fields]
    schema = T.StructType([*fields, *ADDED.fields])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with open_file(row["path"]) as handle:
                        blocks = text(row, handle) if row["layout"] == "text" else _binary(row, handle, content)
                        for first, block in blocks:
                            block = block.astype(dtype)
                            ids = pa.array(np.arange(first, first + len(block), dtype=np.int64))
                            columns = [pa.array(np.ascontiguousarray(block[:, n])) for n in range(3)]
                            yield pa.RecordBatch.from_arrays([pa.array([row["mesh_id"]] * len(block), pa.string()), ids, *columns, pa.nulls(len(block), pa.string())], schema=arrow)
                except FAULTS as error:
                    yield pa.RecordBatch.from_pylist([{"mesh_id": row["mesh_id"], "error": f"{type(error).__name__}: {error}"}], schema=arrow)

    return shares.repartition(tasks, "mesh_id", "part").mapInArrow(read, schema)


@dataclass(frozen=True)
class MeshSet:
    """Vertices and faces of the meshes that could be read whole, and a status for every listed file."""

    vertices: DataFrame
    faces: DataFrame
    statuses: DataFrame


def load_meshes(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> MeshSet:
    """Vertices (mesh_id, vertex_id, x, y, z) and triangles (mesh_id, face_id, a, b, c) of every listed PLY, OBJ and STL file.

    ``files`` has mesh_id and path. Text files are cut into byte ranges too: a first pass counts the elements of every
    range, sums over the ranges before it give the ids its elements begin with, and a second pass reads all ranges at
    once. Text PLY needs the numbers of lines first, to know which lines are faces. Binary PLY files with polygons of mixed
    sizes are the one layout read in a single pass a file.

    Statuses are (mesh_id, path, status, reason): loaded or failed. A file fails if its head or any range cannot be read,
    if it holds fewer elements than it announces, or if its id is listed more than once; other files are not touched by
    it. A text without any vertex is loaded and has no rows.
    """
    listed = files.select("mesh_id", "path")
    claimed = listed.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mesh_id")
    heads = settle(read_heads(listed.join(claimed, "mesh_id", "left_anti")))
    shares = settle(_shares(heads, split_bytes))
    # Fixed task counts: these rows are tiny and adaptive execution would merge them, but reading their bytes is not. They
    # follow the bytes, not the number of ranges: a task reads many ranges where these are small.
    total = heads.agg(F.sum("size")).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism * 4, -(-total // SPLIT_BYTES))
    text = shares.where("layout = 'text'")
    lines = _counted(text.where("suffix = 'ply'"), tasks)
    numbered = _starts(text.where("suffix = 'ply'"), lines, {"lines": "line_start"})
    numbered = settle(numbered.unionByName(text.where("suffix <> 'ply'").withColumn("line_start", F.lit(0).cast("long"))))
    counts = _counted(numbered, tasks)
    placed = _starts(numbered, counts, {"vertices": "vertex_start", "triangles": "face_start"})
    # An STL has no face lines: its faces are told by vertices, and begin with the number of whole ones before them.
    placed = placed.withColumn("face_start", F.when(F.col("suffix") == "stl", F.floor(F.col("vertex_start") / 3)).otherwise(F.col("face_start")))
    absent = {c: F.lit(0).cast("long") for c in ("line_start", "vertex_start", "face_start")}
    ready = settle(placed.unionByName(shares.where("layout <> 'text'").withColumns(absent)))
    vertices, faces = settle(_rows(ready, "vertices", tasks)), settle(_rows(ready, "faces", tasks))

    summed = counts.groupBy("mesh_id").agg(F.sum("vertices").alias("found"))
    short = summed.join(heads.where("layout = 'text'"), "mesh_id").where(F.col("found") < F.col("vertex_count"))
    lines_found = lines.groupBy("mesh_id").agg(F.sum("lines").alias("found"))
    cut = lines_found.join(heads, "mesh_id").where(F.col("found") < F.col("vertex_count") + F.col("face_count"))
    odd = summed.join(heads.where("layout = 'text' AND suffix = 'stl'"), "mesh_id").where(F.col("found") % 3 != 0)
    reasons = heads.where(F.col("error").isNotNull()).select("mesh_id", F.col("error").alias("reason"))
    for table in (lines, counts, vertices, faces):
        reasons = reasons.unionByName(table.where(F.col("error").isNotNull()).select("mesh_id", F.col("error").alias("reason")))
    for table in (short, cut, odd):
        reasons = reasons.unionByName(table.select("mesh_id", F.lit("fewer elements than the file needs").alias("reason")))
    reasons = reasons.unionByName(claimed.select("mesh_id", F.lit("duplicate mesh_id").alias("reason")))
    failures = settle(reasons.groupBy("mesh_id").agg(F.min("reason").alias("reason")))

    def good(table: DataFrame) -> DataFrame:
        return table.where(F.col("error").isNull()).drop("error").join(failures, "mesh_id", "left_anti")

    status = F.when(F.col("reason").isNull(), "loaded").otherwise("failed").alias("status")
    return MeshSet(good(vertices), good(faces), listed.join(failures, "mesh_id", "left").select("mesh_id", "path", status, "reason"))
