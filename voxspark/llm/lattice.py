"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected to eight dimensions by random orthonormal rows, once per table, and decoded to the nearest
point of the E8 lattice. Vectors meet in cells of equal label: each stays in its own cell and visits the nearest
neighbouring cells. Cosines of those that meet are computed in double precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import STEP, mixed
from voxspark.llm.components import components
from voxspark.session import settle

#: Documented parameters: tables, lattice blocks of eight projections in a cell, neighbouring cells that a vector visits, lattice scale in units of the distance at the
#: threshold after projection, and vectors of a cell that one task compares with as many others.
TABLES = 6
BLOCKS = 2
VISITS = 3
SCALE = 2.1
BLOCK = 1024


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            vector = np.zeros(8)
            vector[i], vector[j] = a, b
            found.append(vector)
    for signs in itertools.product((0.5, -0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            found.append(np.array(signs))
    return np.array(found)


def _nearest_d8(points: np.ndarray) -> np.ndarray:
    """Nearest vectors of whole numbers with an even sum."""
    near = np.rint(points)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    if len(odd):
        gap = points[odd] - near[odd]
        worst = np.abs(gap).argmax(axis=1)
        near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def nearest(points: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of each row: the better of D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(points), _nearest_d8(points - 0.5) + 0.5
    closer = ((points - half) ** 2).sum(axis=1) < ((points - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def projections(dimensions: int, tables: int, blocks: int, seed: int = 11) -> np.ndarray:
    """(tables, dimensions, 8 * blocks): random orthonormal columns; missing dimensions are padded with zeros."""
    random = np.random.default_rng(seed)
    found = np.zeros((tables, dimensions, 8 * blocks))
    for one in found:
        columns = min(8 * blocks, dimensions)
        one[:, :columns] = np.linalg.qr(random.normal(size=(dimensions, columns)))[0]
    return found


def _key(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the doubled, whole-numbered coordinates."""
    total = np.zeros(len(points), np.uint64)
    for column in np.rint(points * 2).astype(np.int64).astype(np.uint64).T:
        total = (total + column) * STEP
    return mixed(total).view(np.int64)


def cells(vectors: np.ndarray, threshold: float, tables: int = TABLES, blocks: int = BLOCKS, visits: int = VISITS, scale: float = SCALE) -> np.ndarray:
    """(vectors, tables, 1 + visits): key of the own cell, then of the neighbouring cells nearest to the vector."""
    dimensions = vectors.shape[1]
    unit = np.sqrt(2 - 2 * threshold) * np.sqrt(8 / max(dimensions, 8)) * scale
    around = neighbours()
    found = np.empty((len(vectors), tables, 1 + visits), np.int64)
    for table, matrix in enumerate(projections(dimensions, tables, blocks)):
        points = vectors @ matrix / unit
        own = np.concatenate([nearest(points[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
        found[:, table, 0] = _key(own)
        # All steps have the same length, so the nearest cell lies in the direction of the largest product.
        gap = points - own
        along = np.concatenate([gap[:, 8 * b : 8 * b + 8] @ around.T for b in range(blocks)], axis=1)
        best = np.argpartition(-along, visits - 1, axis=1)[:, :visits] if visits else np.empty((len(own), 0), int)
        for visit in range(visits):
            block, step = best[:, visit] // len(around), around[best[:, visit] % len(around)]
            there = own.copy()
            for b in range(blocks):
                there[block == b, 8 * b : 8 * b + 8] += step[block == b]
            found[:, table, 1 + visit] = _key(there)
    return found


def usable(vector: str) -> Column:
    """True for a vector without null or non-finite components that is not zero or empty."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~wrong & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(column), -1)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # keeps tiny and huge components in range
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _first_meeting(own: np.ndarray, keys: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Whether pairs (i, j) meet in this cell and nowhere before it, so that each pair counts once over all cells."""
    at_j = (keys[i] == own[j][:, :, None]).any(axis=2)  # i comes to the own cell of j
    at_i = (keys[j] == own[i][:, :, None]).any(axis=2)
    earlier = (at_i | at_j)[:, :table].any(axis=1)
    top = np.iinfo(np.int64).max
    here = np.minimum(np.where(at_i[:, table], own[i, table], top), np.where(at_j[:, table], own[j, table], top))
    return ~earlier & (here == cell)


def _roots(count: int, edges: np.ndarray) -> np.ndarray:
    """Of each row, the least row that it is connected with."""
    root = np.arange(count)
    while True:
        a, b = root[edges[0]], root[edges[1]]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root != root[root]).any():
            root = root[root]


def _compare(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links counted here, an id it is connected with here) of one cell, or of two blocks of a large cell."""
    ids, copies, block = (group.column(n).to_numpy() for n in ("id", "copies", "block"))
    table, cell = int(group.column("table")[0].as_py()), int(group.column("cell")[0].as_py())
    keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), TABLES, 1 + VISITS)
    vectors = units(group.column("vector").combine_chunks())
    links, edges = np.zeros(len(ids), np.int64), [np.empty((2, 0), np.int64)]
    two = block.min() != block.max()
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    for start in range(0, len(left), 256):
        part = left[start : start + 256]
        a, b = np.nonzero(vectors[part] @ vectors[right].T >= threshold)
        i, j = part[a], right[b]
        if not two:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            first = _first_meeting(keys[:, :, 0], keys, p, q, table, cell)
            p, q = p[first], q[first]
            links += (np.bincount(p, copies[q], len(ids)) + np.bincount(q, copies[p], len(ids))).astype(np.int64)
            edges.append(np.stack([p, q]))
    return ids, links, ids[_roots(len(ids), np.concatenate(edges, axis=1))]


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal values in ``names``, over batch borders; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
        if last is not None and keys[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        begin = 0
        for start in (i for i in range(1, len(keys)) if keys[i] != keys[i - 1]):
            yield pa.Table.from_batches([*held, batch.slice(begin, start - begin)])
            held, begin = [], start
        held.append(batch.slice(begin))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def near_vectors(df: DataFrame, threshold: float, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: vectors of equal, non-null label whose cosine reaches the threshold.

    Equal vectors of a label are compared once and counted as often as they occur. Cells of more than BLOCK vectors are
    split into blocks, and every two blocks meet in a task of their own, so no cell is cut and none grows beyond a task.
    A pair that meets in several cells counts in the first. Vectors that are null, empty, zero or hold a null or
    non-finite component, vectors of another length than their partner and rows of null label or null id link with
    nothing and keep their own id. Ids must be unique whole numbers. Other columns are not read.
    """
    source = df.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    fit = usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull()
    good = source.where(fit)
    unique = settle(good.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    members = good.join(unique, ["label", "vector"]).select("id", "rep", "copies")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy()
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                keys = cells(units(part.column("vector")), threshold).reshape(len(part), -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=[*part.schema.names, "keys"])

    kind = unique.schema["vector"].dataType.simpleString()
    rows = unique.select(F.col("rep").alias("id"), "label", "copies", "vector")
    vectors = settle(rows.mapInArrow(keyed, f"id long, label string, copies long, vector {kind}, keys array<long>"))
    width = 1 + VISITS
    visits = vectors.select("id", "label", F.size("vector").alias("length"), F.posexplode("keys").alias("at", "cell")).select(
        "id", "label", "length", F.floor(F.col("at") / width).cast("int").alias("table"), "cell", (F.col("at") % width == 0).alias("owner")
    )
    place = ["label", "length", "table", "cell"]
    busy = visits.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.max("owner").alias("owned")).where("n > 1 AND owned")
    # Of a cell of b blocks, a row goes to b pairs of blocks; most cells are one block, which is paired with itself.
    met = (
        visits.join(busy, place)
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", *place, "block", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"))
    )
    group = [*place, "b0", "b1"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, group):
            found = _compare(part, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "links", "root"])

    met = met.join(vectors.drop("label"), "id").repartition(*group).sortWithinPartitions(*group)
    found = settle(met.mapInArrow(compared, "id long, links long, root long").where("links > 0 OR id <> root"))
    counted = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    # A rep is the least id of its equal vectors, so the least rep of a component is its least id.
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    told = (
        members.join(counted, "rep", "left")
        .join(joined, "rep", "left")
        .select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    alone = source.where(~fit).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return told.unionByName(alone).select(F.col("id").alias(id_column), "n_links", "component_id", kept)
