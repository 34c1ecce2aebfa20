"""Exact k-means over whole numbers by Shallot search: bounded vectors, few distances, integer comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.session import discard, settle

#: Bounds are distances in doubles; a comparison of two must hold by this share before it saves a distance.
SLACK = 1e-9
#: Largest whole number of a component: squared distances of 64 such components stay below 2^62.
LARGEST = 1 << 27
#: Vectors that a task handles at a time.
BATCH = 1 << 14

STATE = "id long, v array<int>, cluster int, second int, upper double, lower double, members long, sums array<long>"


def squared(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two whole-number matrices."""
    gaps = points - centers
    return np.einsum("ij,ij->i", gaps, gaps)


@dataclass(frozen=True)
class Layout:
    """What a round needs to know of its centroids: their mutual distances, each one's neighbours by rising distance,
    and how far each moved since the last round."""

    centers: np.ndarray
    apart: np.ndarray
    neighbours: np.ndarray
    drift: np.ndarray

    @staticmethod
    def of(centers: np.ndarray, previous: np.ndarray | None = None) -> Layout:
        count = len(centers)
        apart = np.sqrt(np.stack([squared(centers, np.broadcast_to(c, centers.shape)) for c in centers]).astype(float))
        ranked = np.argsort(apart + np.where(np.eye(count, dtype=bool), -1.0, 0.0), axis=1, kind="stable")
        moved = np.zeros(count) if previous is None else np.sqrt(squared(centers, previous).astype(float))
        return Layout(centers, apart, ranked[:, 1:], moved)


@dataclass
class Bounds:
    """Of every vector: its centroid, the second nearest when it was last looked for, an upper bound of the distance to
    the first and a lower bound of that to any other."""

    cluster: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def scan_all(points: np.ndarray, layout: Layout) -> Bounds:
    """The two nearest centroids of every vector; of equally near ones the smaller number comes first."""
    count = len(points)
    found = Bounds(np.zeros(count, np.int32), np.zeros(count, np.int32), np.zeros(count), np.full(count, np.inf))
    best, other = squared(points, layout.centers[0]), np.full(count, np.iinfo(np.int64).max)
    for c in range(1, len(layout.centers)):
        _place(found, slice(None), best, other, np.full(count, c, np.int32), squared(points, layout.centers[c]))
    found.upper = np.sqrt(best.astype(float))
    if len(layout.centers) > 1:
        found.lower = np.sqrt(other.astype(float))
    return found


def _place(bounds: Bounds, rows, best: np.ndarray, other: np.ndarray, number: np.ndarray, distance: np.ndarray) -> None:
    """Put a centroid with its distance where it belongs among the two nearest of ``rows``; best and other are updated."""
    cluster, second, nearest, next_one = bounds.cluster[rows], bounds.second[rows], best[rows], other[rows]
    first = (distance < nearest) | ((distance == nearest) & (number < cluster))
    later = ~first & (distance < next_one)
    second = np.where(first, cluster, np.where(later, number, second))
    next_one = np.where(first, nearest, np.where(later, distance, next_one))
    bounds.cluster[rows], bounds.second[rows] = np.where(first, number, cluster), second
    best[rows], other[rows] = np.where(first, distance, nearest), next_one


def shallot(points: np.ndarray, bounds: Bounds, layout: Layout) -> Bounds:
    """The bounds after the centroids moved; only vectors whose bounds do not settle it are compared with centroids.

    Such a vector is compared with the two it remembers and scans the neighbours of the closer one, nearest first. A
    centroid farther from that one than the vector's distance to it plus that to its second nearest cannot become
    either, and that ball shrinks with every better second. Equally near centroids are never cut off.
    """
    centers, count = layout.centers, len(layout.centers)
    if count == 1:
        return bounds
    order = np.argsort(layout.drift)
    others = np.where(np.arange(count) == order[-1], layout.drift[order[-2]], layout.drift[order[-1]])
    bounds.upper = bounds.upper + layout.drift[bounds.cluster]
    bounds.lower = np.maximum(bounds.lower - others[bounds.cluster], 0.0)
    half = layout.apart[np.arange(count), layout.neighbours[:, 0]] / 2
    limit = np.maximum(bounds.lower, half[bounds.cluster])
    open_rows = np.flatnonzero(bounds.upper * (1 + SLACK) >= limit)
    exact = squared(points[open_rows], centers[bounds.cluster[open_rows]])
    bounds.upper[open_rows] = np.sqrt(exact.astype(float))
    still = bounds.upper[open_rows] * (1 + SLACK) >= limit[open_rows]
    rows, best = open_rows[still], exact[still]
    if not len(rows):
        return bounds

    part = Bounds(bounds.cluster[rows], bounds.second[rows], bounds.upper[rows], bounds.lower[rows])
    mine = points[rows]
    remembered = part.second.copy()
    other = squared(mine, centers[remembered])
    closer = (other < best) | ((other == best) & (remembered < part.cluster))
    part.cluster, part.second = np.where(closer, part.second, part.cluster), np.where(closer, part.cluster, part.second)
    best, other = np.where(closer, other, best), np.where(closer, best, other)
    start, known, reach = part.cluster.copy(), part.second.copy(), np.sqrt(best.astype(float))
    active = np.arange(len(rows))
    for place in range(count - 1):
        candidate = layout.neighbours[start[active], place]
        ball = (reach[active] + np.sqrt(other[active].astype(float))) * (1 + SLACK)
        inside = layout.apart[start[active], candidate] <= ball
        active, candidate = active[inside], candidate[inside]
        if not len(active):
            break
        fresh = candidate != known[active]
        look, number = active[fresh], candidate[fresh].astype(np.int32)
        _place(part, look, best, other, number, squared(mine[look], centers[number]))
    bounds.cluster[rows], bounds.second[rows] = part.cluster, part.second
    bounds.upper[rows], bounds.lower[rows] = np.sqrt(best.astype(float)), np.sqrt(other.astype(float))
    return bounds


def whole_vectors(batch: pa.RecordBatch, components: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and floor(scale * x) of the vectors with exactly ``components`` components, none null or non-finite."""
    lengths = pc.fill_null(batch.column("vector").value_lengths(), -1).to_numpy(zero_copy_only=False)
    batch = batch.filter(pa.array(lengths == components))
    values = batch.column("vector").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, components)
    good = np.isfinite(values).all(axis=1)
    numbers = np.floor(values[good] * scale)
    if len(numbers) and np.abs(numbers).max() > LARGEST:
        raise OverflowError(f"a component beyond {LARGEST / scale:.0f} has no squared distance in 64 bits")
    return batch.column("id").filter(pa.array(good)), numbers.astype(np.int64)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.reshape(-1), kind))


def _rows(ids: pa.Array, points: np.ndarray, bounds: Bounds) -> pa.RecordBatch:
    none = pa.nulls(len(points), pa.int64()), pa.nulls(len(points), pa.list_(pa.int64()))
    numbers = (bounds.cluster.astype(np.int32), bounds.second.astype(np.int32), bounds.upper, bounds.lower)
    columns = [ids, _lists(points, pa.int32()), *map(pa.array, numbers), *none]
    return pa.RecordBatch.from_arrays(columns, names=["id", "v", "cluster", "second", "upper", "lower", "members", "sums"])


class _Sums:
    """Members and componentwise sums of the clusters of one task."""

    def __init__(self, clusters: int, components: int) -> None:
        self.members = np.zeros(clusters, np.int64)
        self.sums = np.zeros((clusters, components), np.int64)

    def add(self, points: np.ndarray, cluster: np.ndarray) -> None:
        self.members += np.bincount(cluster, minlength=len(self.members))
        for c in np.unique(cluster):
            self.sums[c] += points[cluster == c].sum(axis=0)

    def rows(self) -> pa.RecordBatch:
        used = np.flatnonzero(self.members)
        none = [pa.nulls(len(used), kind) for kind in (pa.int64(), pa.list_(pa.int32()))]
        gaps = [pa.nulls(len(used), kind) for kind in (pa.int32(), pa.float64(), pa.float64())]
        columns = [*none, pa.array(used.astype(np.int32)), *gaps, pa.array(self.members[used]), _lists(self.sums[used], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "v", "cluster", "second", "upper", "lower", "members", "sums"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            yield batch.slice(start, BATCH)


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components).astype(np.int64)


def _moved(state: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Every centroid's floored mean; those of empty clusters stay. Tasks have summed up: clusters x components rows come back."""
    parts = state.where("members IS NOT NULL")
    sums = parts.select("cluster", "members", F.posexplode("sums").alias("at", "part"))
    wide = sums.groupBy("cluster", "at").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("members", "part")))
    after = centers.copy()
    for row in wide.collect():
        after[row["cluster"], row["at"]] = int(row["part"]) // int(row["members"])
    return after


def shallot_clusters(
    df: DataFrame, clusters: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: int = 1, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors of exactly ``components`` components, none of them null, infinite or not a number; each component x
    becomes the whole number floor(scale * x). The vectors with the smallest sha256 of ``seed:id`` are the first
    centroids; if fewer are kept, there are fewer centroids. ``rounds`` times, every vector goes to its nearest centroid
    (squared distance, ties to the smaller number) and every non-empty centroid to the floored mean of its vectors; then
    vectors are assigned once more. All of it is exact: bounds only save distances.

    A round reads the vectors with their bounds from the shared folder and writes them anew, next to the sums of each
    task, so a lost executor costs its tasks and no shuffle carries vectors. Clusters of any size are summed in tasks.
    To the driver come clusters x components numbers a round, and centroids go out with the tasks.

    Repeated rows are clustered like others; repeated ids that are seeds are ordered by their vectors. A row of null id
    is clustered but is a seed only where no kept row has an id. No kept vector: no row. Other columns are not read. A component whose whole number
    is beyond 2^27 ends the job with an error, as squared distances would leave 64 bits.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"))

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            ids, points = whole_vectors(batch, components, scale)
            yield pa.RecordBatch.from_arrays([ids, _lists(points, pa.int32())], names=["id", "v"])

    named = source.mapInArrow(prepared, "id long, v array<int>").where("id IS NOT NULL")
    first = named.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "v").limit(clusters).collect()
    if not first:
        first = source.mapInArrow(prepared, "id long, v array<int>").orderBy("v").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], f"{id_column} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    layout = seeds = Layout.of(np.array([row["v"] for row in first], np.int64))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums(len(seeds.centers), components)
        for batch in _pieces(batches):
            ids, points = whole_vectors(batch, components, scale)
            bounds = scan_all(points, seeds)
            total.add(points, bounds.cluster)
            yield _rows(ids, points, bounds)
        yield total.rows()

    state = settle(source.mapInArrow(begin, STATE))
    for number in range(rounds):
        layout = Layout.of(_moved(state, layout.centers), layout.centers)
        if number < rounds - 1:
            state, old = settle(_assigned(state, layout, components, True)), state
            discard(old)
    final = settle(_assigned(state, layout, components, False))
    discard(state)

    sums = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    whole = sum(int(row["inertia"]) for row in sums)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in layout.centers]
    told = [(row["cluster"], int(row["inertia"]), whole, digests[row["cluster"]]) for row in sums]
    summary = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # A row a cluster, so the bound of the broadcast is the parameter.
    found = final.join(F.broadcast(summary), "cluster")
    return found.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigned(state: DataFrame, layout: Layout, components: int, going_on: bool) -> DataFrame:
    """The state after one more assignment; of the last one, only (id, cluster, distance)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums(len(layout.centers), components)
        for batch in _pieces(batches):
            points = _matrix(batch.column("v"), components)
            held = [batch.column(n).to_numpy(zero_copy_only=False).copy() for n in ("cluster", "second", "upper", "lower")]
            bounds = shallot(points, Bounds(*held), layout)
            if going_on:
                total.add(points, bounds.cluster)
                yield _rows(batch.column("id"), points, bounds)
            else:
                distance = squared(points, layout.centers[bounds.cluster])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bounds.cluster), pa.array(distance)], names=["id", "cluster", "distance"])
        if going_on:
            yield total.rows()

    rows = state.where("members IS NULL").select("id", "v", "cluster", "second", "upper", "lower")
    return rows.mapInArrow(step, STATE if going_on else "id long, cluster int, distance long")
