"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a text's shingles, so sketches of parts merge into the sketch of the whole.
Two sketches give estimates of resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import SLICE_BYTES, code_points, windows

#: Hashes kept, code points of a shingle, and bytes of a hash in the text form.
KEPT = 128
WIDTH = 8
HASH_BYTES = 6
#: Parts at most; beyond them the parts grow, which tasks stream through. Their borders come from about that many ids a part.
MAX_PARTS = 20_000
PART_SAMPLE = 32


def smallest(hashes: np.ndarray, k: int = KEPT) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 16 * k:
        bound = np.uint64(min(2**64 - 1, int(2.0**64 * 6 * k / len(hashes))))
        low = np.unique(hashes[hashes <= bound])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def sketch(text: str | None, k: int = KEPT, width: int = WIDTH) -> np.ndarray:
    """Sketch of a whole text: null as empty; shorter texts than a shingle count as one shingle, empty ones have none."""
    return smallest(windows(code_points(text), width) >> np.uint64(64 - 8 * HASH_BYTES) << np.uint64(64 - 8 * HASH_BYTES), k)


def merge(sketches: list[np.ndarray], k: int = KEPT) -> np.ndarray:
    """Sketch of all parts together."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.empty(0, np.uint64)


def packed(hashes: np.ndarray) -> str:
    """Text form: base64 of the hashes' leading bytes, ascending."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
    return base64.b64encode(octets.tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    octets = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, HASH_BYTES)
    whole = np.zeros((len(octets), 8), np.uint8)
    whole[:, :HASH_BYTES] = octets
    return whole.view(">u8").ravel().astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = KEPT) -> float:
    """Estimate of the shared part of both shingle sets together; two empty sketches are alike, one empty one is not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.intersect1d(np.intersect1d(a, b), union).size / union.size)


def distinct(a: np.ndarray, k: int = KEPT) -> float:
    """Estimate of the number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1.0) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = KEPT) -> float:
    """Estimate of the part of a's shingles that b has too; of an empty a, 1."""
    if not len(a):
        return 1.0
    both = distinct(merge([a, b], k), k) * resemblance(a, b, k)
    return min(1.0, both / distinct(a, k))


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many of the following text, or all of it."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def _cuts(rows: DataFrame, part_bytes: int) -> list[int]:
    """Ascending order values that exist in the rows and cut them into parts of near equal size; [0] is the least one.

    They are quantiles of the order values with the smallest hashes, about PART_SAMPLE of them for a part. A border only says
    which task meets a row, so results do not depend on the sample.
    """
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("order").alias("least")).first()
    if not total["rows"]:
        return []
    parts = int(max(1, min(total["bytes"] // part_bytes + 1, total["rows"], MAX_PARTS)))
    draw = (F.shiftright(F.xxhash64("order"), 11) + F.lit(1 << 52)).cast("double") / float(1 << 53)
    sample = rows.select("order").where(draw < PART_SAMPLE * parts / total["rows"]).distinct()
    found = np.sort(np.array([row["order"] for row in sample.collect()], np.int64))
    places = (np.arange(1, parts) * len(found) // parts).tolist() if len(found) else []
    return sorted({total["least"], *found[places].tolist()})


def fingerprint_edits(df: DataFrame, order: str = "doc_id", text: str = "text", k: int = KEPT, width: int = WIDTH, part_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: (order, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The texts are shuffled once, into parts of ascending ``order``. Each part also gets the first row of the next part
    (the last part: the first row of all), so that every task finds the row that follows each of its own, and streams.
    Null texts are empty texts; a null in ``order`` sorts first; rows with equal ``order`` follow each other by text.
    A single row is its own next. An empty table gives no rows. Other columns are not read.
    """
    kind = df.schema[order].dataType
    least = F.lit(-(2**63))
    rows = df.select(F.coalesce(F.col(order).cast("long"), least).alias("order"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = np.array(_cuts(rows, part_bytes), np.int64)
    parts = len(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = batch.column("order").to_numpy(zero_copy_only=False)
            part = np.searchsorted(cuts, orders, side="right") - 1
            first = np.flatnonzero(orders == cuts[part])
            take = np.concatenate((np.arange(len(orders)), first))
            parts_of = np.concatenate((part, (part[first] - 1) % parts)).astype(np.int32)
            extra = np.concatenate((np.zeros(len(orders), bool), np.ones(len(first), bool)))
            rows_of = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(parts_of), pa.array(extra), *rows_of.columns], names=["part", "extra", "order", "text"])

    dealt = rows.mapInArrow(deal, "part int, extra boolean, order long, text string")
    placed = dealt.repartitionByRange(max(parts, 1), "part").sortWithinPartitions("part", "extra", "order", "text")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the one after it: (part, extra, order, text, sketch)
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                row = (*row, sketch(row[3], k, width))
                if held is not None and not held[1] and held[0] == row[0]:
                    out.append(_described(held, row, k, width))
                held = row
            yield _batch(out)
            out = []

    shown = "order long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = placed.mapInArrow(follow, shown)
    value = F.when(F.col("order") != least, F.col("order")).cast(kind).alias(order)
    return found.select(value, *found.columns[1:])


def _described(row: tuple, following: tuple, k: int, width: int) -> tuple:
    text = edited(row[3], following[3])
    other = sketch(text, k, width)
    return (
        row[2],
        len(row[3]),
        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
        packed(row[4]),
        packed(other),
        resemblance(row[4], other, k),
        resemblance(row[4], following[4], k),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["order", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
