"""What several operators share: tables, folds, Arrow tasks, word and code point hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the word and code point hashes, and the finaliser's shifts and multipliers.
STEP = np.uint64(0x9E3779B97F4A7C15)
FINISH = ((np.uint64(32), np.uint64(0xD6E8FEB86659FD93)), (np.uint64(29), np.uint64(0xC2B2AE3D27D4EB4F)))
#: Bytes of text that a task handles at a time.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sliced(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about SLICE_BYTES, so that long texts do not add up; one text may exceed it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(sizes(batch))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_sizes(column: str) -> Callable[[pa.RecordBatch], np.ndarray]:
    def sizes(batch: pa.RecordBatch) -> np.ndarray:
        import pyarrow.compute as pc

        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        return lengths.to_numpy(zero_copy_only=False).astype(np.int64)

    return sizes


def add_columns(
    df: DataFrame, text: str, keep: tuple[str | Column, ...], added: list[tuple[str, str]], function: Callable[[list], list[pa.Array]]
) -> DataFrame:
    """The columns of ``keep`` and those ``added`` (name, type), which ``function`` finds from the texts of a bounded slice.

    Arrow tasks without a shuffle. A kept column must not have the name of an added one.
    """
    kept = df.select(*keep)
    names = kept.columns
    if clash := set(names) & {name for name, _ in added}:
        raise ValueError(f"columns {sorted(clash)} are kept and added")
    rows = kept if text in names else df.select(*keep, F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, text_sizes(text)):
            columns = [part.column(n) for n in names] + function(part.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(name for name, _ in added)])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"{name} {kind}" for name, kind in added]
    return rows.mapInArrow(run, ", ".join(schema))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Finalised 64-bit hashes: every input bit reaches the high bits."""
    for shift, factor in FINISH:
        hashes = (hashes ^ (hashes >> shift)) * factor
    return hashes ^ (hashes >> np.uint64(32))


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` codes; of the whole sequence if it is shorter, none if it is empty."""
    if not len(codes):
        return np.empty(0, np.uint64)
    width = min(width, len(codes))
    count = len(codes) - width + 1
    total = np.full(count, width, np.uint64)
    for offset in range(width):
        total = total * STEP + codes[offset : offset + count]
    return mixed(total)


def word_shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; words are runs without ASCII white space, A-Z lowered."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(windows(codes, width))


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Remembered:
    """Bytes found for keys, kept in two generations: a full one becomes the older one, whose keys move on when met again.

    Results never depend on what is remembered; at most 2 * ``limit`` keys and those of one text are held.
    """

    def __init__(self, find: Callable[[list], list[bytes]], limit: int) -> None:
        self._find, self._limit = find, limit
        self._known: dict = {}
        self._older: dict = {}

    def joined(self, keys: list) -> bytes:
        """The bytes of all keys in order."""
        known, missing = self._known, []
        for key in {k for k in keys if k not in known}:
            value = self._older.get(key)
            if value is None:
                missing.append(key)
            else:
                known[key] = value
        if missing:
            known.update(zip(missing, self._find(missing), strict=True))
        found = b"".join(map(known.__getitem__, keys))
        if len(known) > self._limit:
            self._known, self._older = {}, known
        return found
