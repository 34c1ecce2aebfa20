"""Importance resampling of documents towards a target corpus by hashed word and word-pair features."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxspark.llm.common import sliced, text_sizes
from voxspark.session import discard, settle

#: Bytes of text whose words are held at a time.
CHUNK = 4 << 20
#: A-Z become a-z, bytes of words stay, all others become spaces; the second table keeps line breaks.
_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
WORDS = bytes(b if b in _WORD else 0x20 for b in _LOWER)
LINES = WORDS[:0x0A] + b"\n" + WORDS[0x0B:]


def _byte_table() -> np.ndarray:
    """CRC-32 of one byte each, by its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


def _zero_tables(longest: int) -> np.ndarray:
    """[n, k, b]: what n zero bytes make of the value b in byte k of a CRC; a CRC is the exclusive or of its four bytes' parts."""
    byte = _byte_table()
    steps = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(longest):
        steps.append(byte[steps[-1] & 0xFF] ^ steps[-1] >> 8)
    return np.stack(steps)


LONGEST = 64
_BYTE, _ZEROS = _byte_table(), _zero_tables(LONGEST)


def _moved(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRCs moved on by numbers of zero bytes."""
    crc, left = crc.copy(), zeros
    while len(crc):
        step = np.minimum(left, LONGEST)
        crc = _ZEROS[step, 0, crc & 0xFF] ^ _ZEROS[step, 1, crc >> 8 & 0xFF] ^ _ZEROS[step, 2, crc >> 16 & 0xFF] ^ _ZEROS[step, 3, crc >> 24]
        left = left - step
        if not left.any():
            break
    return crc


def pair_crc(first: np.ndarray, second: np.ndarray, second_length: np.ndarray) -> np.ndarray:
    """crc32 of "first second" from the crc32 of both words: a CRC of joined bytes follows from those of its parts."""
    spaced = first ^ np.uint32(0xFFFFFFFF)
    spaced = _BYTE[(spaced ^ np.uint32(0x20)) & 0xFF] ^ spaced >> 8 ^ np.uint32(0xFFFFFFFF)
    return _moved(spaced, second_length) ^ second


def _chunks(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """Parts of a text of about CHUNK bytes; a later part begins with the last word of the part before it, and says so."""
    start, size = 0, CHUNK
    while start + size < len(text):
        end = start + size
        held = text[start : max(start, text.rfind(b" ", start, end), text.rfind(b"\n", start, end))].rstrip()
        begin = start + max(held.rfind(b" "), held.rfind(b"\n")) + 1
        if begin <= start:  # no second word ends here yet
            size *= 2
            continue
        yield text[start : start + len(held)], start > 0
        start, size = begin, CHUNK
    yield text[start:], start > 0


@dataclass
class Features:
    """Buckets of the single words and of the word pairs of several texts, and which text each is of."""

    words: np.ndarray
    words_of: np.ndarray
    pairs: np.ndarray
    pairs_of: np.ndarray

    def together(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate((self.words, self.pairs)), np.concatenate((self.words_of, self.pairs_of))


def features(texts: list[bytes | None], buckets: int) -> Iterator[Features]:
    """Features of translated texts, in groups of parts that hold about CHUNK bytes; a long text spans several groups."""
    parts: list[list[bytes]] = []
    owners: list[int] = []
    repeated: list[bool] = []
    held = 0
    for number, text in enumerate(texts):
        for part, again in _chunks(text or b""):
            words = part.split()
            if words:
                parts.append(words)
                owners.append(number)
                repeated.append(again)
            held += len(part)
            if held >= CHUNK:
                yield _features(parts, owners, repeated, buckets)
                parts, owners, repeated, held = [], [], [], 0
    if parts:
        yield _features(parts, owners, repeated, buckets)


def _features(parts: list[list[bytes]], owners: list[int], repeated: list[bool], buckets: int) -> Features:
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    words = [word for part in parts for word in part]
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    part = np.repeat(np.arange(len(parts)), counts)
    owner = np.repeat(np.array(owners, np.int64), counts)
    new = np.ones(len(words), bool)
    new[(np.cumsum(counts) - counts)[np.array(repeated, bool)]] = False
    inside = np.flatnonzero(part[1:] == part[:-1]) if len(words) else np.empty(0, np.int64)
    pairs = pair_crc(crc[inside], crc[inside + 1], length[inside + 1])
    return Features((crc[new] % buckets).astype(np.int64), owner[new], (pairs % buckets).astype(np.int64), owner[inside])


def _octets(column: pa.Array, table: bytes) -> list[bytes | None]:
    return [None if t is None else t.translate(table) for t in column.cast(pa.binary()).to_pylist()]


def _told(total: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(total)
    return pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])


def _line_counts(lines: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of the features of distinct lines, found once a line and taken as often as it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches, text_sizes("line")):
            times = batch.column("times").to_numpy()
            for found in features(_octets(batch.column("line"), WORDS), buckets):
                bucket, owner = found.together()
                order = np.argsort(bucket, kind="stable")
                bucket, weight = bucket[order], times[owner[order]]
                if len(bucket):
                    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    total[bucket[starts]] += np.add.reduceat(weight, starts)
        yield _told(total)

    return lines.mapInArrow(count, "bucket int, n long")


def _line_ends(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """First and last word of every line that has a word."""
    for line in text.split(b"\n"):
        line = line.strip()
        if line:
            yield line[: line.find(b" ")] if b" " in line else line, line[line.rfind(b" ") + 1 :]


def _crossing_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of the word pairs that a line break separates: the last word before it and the first one after it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches, text_sizes("text")):
            before: list[bytes] = []
            after: list[bytes] = []
            for text in _octets(batch.column("text"), LINES):
                last = None
                for first, end in _line_ends(text):
                    if last is not None:
                        before.append(last)
                        after.append(first)
                    last = end
            crc = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) for words in (before, after)]
            pairs = pair_crc(*crc, np.fromiter(map(len, after), np.int64, len(after)))
            total += np.bincount(pairs % buckets, minlength=buckets)
        yield _told(total)

    return texts.mapInArrow(count, "bucket int, n long")


def feature_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket's features occur in all texts, repeats counted; ``texts`` has a column ``text``.

    Texts are cut into lines at line breaks, which are never part of a word. Equal lines are counted once and their
    features taken as often as the line occurs; word pairs across a line break are added from the texts themselves.
    Tasks sum up their buckets, so at most tasks x buckets rows are shuffled and ``buckets`` rows come to the driver.
    """
    known = texts.select("text").where(F.col("text").isNotNull())
    lines = known.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    lines = lines.groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    crossing = _crossing_counts(known.where(F.col("text").contains("\n")), buckets)
    summed = _line_counts(lines, buckets).unionByName(crossing).groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in summed.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of a bucket's smoothed share of the target over that of the source)."""
    s_all, t_all, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def weighted(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the floored mean of the gains over its features, 0 without any."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_sizes("text")):
            rows = batch.num_rows
            words, count, total = (np.zeros(rows, np.int64) for _ in range(3))
            for found in features(_octets(batch.column("text"), WORDS), len(gain)):
                words += np.bincount(found.words_of, minlength=rows)
                for bucket, owner in ((found.words, found.words_of), (found.pairs, found.pairs_of)):
                    count += np.bincount(owner, minlength=rows)
                    total += np.bincount(owner, gain[bucket], rows).astype(np.int64)  # whole numbers below 2^53
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            columns = [batch.column("doc_id"), *map(pa.array, (words, count, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return documents.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(
    documents: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), least_words: int = 20, buckets: int = 10_000, seed: int = 7, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; drawn ones are ranked 1, 2, 3...

    Words are runs of digits, letters a-z (A-Z are lowered) and characters beyond ASCII; features are single words and
    pairs of consecutive words of the whole text, repeats counted. A bucket's gain tells how much commoner its features
    are in ``target`` than in ``documents``; a document's weight is the floored mean of its features' gains, and its score
    adds Gumbel noise from sha256 of ``seed:doc_id``, so the highest scores are a draw without replacement in proportion
    to exp(weight / 1000). Of the N documents with ``least_words`` words, floor(share * N) highest scores are drawn, ties
    to the smaller doc_id.

    Ranks come from positions in a sort by ranges of (score, doc_id, place), so that neither a score nor a repeated id
    gathers in one task; offsets are a row a task. Null and empty texts have no features and weight 0. Repeated rows are
    documents of their own, with equal scores and following ranks. A null doc_id has no noise: its score is null and it
    is not drawn, nor counted in N. An empty table gives no rows; an empty target leaves gains of S alone. Other columns
    are not read.
    """
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gain = gains(feature_counts(source, buckets), feature_counts(target.select(F.col(text).alias("text")), buckets))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0))))
    scored = settle(
        weighted(source, gain)
        .withColumn("score", F.col("weight") + noise)
        .withColumn("place", F.monotonically_increasing_id())
    )
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    drawn = scored.where(able).count() * share[0] // share[1]
    keys = (F.desc("score"), F.asc("doc_id"), F.asc("place"))
    placed = settle(
        scored.where(able)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "n_features", "weight", "score")
        .withColumn("position", F.monotonically_increasing_id())
        .withColumn("task", F.shiftright("position", 33).cast("int"))
    )
    runs = placed.groupBy("task").agg(F.count(F.lit(1)).alias("rows"), F.min("position").alias("first"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("task", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    rank = F.col("position") - F.col("first") + F.col("offset") + 1
    ranked = placed.join(offsets, "task").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    others = scored.where(~F.coalesce(able, F.lit(False))).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others).withColumnRenamed("doc_id", doc_id)
