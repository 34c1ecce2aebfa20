"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed on Spark, one dense row of counts per task and language. The log-probability matrix (buckets x languages)
is broadcast in blocks of columns of a fixed size, batches are scored in numpy block by block, and the likeliest language of
all blocks wins. So the number of languages has no limit; each block of languages costs one pass over the texts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import STEP, add_columns, mixed, sliced, text_sizes

#: Documented parameters: hash buckets, n-gram widths, training documents (the smallest hashes of their ids), languages of a block.
BUCKET_BITS = 15
WIDTHS = (2, 3, 4)
TRAIN_DOCUMENTS = 20_000
BLOCK_LANGUAGES = 256
SMOOTHING = 0.5
#: Per document, n-grams are taken as that many independent observations at most, so that scores stay graded.
EVIDENCE = 256.0


@dataclass(frozen=True)
class LanguageBlock:
    """Some of the languages, in the order of their names."""

    languages: tuple[str, ...]
    prior: np.ndarray  # languages
    weights: np.ndarray  # buckets x languages, log probabilities


@dataclass(frozen=True)
class LanguageModel:
    """The blocks of all languages by name, each broadcast; the driver holds one of them at a time."""

    blocks: tuple[Broadcast, ...]


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(code).isalpha() for code in range(0x110000)), bool, 0x110000)


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters than letters made one space."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _letters()[codes]
    if not kinds.any():
        return np.empty(0, np.uint64)
    keep = kinds.copy()
    keep[1:] |= kinds[:-1]
    return np.concatenate(([32], np.where(kinds, codes, 32)[keep], [32])).astype(np.uint64)


def buckets(codes: np.ndarray) -> np.ndarray:
    """Bucket of every n-gram of the letters."""
    found = []
    for width in WIDTHS:
        count = len(codes) - width + 1
        if count <= 0:
            continue
        total = np.full(count, width, np.uint64)
        for offset in range(width):
            total = total * STEP + codes[offset : offset + count]
        found.append((mixed(total) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.empty(0, np.int32)


def fit_language(
    df: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", limit: int = TRAIN_DOCUMENTS, width: int = BLOCK_LANGUAGES
) -> LanguageModel:
    """Fit on at most about ``limit`` documents per language, those with the smallest hashes of ``order``.

    Rows without text or language are not used; without any, the model has no language and predicts ``und``. Rows repeated
    count as often as they occur. ``width`` languages make a block.
    """
    usable = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(order)).alias("hash")
    )
    sizes = {row["lang"]: row["n"] for row in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    names, total = sorted(sizes), sum(sizes.values())
    parts = [{n: sizes[n] for n in names[at : at + width]} for at in range(0, len(names), width)]
    blocks = (_fit_block(usable, part, total, limit) for part in parts)
    return LanguageModel(tuple(df.sparkSession.sparkContext.broadcast(block) for block in blocks if block.languages))


def _fit_block(usable: DataFrame, sizes: dict[str, int], total: int, limit: int) -> LanguageBlock:
    """The languages of ``sizes`` among ``total`` documents of all languages."""
    # A hash threshold per language keeps about ``limit`` of its rows without a sort.
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, limit / n))])
    position = (F.shiftright("hash", 11) + F.lit(1 << 52)).cast("double") / float(1 << 53)
    sample = usable.where(position < F.try_element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in sliced(batches, text_sizes("text")):
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts = totals.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
                counts += np.bincount(buckets(letters(value)), minlength=1 << BUCKET_BITS)
        names = sorted(totals)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([totals[n].tobytes() for n in names], pa.binary())], ["lang", "counts"])

    partial = sample.mapInArrow(count, "lang string, counts binary")
    # Partial sums meet in 32 tasks, and the driver adds one dense row per task and language.
    gathered = partial.repartition(F.pmod(F.monotonically_increasing_id(), F.lit(32)), "lang").mapInArrow(_sums, "lang string, counts binary")
    totals: dict[str, np.ndarray] = {}
    for row in gathered.toLocalIterator():
        counts = np.frombuffer(bytes(row["counts"]), np.int64)
        totals[row["lang"]] = totals.get(row["lang"], 0) + counts
    names = tuple(sorted(totals))
    if not names:
        return LanguageBlock((), np.empty(0), np.empty((1 << BUCKET_BITS, 0)))
    counts = np.stack([totals[n] for n in names], axis=1).astype(np.float64) + SMOOTHING
    documents = np.array([sizes[n] for n in names], np.float64)
    return LanguageBlock(names, np.log(documents / total), np.log(counts / counts.sum(axis=0)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, value in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            totals[name] = totals.get(name, 0) + np.frombuffer(value, np.int64)
    names = sorted(totals)
    yield pa.record_batch([pa.array(names, pa.string()), pa.array([totals[n].tobytes() for n in names], pa.binary())], ["lang", "counts"])


def classify(block: LanguageBlock, texts: list[str | None]) -> list[tuple[str | None, float | None, float | None]]:
    """Of each text the likeliest language of the block, its log-likelihood and the block's mass as a multiple of its
    likelihood; nulls without a letter."""
    out = []
    for text in texts:
        found = buckets(letters(text))
        if not len(found):
            out.append((None, None, None))
            continue
        distinct, times = np.unique(found, return_counts=True)
        likelihood = times @ block.weights[distinct]
        total = block.prior + likelihood * min(1.0, EVIDENCE / len(found))
        best = int(np.argmax(total))
        out.append((block.languages[best], float(total[best]), float(np.exp(total - total[best]).sum())))
    return out


def predict_language(df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``lang_pred`` and ``score`` of every row's whole text.

    ``score`` is the posterior among all learned languages; of equal ones the first by name wins. Null texts, texts without
    a letter and texts under a model without a language are ``und`` with score 0. Equal texts get equal results, an empty
    table stays empty, and columns that are not kept may have any name.
    """
    kept = df.select(*keep).columns
    if clash := set(kept) & {"lang_pred", "score"}:
        raise ValueError(f"columns {sorted(clash)} are kept and added")
    rows = df.select(*keep) if text in kept else df.select(*keep, F.col(text))
    found: list[str] = []
    for number, block in enumerate(model.blocks):
        last = number == len(model.blocks) - 1
        passed = tuple(kept) if last or text in kept else (*kept, text)
        added = [(f"_name{number}", "string"), (f"_most{number}", "double"), (f"_mass{number}", "double")]
        rows = add_columns(rows, text, (*passed, *found), added, _scorer(block))
        found += [name for name, _ in added]
    # The likeliest of the blocks, the first one of equal ones, and the masses of all as multiples of its likelihood.
    count = range(len(model.blocks))
    best = F.lit(None).cast("struct<most: double, place: int, name: string>")
    if model.blocks:
        best = F.array_max(F.array(*[F.struct(F.col(f"_most{i}").alias("most"), F.lit(-i).alias("place"), F.col(f"_name{i}").alias("name")) for i in count]))
    mass = sum((F.col(f"_mass{i}") * F.exp(F.col(f"_most{i}") - best["most"]) for i in count), F.lit(0.0))
    known = best["name"].isNotNull()
    return rows.select(*kept, F.when(known, best["name"]).otherwise("und").alias("lang_pred"), F.when(known, 1 / mass).otherwise(0.0).alias("score"))


def _scorer(block: Broadcast) -> Callable[[list], list[pa.Array]]:
    def score(texts: list) -> list[pa.Array]:
        names, most, mass = zip(*classify(block.value, texts), strict=True)
        return [pa.array(names, pa.string()), pa.array(most, pa.float64()), pa.array(mass, pa.float64())]

    return score
