"""Quality by compression: how much better a dictionary of good text packs a document than a dictionary of bad text.

Two zstandard dictionaries are built from bounded samples of labelled documents. The whole text is cut into blocks, each
compressed afresh with both, so that no part of a long text is packed by what came before it instead of by a dictionary.
The difference of the two sizes, summed over all blocks and divided by the size of the text, becomes a score by a logistic
curve fitted on the same sums of documents the dictionaries have not seen.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import add_columns
from voxspark.llm.labelled import chance, labelled_sample, logistic

#: Documented parameters: labelled documents per class, the longest text used for fitting, dictionary size, compression level, largest block.
TRAIN_DOCUMENTS = 2000
TRAIN_BYTES = 32 << 10
DICTIONARY_BYTES = 96 << 10
LEVEL = 3
BLOCK_BYTES = 1 << 10


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


@functools.lru_cache(maxsize=8)
def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    bare = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}  # frames differ by content only
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, **bare)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **bare)


def difference(good: bytes, bad: bytes, text: str | None) -> float:
    """(size with the bad dictionary - size with the good one) / size of the text, the sizes summed over all blocks of the
    whole text, which are equally long up to a byte; 0 for empty and null texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0.0
    count = -(-len(data) // BLOCK_BYTES)
    cuts = [len(data) * i // count for i in range(count + 1)]
    better, worse, total = _packer(good), _packer(bad), 0
    for start, stop in itertools.pairwise(cuts):
        block = data[start:stop]
        total += len(worse.compress(block)) - len(better.compress(block))
    return total / len(data)


def _dictionary(texts: list[str]) -> bytes:
    samples = [data for text in texts if (data := text.encode("utf-8", "surrogatepass"))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples for statistics: their content itself is the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fit_quality(documents: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", per_class: int = TRAIN_DOCUMENTS) -> QualityModel:
    """Fit on a bounded sample. Without labels of both classes the score is the share of label 1 (0.5 without any)."""
    sample, sizes = labelled_sample(documents, labels, label, usable, per_class, TRAIN_BYTES)
    held, seen = [x for i, x in enumerate(sample) if i % 5 < 2], [x for i, x in enumerate(sample) if i % 5 >= 2]
    good, bad = (_dictionary([text for text, value in seen if value == kind]) for kind in (1, 0))
    slope, intercept = logistic([difference(good, bad, text) for text, _ in held], [value for _, value in held], sizes)
    return QualityModel(good, bad, slope, intercept)


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with ``score`` (0 to 1) of every row's whole text. Null and empty texts get the score of
    a difference of 0; equal texts get equal scores."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(texts: list) -> list[pa.Array]:
        m = shared.value
        found = np.array([difference(m.good, m.bad, value) for value in texts])
        return [pa.array(chance(m.slope * found + m.intercept), pa.float64())]

    return add_columns(df, text, keep, [("score", "double")], score)
