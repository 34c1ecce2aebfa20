"""A corpus pipeline: language, quality, near duplicates, mixture of sources, piece ids.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns a table that is
written as Parquet and read again as the next one's ``docs``. Nulls: a document without text or letters goes at the
first stage; one without doc_id passes the near-duplicate stage untouched; a null source is a source of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.llm.common import fold, table
from voxspark.llm.mixing import with_mixture
from voxspark.llm.nb_language import fit_language, predict_language
from voxspark.llm.ngram_join import ngram_components
from voxspark.llm.quality import fit_quality, score_quality
from voxspark.llm.viterbi import encode_texts
from voxspark.session import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below these scores a document goes; entropy and passes of the mixture are those of its operator's query.
LANGUAGE_SCORE, QUALITY_SCORE = 0.5, 0.5
ENTROPY, MAX_PASSES = 0.99, 4.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a learned language; without a letter, or in doubt between languages, they go."""
    model = fit_language(docs.where(fold(F.col("doc_id"), 3) != 1))
    scored = predict_language(docs, model, keep=COLUMNS)
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are likelier good than bad."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return score_quality(docs, model, keep=COLUMNS).where(F.col("score") >= QUALITY_SCORE).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each component of linked documents."""
    found = ngram_components(docs.select(*COLUMNS))
    others = found.where("doc_id <> component_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's budget takes it."""
    return with_mixture(docs.select(*COLUMNS), ENTROPY, MAX_PASSES)[0].select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with their number, checksum and whether they decode to the text."""
    return encode_texts(docs, str(public_tokenizers.path("piece_bpe_32k.model")), keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: Models fitted in numpy and a piece search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
