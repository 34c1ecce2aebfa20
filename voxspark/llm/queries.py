"""The registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.llm.common import fold, table
from voxspark.llm.fingerprints import fingerprint_edits
from voxspark.llm.lattice import near_vectors
from voxspark.llm.mixing import with_mixture
from voxspark.llm.nb_language import fit_language, predict_language
from voxspark.llm.ngram_join import ngram_components
from voxspark.llm.oracles import ORACLES
from voxspark.llm.quality import fit_quality, score_quality
from voxspark.llm.resampling import resample
from voxspark.llm.shallot import shallot_clusters
from voxspark.llm.sharding import assign_shards
from voxspark.llm.toxicity import fit_toxicity, score_toxicity
from voxspark.llm.viterbi import encode_texts
from voxspark.llm.warc import archive_pages
from voxspark.llm.wavelet import read_shards, write_shards
from voxspark.session import checkpoint_dir

SHARDS = 40
COSINE = 0.93
#: Target entropy in parts of that of equal weights, and how often a source may be given at most.
ENTROPY, MAX_PASSES = 0.99, 4.0


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return ngram_components(table(spark, sf_dir, "documents"))


def op2_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by compression with dictionaries of good and of bad text."""
    documents = table(spark, sf_dir, "documents")
    model = fit_quality(documents, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    held = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return score_quality(documents, model, keep=("doc_id", held)).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's token ids lie in the wavelet files, as read back from them."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/wavelet-{uuid.uuid4().hex}"
    shards = write_shards(table(spark, sf_dir, "documents"), folder, str(public_tokenizers.path("word_bpe_49k.json")))
    return read_shards(spark, folder, shards)


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of sources takes it, with its place in its source's order."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return with_mixture(documents, ENTROPY, MAX_PASSES)[0].drop("text")


def op5_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's piece ids, and whether they decode to its text."""
    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    return encode_texts(table(spark, sf_dir, "documents"), model).drop("ids")


def op6_lattice_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivors of near-duplicate embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"), COSINE)


def op7_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by averaged subword embeddings."""
    documents = table(spark, sf_dir, "documents")
    model = fit_toxicity(documents, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return score_toxicity(documents, model, keep=("doc_id", held)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by jump consistent hashing of its id."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return assign_shards(rows, "doc_id", SHARDS)


def op10_language_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by naive Bayes over character n-grams."""
    documents = table(spark, sf_dir, "documents")
    remainder = fold(F.col("doc_id"), 3)
    model = fit_language(documents.where(remainder != 1))
    return predict_language(documents, model, keep=("doc_id", (remainder == 1).alias("held_out")))


def op11_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding of 64 components after three rounds of exact k-means."""
    return shallot_clusters(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw towards the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it was read back from the archives that hold all pages."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return archive_pages(spark, table(spark, sf_dir, "pages"), folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_quality_compression,
        op3_wavelet_tokens,
        op4_temperature_mixing,
        op5_sentencepiece_viterbi,
        op6_lattice_near_vectors,
        op7_toxicity_subwords,
        op8_bottom_k_fingerprints,
        op9_jump_shards,
        op10_language_bayes,
        op11_shallot_clusters,
        op12_importance_resampling,
        op13_warc_round_trip,
    )
}

__all__ = ["ORACLES", "QUERIES"]
