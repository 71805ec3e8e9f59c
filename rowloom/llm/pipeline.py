"""Stages of the corpus pipeline.

Each works on the columns of ``documents`` alone, whatever others a table has;
texts of any length are taken whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, mixing, pii, shingles
from .common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which a language is recognised.

    Null, empty and letterless texts go, as do texts in no learned language;
    without languages to learn from all go.  Repeated rows share their fate.
    """
    return langid.recognised(docs.select(COLUMNS), langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of 5-word Jaccard similarity 0.8 or more: the one with the smallest id.

    Null and empty texts are one class, a null id comes last, rows with the same
    id follow by a hash of the text, and of equal rows one stays.
    """
    return shingles.one_of_each(docs.select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that give it away; every document stays.

    A text without findings stays as it is, null included.  Rows that share id
    and text share their findings; a table of findings beyond the broadcast
    bound is joined by a shuffle.
    """
    docs = docs.select(COLUMNS)
    some = pii.find(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    some = cut(some.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans")))
    if (some.agg(F.sum(F.size("__spans"))).first()[0] or 0) <= pii.BROADCAST_TERMS:
        some = F.broadcast(some)
    found = docs.join(some, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    clean = F.when(F.col("__spans").isNotNull(), pii.sanitise(F.col("text"), F.col("__spans")))
    found = found.withColumn("__clean", clean).withColumn("n_chars", F.coalesce(F.char_length("__clean").cast("long"), "n_chars"))
    return found.withColumn("text", F.coalesce("__clean", "text")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit every document as often as the mix takes it: equal rows share what they take; without words nothing stays."""
    docs = docs.select(COLUMNS)
    return mixing.emit(docs, mixing.mix(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of every document, and the digest of the decoded text; a null text is empty."""
    return bpe.encode_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("pii_sanitise", personal_data),
    ("source_mix", mixture),
    ("bpe_encoding", encoding),
]
