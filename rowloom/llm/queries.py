"""Queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, licenses, mixing, pii, quality, simhash, syncmers, toxicity
from .common import fold, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held = fold(F.col("doc_id"), toxicity.HELD_OUT[0]) == toxicity.HELD_OUT[1]
    return got.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.from_turn_rows(table(spark, sf_dir, "conversations"))
    turns = turns.unionByName(chat.canonical_json(chat.probe(spark), "conv_id", "record"))
    return chat.digests(chat.render(turns))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_edits(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies", "row_hash")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", simhash.hex_fp(F.col("fp")).alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.identify(docs, langid.fit(docs))
    held = fold(F.col("doc_id"), langid.HELD_OUT[0]) == langid.HELD_OUT[1]
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_syncmers": op4_syncmers,
    "op5_mixing": op5_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {"op5_mixing": mixing.ORACLE, "op6_license_scan": licenses.oracle()}
