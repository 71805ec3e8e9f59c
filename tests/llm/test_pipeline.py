import re

import pytest
from pyspark.sql import functions as F

from test_shingles import brute_kept

import corpus_pipeline
from rowloom.llm import pii, pipeline

SF = "/root/testdata/sf0.001"


def test_run_keeps_to_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_near_dedup", "pii_sanitise", "source_mix", "bpe_encoding"]
    seen = {}
    for name, f in stages.items():
        docs = f(spark, docs, SF).cache()
        seen[name] = docs
        if name != "bpe_encoding":
            assert docs.columns == pipeline.COLUMNS
    before = spark.read.parquet(f"{SF}/documents.parquet")
    named = seen["language_id"]
    assert named.count() == sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in before.collect())
    # near duplicates: one of each class of 5-word similarity 0.8 or more, the smallest id
    assert sorted(r.doc_id for r in seen["simhash_near_dedup"].collect()) == brute_kept([(r.doc_id, r.text) for r in named.collect()])
    # personal data: nothing is left, nothing is lost
    clean = seen["pii_sanitise"]
    assert clean.count() == seen["simhash_near_dedup"].count()
    left = pii.base_spans(clean).where(F.size("spans") > 0).count()
    assert left == 0
    untouched = pii.find(seen["simhash_near_dedup"]).where(F.size("spans") == 0).join(seen["simhash_near_dedup"], "doc_id")
    assert untouched.join(clean.select("doc_id", F.col("text").alias("t")), "doc_id").where("text <> t").count() == 0
    # mixing: rows repeat at most three times, texts unchanged
    mixed = seen["source_mix"].groupBy("doc_id").count().toPandas()
    assert mixed["count"].max() <= 3 and set(mixed.doc_id) <= {r.doc_id for r in clean.collect()}
    assert seen["bpe_encoding"].count() == seen["source_mix"].count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, seen["bpe_encoding"].collect()))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_any_rows(spark, tricky, nothing, k):
    name, stage = corpus_pipeline.STAGES[k]
    cols = pipeline.COLUMNS
    got = stage(spark, tricky, SF)
    assert got.count() <= 3 * tricky.count()
    if name != "bpe_encoding":
        assert got.columns == cols
    assert stage(spark, nothing, SF).count() == 0


def test_repeated_rows_and_null_ids_in_dedup(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "z y x w v u", "en", "s", 1), (None, "q r s t u v w", "en", "s", 1), (None, "a b c d e f", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == [("1", "a b c d e f"), ("1", "z y x w v u"), ("None", "q r s t u v w")]
