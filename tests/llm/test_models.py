"""Classifiers: held-out accuracy, independence from other columns, and edge cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import langid, quality, toxicity
from rowloom.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language_held_out_accuracy(docs):
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    got = got.withColumn("held", fold(F.col("doc_id"), 3) == 1).toPandas()
    assert (got.lang == got.lang_pred)[got.held].mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_never_reads_the_held_out_fold(docs):
    spoiled = docs.withColumn("lang", F.when(fold(F.col("doc_id"), 3) == 1, F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.fit(docs), langid.fit(spoiled)
    assert a.langs == b.langs and all(np.array_equal(a.pairs[k], b.pairs[k]) for k in a.pairs)


def test_language_edges(spark, tricky, nothing):
    model = langid.fit(tricky)
    got = langid.identify(tricky, model).collect()
    assert len(got) == tricky.count()
    texts = {r.doc_id: r.text for r in tricky.collect() if r.doc_id is not None and r.doc_id != 9}
    for r in got:
        if r.doc_id in texts:
            lettered = bool(re.search(r"[^\W\d_]", texts[r.doc_id] or ""))
            assert (r.lang_pred in ("en", "fr")) == lettered and (r.score > 0) == lettered
            assert lettered or (r.lang_pred, r.score) == ("und", 0.0)
    kept = langid.recognised(tricky, model)
    assert kept.columns == tricky.columns and kept.count() == sum(r.lang_pred != "und" and r.score >= model.floor for r in got)
    assert langid.fit(nothing) is None
    assert {r.lang_pred for r in langid.identify(tricky, None).collect()} == {"und"}
    assert langid.identify(nothing, None).count() == 0


def test_family_first():
    model = langid.Model(np.eye(4, langid.DIMS, dtype=np.float32), ["en", "de", "fr", "es"])
    assert model.families == ["germanic", "romance"]
    assert set(model.pairs) == {("de", "en"), ("es", "fr")}
    assert model.predict(np.eye(4, langid.DIMS, dtype=np.float32))[0] == ["en", "de", "fr", "es"]


def test_toxicity_ranks_held_out_documents(docs, labels):
    network = toxicity.fit(docs, labels)
    got = toxicity.score(docs, network).join(labels, "doc_id").toPandas()
    got["held"] = [r[0] for r in docs.sparkSession.createDataFrame(got[["doc_id"]]).select(fold(F.col("doc_id"), 5) == 0).collect()]
    test = got[got.held]
    pos, neg = test[test.toxic == 1].score, test[test.toxic == 0].score
    assert np.mean([(p > neg).mean() for p in pos]) > 0.8  # 40 toxic training documents here
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_toxicity_edges(spark, tricky, nothing, docs, labels):
    network = toxicity.fit(docs, labels)
    got = toxicity.score(tricky, network).collect()
    assert len(got) == tricky.count() and all(0 <= r.score <= 1 for r in got)
    no_labels = labels.where("false")
    assert toxicity.fit(docs, no_labels) is None
    assert {r.score for r in toxicity.score(tricky, None).collect()} == {0.0}
    assert toxicity.score(nothing, network).count() == 0


def test_toxicity_does_not_read_held_out_labels(docs, labels):
    spoiled = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, spoiled)
    assert np.array_equal(a.e, b.e) and a.shift == b.shift


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    times = Counter(grams)
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(i, i + 8))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_quality_base_equals_brute_force(spark, tricky, small):
    both = tricky.select("doc_id", "text").union(small.select("doc_id", "text")).withColumns({"score": F.lit("x"), "kept": F.lit(1), "words": F.lit(2)})
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted((str(r.doc_id), tuple(r[c] for c in cols), r.base_failed, r.kept) for r in quality.assess(both, None).collect())
    want = []
    for r in both.collect():
        b = brute_base(r.text)
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        want.append((str(r.doc_id), b, failed, not failed))
    assert got == sorted(want)


def test_quality_trees(docs, labels, nothing):
    trees = quality.fit(docs, labels)
    got = quality.assess(docs, trees).join(labels, "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.9
    assert not (got.kept & got.base_failed).any()
    rng = np.random.default_rng(0)
    x = rng.random((300, len(quality.FEATURES))) * 3
    base = trees.score(x)
    for f, sign in enumerate(quality.FEATURES.values()):
        if sign:
            up = x.copy()
            up[:, f] += rng.random(len(x))
            assert (sign * (trees.score(up) - base) >= -1e-12).all()
    assert quality.fit(docs, labels.where("false")) is None
    assert quality.assess(nothing, trees).count() == 0


def test_quality_trees_equal_a_walk_down_each_tree(docs, labels):
    trees = quality.fit(docs, labels)
    rng = np.random.default_rng(1)
    x = np.vstack([np.array([quality.statistics(r.text)[1] for r in docs.limit(100).collect()]), rng.random((100, len(quality.FEATURES))) * 4])
    want = []
    for row in x:
        margin = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            margin += trees.value[at]
        want.append(1 / (1 + np.exp(-margin)))
    assert np.allclose(trees.score(x), want, atol=1e-12)


def test_several_texts_of_an_id_are_learnt_alike(spark, docs, labels):
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" and more"))))
    again = twice.repartition(13, "text")
    a, b = quality.fit(twice, labels), quality.fit(again, labels)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)
    a, b = toxicity.fit(twice, labels), toxicity.fit(again, labels)
    assert np.array_equal(a.e, b.e)


def plain_logit(net, text):
    """The network's forward pass, one window after another."""
    rows = net.row_of[toxicity.hashed(text)]
    rows = np.concatenate([rows, np.zeros((2, max(toxicity.WIDTHS) - 1), np.int32)], axis=1)
    words = (net.e[rows[0]] + net.e[rows[1]]).astype(float)
    pooled = []
    for w, b in zip(net.w, net.b):
        best = np.full(toxicity.FILTERS, -np.inf)
        for at in range(len(words)):
            z = np.zeros(toxicity.FILTERS)
            for j in range(len(w)):
                if at + j < len(words):
                    z += words[at + j] @ w[j]
            best = np.maximum(best, z)
        pooled.append(best + b)
    return np.maximum(np.concatenate(pooled), 0) @ net.out + net.bias[0]


def test_toxicity_scores_equal_a_plain_forward_pass(docs, labels):
    net = toxicity.fit(docs, labels)
    texts = ["", None, "x", "one two", *[r.text for r in docs.where("length(text) < 3000").limit(60).collect()]]
    got = net.score([toxicity.hashed(t) for t in texts])
    names = list(toxicity.FUNCTION_WORDS)
    for t, s in zip(texts, got):
        words = [w for w in re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").lower())]
        hits = [sum(w in toxicity.FUNCTION_WORDS[n].split() for w in words) for n in names]
        z = plain_logit(net, t)
        near = [abs(s - 1 / (1 + np.exp(-np.clip(z - net.shift[n], -30, 30)))) for n in ["", *names]]
        assert min(near) < 1e-4
        if max(hits) and sorted(hits)[-1] > sorted(hits)[-2]:
            assert near[1 + int(np.argmax(hits))] < 1e-4 or min(near) < 1e-4


def test_long_toxic_texts_are_scored_whole(spark, docs, labels):
    net = toxicity.fit(docs, labels)
    got = toxicity.score(docs, net).orderBy(F.col("score").desc()).first()
    text = docs.where(F.col("doc_id") == got.doc_id).first().text
    filler = "the of and " * 40_000
    long = spark.createDataFrame([(1, filler + text), (2, text), (None, text)], "doc_id long, text string").withColumn("score", F.lit("x"))
    s = {r.doc_id: r.score for r in toxicity.score(long, net).collect()}
    assert s[None] == s[2] >= 0.5 and s[1] >= 0.5


def plain_counts(text):
    codes = [ord(c) if ord(c) >= 128 or c.isalpha() else 32 for c in f" {text.lower()} "]
    out = np.zeros(langid.DIMS, np.int64)
    m = 1 << 32
    for k, a in enumerate(codes):
        out[a * 2654435761 % m >> 20] += 1
        if k + 1 < len(codes):
            b = (a * 40503 + codes[k + 1]) % m
            out[b * 2246822519 % m >> 20] += 1
            if k + 2 < len(codes):
                out[(b * 40503 + codes[k + 2]) % m * 3266489917 % m >> 20] += 1
    return out


def test_language_features_equal_plain_counts(monkeypatch):
    texts = ["", "a", "Été à l'ombre, 12 fois!", "日本語 text", "x" * 50, "one two three four five six seven"]
    for block in (7, 1 << 18):
        monkeypatch.setattr(langid, "_BLOCK", block)
        for t in texts:
            assert np.array_equal(langid.counts(t), plain_counts(t)), t


def test_language_predictions_equal_plain_votes(docs):
    model = langid.fit(docs)
    for r in docs.where("length(text) > 20").limit(80).collect():
        x = np.sqrt(plain_counts(r.text).astype(np.float32))
        x = np.append(x / np.linalg.norm(x), np.float32(1))
        margins = [float(w @ x) for w in model.family_w]
        f = model.families[int(np.argmax(margins))]
        own = model.members[f]
        votes = dict.fromkeys(own, 0)
        for (a, b), w in model.pairs.items():
            if a in votes:
                votes[a if w @ x > 0 else b] += 1
        (lang,), (score,) = model.predict(langid.features(r.text)[None])
        assert votes[lang] == max(votes.values()) and 0 <= score <= 1


def test_texts_of_other_languages_are_rejected(spark, docs):
    model = langid.fit(docs)
    other = [
        "Questo è un testo in italiano che parla di molte cose diverse e interessanti per tutti.",
        "Это русский текст о погоде и природе, который должен быть отклонён моделью.",
    ]
    assert langid.recognised(spark.createDataFrame([(k, t) for k, t in enumerate(other)], "doc_id long, text string"), model).count() == 0
    clean = docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    assert langid.recognised(clean, model).count() >= 0.995 * clean.count()


def test_rows_without_an_id_are_learnt(spark, docs):
    model = langid.fit(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert model.langs == ["de", "en", "es", "fr"]


def test_training_is_bounded_whatever_the_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 60)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 20)
    rows = [(k, f"word{k % 50} text " * 4, f"l{k % 50 if k % 5 else 0:02d}") for k in range(3000)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) <= 20
