"""The pipeline's near-copy stage against brute force over 5-word shingles."""

import random

import numpy as np
from pyspark.sql import functions as F

from rowloom.llm import pipeline, shingles


def brute_shingles(text, n=5):
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    return frozenset(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_kept(rows):
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) >= 0.8 * union:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted(least.values())


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random()}"
    return out


def test_stage_drops_near_copies_and_nothing_else(spark, small):
    rng = random.Random(6)
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(5000, None), (5001, " \n"), (5002, "a b"), (5003, "A  b"), (5004, "a b c")]
    for k in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(300)]
        for j, n in enumerate((0, 0, 3, 5, 9, 12, 40)):
            rows.append((6000 + 10 * k + j, " ".join(edited(rng, words, n))))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in pipeline.near_duplicates(spark, df, "").collect())
    assert got == brute_kept(rows)


def test_keys_recall_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        a, b = x[:450], x[50:]  # similarity 0.8
        met += bool((shingles.band_keys(np.sort(a)) == shingles.band_keys(np.sort(b))).any())
    assert met >= 296


def test_links_are_verified(spark):
    sets = [np.arange(100, dtype=np.uint64) + np.uint64(d) for d in (0, 11, 22, 60)]
    rows = [(1, k, s.tobytes()) for k, s in enumerate(sets)]
    got = shingles.link_edges(spark.createDataFrame(rows, "key long, node long, sh binary")).collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 0)]


def test_search_equals_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(60):
        common = rng.integers(0, 1 << 40, 60, dtype=np.uint64)
        sets = [np.zeros(0, np.uint64)]
        for _ in range(25):
            keep = common[rng.random(60) < rng.choice([0.5, 0.85, 0.95])]
            sets.append(np.unique(np.append(keep, rng.integers(0, 1 << 60, rng.integers(1, 12), dtype=np.uint64))))
        sets += [s[1:] for s in sets[1:6]] + [s[: int(0.8 * len(s))] for s in sets[6:9]]
        nodes = rng.permutation(len(sets)).tolist()
        root = list(range(len(sets)))

        def find(a):
            return a if root[a] == a else find(root[a])

        for a in range(len(sets)):
            for b in range(a):
                if shingles.jaccard(sets[a], sets[b]) >= 0.8:
                    root[find(a)] = find(b)
        parts = {}
        for a in range(len(sets)):
            parts.setdefault(find(a), []).append(nodes[a])
        want = {(v, min(p)) for p in parts.values() for v in p if v != min(p)}
        assert set(shingles.search(nodes, sets)) == want


def test_group_of_near_copies_gives_one_edge_a_member():
    base = np.arange(1000, dtype=np.uint64)
    sets = [np.sort(np.append(base, np.uint64(5000 + k))) for k in range(200)]
    assert len(shingles.search(list(range(200)), sets)) == 199


def test_groups_of_the_same_nodes_are_searched_once(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{rng.randrange(4000)}" for _ in range(200)]
    rows = [(k, " ".join(edited(rng, words, 1) if k else words)) for k in range(6)]
    searched = []
    plain = shingles.link_edges
    monkeypatch.setattr(shingles, "link_edges", lambda g, least: searched.append(g.select("key").distinct().count()) or plain(g, least))
    assert len({r.root for r in shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}) == 1
    assert searched[0] < shingles.BANDS


def test_simhash_links_are_candidates(spark, monkeypatch):
    """Without the keys, SimHash links alone bring close copies together; far ones are verified away."""
    monkeypatch.setattr(shingles, "BANDS", 1)
    rng = random.Random(5)
    words = [f"w{rng.randrange(4000)}" for _ in range(2000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 2))), (3, " ".join(words + words[:40]))]
    nodes = spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string")
    got = shingles.one_of_each(nodes).collect()
    assert [r.doc_id for r in got] == [1]


def test_columns_of_other_names(tricky, nothing):
    got = shingles.one_of_each(tricky.withColumn("bands", F.lit("x")).withColumn("node", F.lit(1)))
    assert 0 < got.count() < tricky.count()
    assert shingles.one_of_each(nothing).count() == 0
