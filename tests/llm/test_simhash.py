import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rowloom.llm import simhash
from rowloom.llm.common import salted_join


def brute_fingerprint(text):
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words, word = [], ""
    for ch in (text or "").translate(table) + " ":
        if ch in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += ch
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    ids = [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for a in range(len(rows)):
        if ids[a] is not None:
            least[find(a)] = min(least.get(find(a), ids[a]), ids[a])
    return sorted((str(ids[a]), str(least.get(find(a)))) for a in range(len(rows)))


def test_operator_equals_brute_force(tricky, small):
    docs = tricky.select("doc_id", "text").union(small.select(F.col("doc_id") + 5000, "text"))
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.hex_fp(F.col("fp"))).collect()
    assert sorted((str(r.doc_id), r.hex) for r in got) == sorted((str(i), f"{f:016x}") for i, f in rows)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == brute_components(rows)


def test_links_of_chains_and_balls(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:12]:  # balls of differing radius, and chains
        for _ in range(25):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
        g = f
        for _ in range(8):
            for b in rng.sample(range(64), 4):
                g ^= 1 << b
            fps.add(g)
    rows = [(int(np.uint64(f).view(np.int64)), k) for k, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "fp long, doc_id long")
    roots = {r.v: r.root for r in simhash.connected_components(simhash.link_edges(df)).collect()}
    label = {}
    for fp, k in rows:
        label.setdefault(roots.get(fp, fp), []).append(k)
    got = sorted((str(k), str(min(c))) for c in label.values() for k in c)
    assert got == brute_components([(k, fp & (2**64 - 1)) for fp, k in rows])


def test_pigeonring_keys_meet_every_link():
    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << bit
        ka, _ = simhash.index_keys(np.array([a], np.uint64))
        kb, _ = simhash.index_keys(np.array([b], np.uint64))
        common = set(ka.tolist()) & set(kb.tolist())
        assert any(simhash._linked(np.array([a ^ b], np.uint64), k >> 30)[0] for k in common)


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


def test_whole_group_in_one_key():
    fps = np.array([0, 1, 3, 7, 15, 31, 63, 127, 1 << 40], np.uint64)
    keys = np.zeros(len(fps), np.int64)
    us, vs = simhash._edges_of(keys, fps)
    assert set(zip(np.concatenate(us).tolist(), np.concatenate(vs).tolist())) <= {(int(f), 0) for f in fps}


def test_direct_edges_are_links_and_connect_the_same(spark):
    rng = random.Random(8)
    fps = set()
    for _ in range(30):
        g = rng.getrandbits(64)
        for _ in range(9):
            fps.add(g)
            for b in rng.sample(range(64), 3):
                g ^= 1 << b
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in sorted(fps)], "fp long")
    direct = simhash.link_edges(df, direct=True)
    assert all((r.u ^ r.v).bit_count() <= 4 or ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 4 for r in direct.collect())
    parts = lambda e: {(r.v, r.root) for r in simhash.connected_components(e).collect()}
    classes = {}
    for name, e in (("direct", direct), ("least", simhash.link_edges(df))):
        label = {}
        for v, root in parts(e):
            label.setdefault(root, {root}).add(v)
        classes[name] = {frozenset(c) for c in label.values()}
    assert classes["direct"] == classes["least"]


def test_components_with_a_hub(spark):
    edges = [(k, 0) for k in range(1, 3000)] + [(k, k - 1) for k in range(5001, 5040)] + [(9000, 9001)]
    got = {r.v: r.root for r in simhash.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 3000)) and all(got[k] == 5000 for k in range(5001, 5040)) and got[9001] == 9000


def test_salted_join_equals_a_join(spark):
    left = spark.createDataFrame([(k, 7 if k % 3 else k, "x") for k in range(3000)] + [(1, None, "y")], "i long, key long, s string")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 3000, 2)] + [(7, "r7")], "key long, r string")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "key", how).select("i", "key", "s", "r").collect()))
        got = salted_join(left, right, "key", how, least=10, share=5)
        assert sorted(map(str, got.select("i", "key", "s", "r").collect())) == want and got.columns == ["key", "i", "s", "r"]


def test_hot_fingerprints_and_classes(spark):
    rows = [(k, "" if k % 2 else f"same words here now {k % 700}") for k in range(4000)] + [(None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    want = brute_components([(i, f) for i, f in {(i, brute_fingerprint(t)) for i, t in rows} if f or i in (1, None)])
    named = {}
    for r in got:
        named.setdefault(r.fp & (2**64 - 1), set()).add(r.component_id)
    assert len(got) == len(rows) and all(len(c) == 1 for c in named.values())
    of = dict(want)
    assert all(str(r.component_id) == of.get(str(r.doc_id), "1") for r in got)
