"""Near copies by the Jaccard similarity of word shingles: SimHash links, completed and verified.

Words are as in ``simhash``; a text's shingles are the distinct runs of
``words`` words, as XXH64 (seed 42); a text of fewer words is one shingle, an
empty or null text none, and two texts without shingles are alike.  Texts with
equal shingles are one node.

Candidates come from two sides.  ``simhash.link_edges`` links the SimHashes of
these shingles (pigeonring index, chains, full Hamming check).  Its four
differing bits reach only part of the pairs of similarity 0.8, since such pairs
differ in some ten bits, which no index of segments can serve; so each node also
has ``BANDS`` keys, each of ``ROWS`` minima over permuted shingles, and nodes
that share a key are candidates: two nodes of similarity 0.8 share none with a
probability of 0.2 %, of 0.9 with less than one in a million.

Keys with the same nodes are searched once.  Their nodes' shingles are read
again and each group is searched breadth first by the exact similarity, so every
link is verified and no group emits its pairs: one edge for each node reached.

Rows that share an id are told apart by their text, a null id comes last, of
equal rows one stays; texts of any length are read whole; an empty table gives
an empty result; columns under any other names pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import SLICE_ROWS, cut, map_texts, salted_join, ship, small, tidy
from .simhash import SEED, connected_components, shingle_hashes, simhash_of

WORDS = 5
LEAST = 0.8
BANDS = 20
ROWS = 6
_BLOCK = 1 << 11
_ODD, _ADD = np.random.default_rng(SEED).integers(1, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_ODD |= np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, words))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two arrays that ``shingles`` returned."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def band_keys(sh: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a text's shingles."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(sh), _BLOCK):
        x = sh[at : at + _BLOCK] * _ODD + _ADD
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def search(nodes: list[int], sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Breadth-first search of one group: an edge from each reached node to the smallest of its part.

    Two sets of similarity ``least`` share one of their rarest shingles, taken
    from each set in the same order: all but ``least`` of the set, and one more.
    Only sets that do are compared, so a group that shares much but not enough
    is searched without comparing all with all.
    """
    order = sorted(range(len(nodes)), key=nodes.__getitem__)
    nodes, sets = [nodes[k] for k in order], [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rare = np.lexsort((word, times[word], owner))  # by set, then the rarest first
    starts = np.concatenate(([0], np.cumsum(sizes)))
    width = np.where(sizes > 0, sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1, 0)
    ahead = np.arange(len(rare)) - starts[owner] < width[owner]
    own = word[rare][ahead]  # the sets' rarest shingles, set by set
    own_starts = np.concatenate(([0], np.cumsum(width)))
    by_word = np.argsort(own, kind="stable")
    holders, bounds = owner[ahead][by_word], np.searchsorted(own[by_word], np.arange(len(times) + 1))
    waiting, out = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not waiting[first]:
            continue
        waiting[first] = False
        queue = [first]
        while queue and waiting.any():
            a = queue.pop()
            seen = [holders[bounds[w] : bounds[w + 1]] for w in own[own_starts[a] : own_starts[a + 1]]]
            some = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            for b in some[waiting[some]].tolist():
                if min(sizes[a], sizes[b]) >= least * max(sizes[a], sizes[b]) and jaccard(sets[a], sets[b]) >= least:
                    out.append((nodes[b], nodes[first]))
                    waiting[b] = False
                    queue.append(b)
    return out


def link_edges(grouped: DataFrame, least: float = LEAST) -> DataFrame:
    """Edges ``(u, v)`` of rows ``(key, node, sh)``; the rows of a key are searched together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(nodes, sets):
            got = search(nodes, sets, least)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in got], pa.int64()) for k in (0, 1)], names=["u", "v"])

        now, nodes, sets = None, [], []
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            for key, node, sh in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if key != now:
                    if len(nodes) > 1:
                        yield flush(nodes, sets)
                    now, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.frombuffer(sh, np.uint64))
        if len(nodes) > 1:
            yield flush(nodes, sets)

    ship(grouped.sparkSession)
    rows = grouped.select("key", "node", "sh").repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(tidy(run), "u bigint, v bigint").distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """``(__id, __hash, none, root)`` of every row; rows of a class, linked by verified similarity, share ``root``."""
    null_id = F.lit(-(1 << 63)).cast("long")
    keep = [F.coalesce(F.col(id_col), null_id).alias("__id"), F.col(id_col).isNull().alias("none"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__hash")]

    def signed(x) -> np.ndarray:
        return np.asarray(x, np.uint64).view(np.int64)

    def node(sh: np.ndarray) -> int:
        return xxhash.xxh64_intdigest(sh.tobytes(), SEED)

    def make_keys():
        def one(texts):
            every = [shingle_hashes(t, words) for t in texts]
            sets = [np.unique(h) for h in every]
            return [signed([node(s) for s in sets]), [band_keys(s).tobytes() for s in sets], signed([simhash_of(h) for h in every])]

        return one

    def make_sets():
        def one(texts):
            sets = [shingles(t, words) for t in texts]
            return [signed([node(s) for s in sets]), [s.tobytes() for s in sets]]

        return one

    docs = cut(map_texts(df, keep, F.col(text_col), [("node", "bigint"), ("bands", "binary"), ("fp", "bigint")], make_keys))
    nodes = cut(docs.groupBy("node").agg(F.min("bands").alias("bands"), F.min("fp").alias("fp"), F.min(F.struct("__id", "__hash")).alias("as")))
    at = F.sequence(F.lit(0), F.lit(BANDS - 1))
    banded = nodes.select("node", F.explode(F.transform(at, lambda k: F.conv(F.hex(F.substring("bands", k * 8 + 1, F.lit(8))), 16, -10).cast("long"))).alias("key"))
    groups = banded.unionByName(linked_pairs(nodes))
    # a group is told by its size and two sums over its nodes
    told = groups.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("a"), F.sum(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40))).alias("b"))
    once = told.where("n > 1").groupBy("n", "a", "b").agg(F.min("key").alias("key")).select("key")
    pairs = cut(groups.join(once, "key").distinct())
    # one text for each node that shares a key is read again
    some = cut(nodes.join(pairs.select("node").distinct(), "node", "left_semi").select("as.__id", "as.__hash"))
    texts = df.select(*keep, F.col(text_col).alias("__t")).join(small(some), ["__id", "__hash"], "left_semi")
    sets = map_texts(texts, [], F.col("__t"), [("node", "bigint"), ("sh", "binary")], make_sets).dropDuplicates(["node"])
    roots = connected_components(link_edges(pairs.join(sets, "node"), least)).withColumnRenamed("v", "node")
    return salted_join(docs.drop("bands", "fp"), roots, "node", "left").select("__id", "__hash", "none", F.coalesce("root", "node").alias("root"))


def linked_pairs(nodes: DataFrame) -> DataFrame:
    """``(key, node)``: groups of two nodes that SimHash links, or that share a fingerprint.

    One node stands for those of a fingerprint.
    """
    reps = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    same = salted_join(nodes.select("fp", "node"), reps, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    edges = cut(simhash.link_edges(reps, direct=True))
    left = salted_join(edges, reps.select(F.col("fp").alias("u"), F.col("rep").alias("a")), "u")
    both = salted_join(left, reps.select(F.col("fp").alias("v"), F.col("rep").alias("b")), "v").select("a", "b")
    pairs = same.unionByName(both).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("node"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """Rows of ``df``, all columns, that stay: in each class the one with the smallest id, null last.

    Rows that share an id are told apart by their text; of equal rows one stays.
    Only texts whose id and hash a dropped or repeated row has are looked at
    again; all others pass as they are while that table is small enough to broadcast.
    """
    order = F.struct("none", "__id", "__hash")
    rows = cut(near_copies(df, id_col, text_col, words, least))
    kept = rows.groupBy("root").agg(F.min(order).alias("k")).select("k.none", "k.__id", "k.__hash")
    keys = rows.groupBy("none", "__id", "__hash").agg(F.count("*").alias("n")).join(kept.withColumn("stays", F.lit(True)), ["none", "__id", "__hash"], "left")
    touched = small(cut(keys.where("stays IS NULL OR n > 1").select("none", "__id", "__hash", "stays")))
    null_id = F.lit(-(1 << 63)).cast("long")
    marks = {"none": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col), null_id), "__hash": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[m.alias(k) for k, m in marks.items()])
    again = keyed.join(touched, list(marks), "left_semi").join(small(touched.where("stays")), list(marks), "left_semi")
    again = again.withColumn("__n", F.row_number().over(Window.partitionBy(*marks).orderBy(F.lit(0)))).where("__n = 1").select("__row")
    return keyed.join(touched, list(marks), "left_anti").select("__row").unionByName(again).select("__row.*")
