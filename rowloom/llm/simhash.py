"""SimHash near-duplicate groups with pigeonring candidate filtering.

A text's fingerprint has 64 bits.  ASCII letters are lower-cased, words are runs
of anything but ASCII white space, and shingles are ``words_per_shingle``
consecutive words joined by one space, repeats included.  Each shingle votes
with its XXH64 (seed 42); a bit is set if it is set in over half the votes.

Two fingerprints link if they differ in at most ``MAX_DIFF`` bits.  The 64 bits
are cut into a ring of five segments.  The pigeonring principle says that if
two fingerprints differ in at most 4 bits, then from some segment on, every
chain of 1, 2, 3, 4, 5 consecutive segments holds at most 0, 1, 2, 3, 4 of the
differences.  The first two budgets become the index: a fingerprint is filed,
for each start, under its first segment and its second segment with one bit
masked, so that fingerprints whose two-segment chain stays within budget meet
in at least one group.  The next budgets prune inside a group, then the full
Hamming distance decides.

A group never emits its pairs: it is searched breadth first, every reached
fingerprint leaves the unvisited set, and one edge per member to the smallest
member of its part goes out.  Exact copies are collapsed to one fingerprint
before any shuffle of index rows, so a group holds distinct fingerprints only.

Null and empty texts have fingerprint zero and link like any other; a text of any
length is hashed whole, block by block; a bit with as many votes for as against
is 0; repeated rows get the same class; an empty table gives an empty result; a
class whose documents all have a null id has a null ``component_id``; columns
other than id and text are not read, whatever their names.

The search of one index group runs in one task and holds its distinct
fingerprints.  Keys that many rows share are otherwise dealt in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, salted_join, ship, tidy

SEED = 42
MAX_DIFF = 4
#: Widths of the ring's segments, lowest bits first: MAX_DIFF + 1 of them.
WIDTHS = (13, 13, 13, 13, 12)
_OFFSETS = tuple(sum(WIDTHS[:i]) for i in range(len(WIDTHS)))
_BLOCK = 1 << 15
#: Index rows searched at once, at least.
_GATHER = 1 << 15


def shingle_hashes(text: str | None, words_per_shingle: int) -> np.ndarray:
    """Hashes of a text's shingles in order, repeats included; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words_per_shingle - 1 :] if len(words) >= words_per_shingle else ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())), "<u8", len(last))


def simhash_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of shingle hashes; zero without any."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint64(text: str | None, words_per_shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    return simhash_of(shingle_hashes(text, words_per_shingle))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """``(doc_id, text_hash, fp)``: the fingerprint of every row, as a signed long; null texts hash as empty."""

    def make():
        def one(texts):
            raw = np.array([fingerprint64(t, words_per_shingle) for t in texts], dtype=np.uint64)
            return [raw.view(np.int64)]

        return one

    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return map_texts(df, [F.col(id_col).alias("doc_id"), text_hash.alias("text_hash")], F.col(text_col), [("fp", "bigint")], make)


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> np.uint64(_OFFSETS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def _mask(segments: list[int]) -> np.uint64:
    return np.uint64(sum(((1 << WIDTHS[i]) - 1) << _OFFSETS[i] for i in segments))


def index_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group keys of each fingerprint: (keys, fingerprints), one row per key."""
    keys = []
    for i in range(len(WIDTHS)):
        j = (i + 1) % len(WIDTHS)
        first, second = _segment(fp, i), _segment(fp, j)
        for bit in range(WIDTHS[j]):
            masked = second & np.uint64(~(1 << bit) & 0x1FFF)
            keys.append((np.uint64((i << 4 | bit) << 26) | first << np.uint64(13) | masked).astype(np.int64))
    return np.concatenate(keys), np.tile(fp, len(keys))


def _linked(x: np.ndarray, start: int) -> np.ndarray:
    """Which of the XORed fingerprints pass the chains from ``start`` and the full check."""
    ring = [(start + k) % len(WIDTHS) for k in range(len(WIDTHS))]
    alive = np.ones(len(x), bool)
    for length in range(2, len(WIDTHS)):
        alive &= np.bitwise_count(x & _mask(ring[:length])) <= length * MAX_DIFF // len(WIDTHS)
        if not alive.any():
            return alive
    return alive & (np.bitwise_count(x) <= MAX_DIFF)


def group_edges(fp: np.ndarray, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first search of one group: (members, the member each was reached from) of each part of two or more."""
    rest, out = np.unique(fp), []
    while len(rest):
        reached, parents, queue, rest = [rest[:1]], [rest[:1]], [rest[0]], rest[1:]
        while queue and len(rest):
            now = queue.pop()
            near = _linked(rest ^ now, start)
            if near.any():
                reached.append(rest[near])
                parents.append(np.full(near.sum(), now, np.uint64))
                queue.extend(rest[near])
                rest = rest[~near]
        if len(reached) > 1:
            out.append((np.concatenate(reached), np.concatenate(parents)))
    return out


def _edges_of(keys: np.ndarray, fp: np.ndarray, direct: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of all whole groups in arrays sorted by key: to each part's smallest member, or between linked members."""
    us, vs = [], []
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(bounds)
    starts = (keys >> 30).astype(np.int64)
    two = bounds[:-1][sizes == 2]
    for i in range(len(WIDTHS)):
        at = two[starts[two] == i]
        a, b = fp[at], fp[at + 1]
        ok = _linked(a ^ b, i) & (a != b) if len(at) else np.zeros(0, bool)
        us.append(np.maximum(a, b)[ok])
        vs.append(np.minimum(a, b)[ok])
    for k in np.flatnonzero(sizes > 2):
        for members, parents in group_edges(fp[bounds[k] : bounds[k + 1]], int(starts[bounds[k]])):
            to = parents if direct else np.full(len(members), members.min(), np.uint64)
            us.append(members[members != to])
            vs.append(to[members != to])
    return us, vs


def _batch(names: list[str], *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.uint64).view(np.int64)) for a in arrays], names=names)


def link_edges(fps: DataFrame, direct: bool = False) -> DataFrame:
    """Edges ``(u, v)`` that connect every class of distinct fingerprints in column ``fp``.

    ``direct`` edges are links themselves; the others lead to the smallest
    member that a group's search reached, which takes fewer rounds to settle.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(whole), 4096):
                yield _batch(["key", "fp"], *index_keys(whole[at : at + 4096]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        parts_k: list[np.ndarray] = []
        parts_f: list[np.ndarray] = []

        def flush(k, f):
            us, vs = _edges_of(k, f, direct)
            return _batch(["u", "v"], np.concatenate(us), np.concatenate(vs))

        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            if not len(k):
                continue
            parts_k.append(k)
            parts_f.append(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            if k[-1] == parts_k[0][0] or sum(map(len, parts_k)) < _GATHER:
                continue  # one group so far, or few rows: go on gathering
            held_k, held_f = np.concatenate(parts_k), np.concatenate(parts_f)
            split = np.searchsorted(held_k, held_k[-1])
            yield flush(held_k[:split], held_f[:split])
            parts_k, parts_f = [held_k[split:]], [held_f[split:]]
        if parts_k:
            yield flush(np.concatenate(parts_k), np.concatenate(parts_f))

    ship(fps.sparkSession)
    rows = fps.select("fp").mapInArrow(tidy(emit), "key bigint, fp bigint")
    rows = rows.repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(tidy(search), "u bigint, v bigint").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(v, root)`` for every node of ``edges(u, v)``; root is a fixed member of its class.

    Alternating large-star and small-star steps; each round works on at most as
    many edges as there were, is written to the shared folder, and the loop ends
    once a round changes nothing.  A class's smallest member gathers edges from
    all others, so the large-star step deals hot nodes in slices; towards smaller
    nodes a node has at most one edge for each group it is in.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))

    def stamp(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()

    e = cut(edges.select("u", "v").where("u <> v").distinct())
    before = stamp(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = salted_join(both, least(both), "u", n_rows=2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.join(least(down), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.groupBy("u").agg(F.min("v").alias("v")))
        e = cut(small.where("u <> v").distinct())
        after = stamp(e)
        if after == before:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("connected components did not settle")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)`` of every row.

    ``root`` is a fingerprint that names the class, ``component_id`` the smallest id in it.
    """
    docs = cut(fingerprints(df, id_col, text_col, words_per_shingle))
    fps = docs.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(link_edges(fps)).withColumnRenamed("v", "fp")
    # fingerprints without a link are their own class; the others look their class up, hot classes in slices
    linked = cut(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    classes = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = salted_join(linked.select("fp", "root"), classes, "root")
    return salted_join(docs, named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def hex_fp(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
