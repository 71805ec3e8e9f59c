"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The base rules fail a document with fewer than 20 words or with over 30 % of its
words inside 8-word windows that occur twice or more in it.  The verdict on the
others is that of boosted trees trained here, in numpy, on ``labels.quality``:
histogram splits on quantile bins, with monotonic constraints (a larger share of
repeated words, repeated lines, symbols or capitals never raises the score).
All trees are flattened into arrays (feature, threshold, left, right, value) and
scored together, one level at a time.

Training reads at most ``TRAIN_ROWS`` labelled documents, taken by a hash of
their id; only their statistics reach the driver.  If an id has several texts,
the one with the smallest hash is learnt; if it has several labels, 1 counts.

A null text has no words and fails, as does an empty one; a text of any length is
counted whole, in time linear in it but for a sort; equal gains go to the split
tried first, by feature then threshold; repeated rows get equal results; a null
id is judged and never learnt; without labels of both kinds the base rules alone
decide; an empty table gives an empty result; columns other than id, text and
labels are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, unit_hash

TRAIN_ROWS = 6000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: Statistics of a document in the trees' order, with the sign of their constraint (0: none).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "distinct_share": 0, "words_per_line": 0, "end_marks": 0,
}


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a ``WINDOW``-word window found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size, width = len(number), 1
    while width < WINDOW:  # ids of runs of 2, 4, 8 words, exact at every step
        ids = ids[:-width] * size + ids[width:]
        distinct, ids = np.unique(ids, return_inverse=True)
        size, width = len(distinct), 2 * width
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[WINDOW : WINDOW + n] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the trees' features."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    lower = text.lower()
    upper = int((np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) != np.frombuffer(lower.encode("utf-32-le", "replace"), np.uint32)).sum()) if len(lower) == len(text) else 0
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, ".!?"))
    x = [
        float(np.log1p(n)), chars / max(1, n), symbols / max(1, chars), dup / max(1, len(lines)), repeat / max(1, n),
        upper / max(1, chars), digits / max(1, chars), len(set(words)) / max(1, n), n / max(1, len(lines)), marks / max(1, n),
    ]
    return (n, chars, symbols, dup, repeat), x


class Trees:
    """Boosted regression trees on the logistic loss, kept as flat node arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 20):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        signs = list(FEATURES.values())
        self.depth, self.base = depth, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        nodes: list[list[float]] = []  # feature, threshold, left, right, value
        self.roots = []
        margin = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            self.roots.append(self._grow(nodes, x, binned, edges, signs, y - p, p * (1 - p), np.arange(len(y)), depth, -np.inf, np.inf, rate, least))
            self._freeze(nodes)
            margin += self._one(x, self.roots[-1])
        self._freeze(nodes)
        self.roots = np.array(self.roots)

    def _freeze(self, nodes):
        a = np.array(nodes)
        self.feature, self.threshold, self.left, self.right, self.value = a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4]

    def _grow(self, nodes, x, binned, edges, signs, g, h, rows, depth, low, high, rate, least):
        me = len(nodes)
        leaf = float(np.clip(g[rows].sum() / (h[rows].sum() + 1.0), low, high))
        nodes.append([0, np.inf, me, me, rate * leaf])
        if depth == 0 or len(rows) < 2 * least:
            return me
        best = (1e-6, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        score = lambda a, b, v: 2 * a * v - (b + 1.0) * v * v
        for f, sign in enumerate(signs):
            if not len(edges[f]):
                continue
            k = len(edges[f]) + 1
            sg = np.cumsum(np.bincount(binned[rows, f], g[rows], k))[:-1]
            sh = np.cumsum(np.bincount(binned[rows, f], h[rows], k))[:-1]
            sn = np.cumsum(np.bincount(binned[rows, f], minlength=k))[:-1]
            vl, vr = np.clip(sg / (sh + 1), low, high), np.clip((total_g - sg) / (total_h - sh + 1), low, high)
            gain = score(sg, sh, vl) + score(total_g - sg, total_h - sh, vr) - score(total_g, total_h, leaf)
            gain[(sn < least) | (len(rows) - sn < least) | (sign * (vr - vl) < 0)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (f, at, vl[at], vr[at]))
        if best[1] is None:
            return me
        f, at, vl, vr = best[1]
        middle, sign = (vl + vr) / 2, signs[f]
        go = binned[rows, f] <= at
        bounds = ((low, middle), (middle, high)) if sign > 0 else ((middle, high), (low, middle)) if sign < 0 else ((low, high), (low, high))
        left = self._grow(nodes, x, binned, edges, signs, g, h, rows[go], depth - 1, *bounds[0], rate, least)
        right = self._grow(nodes, x, binned, edges, signs, g, h, rows[~go], depth - 1, *bounds[1], rate, least)
        nodes[me] = [f, edges[f][at], left, right, 0.0]
        return me

    def _one(self, x, root):
        at = np.full(len(x), root)
        for _ in range(self.depth):
            at = np.where(x[np.arange(len(x)), self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row, all trees at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Trees | None:
    """Train on at most ``train_rows`` labelled documents."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    ids = ids.orderBy(unit_hash(F.col("doc_id"), F.lit(7)), "doc_id").limit(train_rows)
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(ids), F.col("i") == F.col("doc_id"))

    def make():
        return lambda texts: [[np.array(statistics(t)[1]).tobytes() for t in texts]]

    keep = [F.col("doc_id"), F.xxhash64("t").alias("h"), F.col("q").cast("int").alias("q")]
    got = map_texts(rows, keep, F.col("t"), [("x", "binary")], make)
    got = got.groupBy("doc_id").agg(F.min(F.struct("h", "q", "x")).alias("m")).select("doc_id", "m.q", "m.x").toArrow()
    y = np.array(got.column("q").to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), float).reshape(len(y), -1)
    order = np.argsort(np.array(got.column("doc_id").to_pylist()))
    return Trees(x[order], y[order])


def assess(df: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)``."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def make():
        m = shared.value

        def one(texts):
            both = [statistics(t) for t in texts]
            base = np.array([b for b, _ in both], np.int64).reshape(-1, 5)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            score = m.score(np.array([x for _, x in both])) if m else np.ones(len(both))
            return [*base.T, failed, score, ~failed & (score >= threshold)]

        return one

    out = [(c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out += [("base_failed", "boolean"), ("score", "double"), ("kept", "boolean")]
    return map_texts(df, [F.col(id_col).alias("doc_id")], F.col(text_col), out, make)
