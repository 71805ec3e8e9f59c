"""Toxicity: a small convolutional classifier over hashed word embeddings, in numpy.

Words are letter runs of the lower-cased text.  Each is hashed to ``BUCKETS``
twice, whole and by its first ``PREFIX`` bytes, and embedded as the sum of both
vectors, so that inflected forms share one.  A bucket gets an embedding if it
occurs in at least ``MIN_DOCS`` training documents; all others share a zero
vector that is never trained, so unseen words are neutral.
Filters of widths 1, 2 and 3 slide over the whole text, each keeps its largest
value (max pooling), and a linear layer with a logistic output follows.
Gradients run through the pooled positions only, by hand, under Adam.

A filter of width w over embeddings is a sum of w table look-ups, so scoring
needs no matrix product per word.

The decision threshold is calibrated on the training rows by language and moved
into the score, so that 0.5 is every language's threshold.  A text's language
is judged from its own function words; no column but the text enters a score.

Training reads at most ``TRAIN_ROWS`` labelled documents outside the held-out
fold, taken by a hash of their id, and leaves out those of over ``TRAIN_CHARS``
code points; only their hashed words reach the driver, 8 bytes a word.  If an id
has several texts, the one with the smallest hash is learnt; if it has several
labels, 1 counts.

A null or empty text has a score too (that of no words); a text of any length is
scored whole; texts with equal words score alike, repeated rows therefore too;
equal costs of thresholds are settled by the middle one; a null id is scored and
never learnt; without labels of both kinds every score is 0; an empty table gives
an empty result; columns other than id, text and labels are not read, whatever
their names.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_texts, unit_hash

BUCKETS = 1 << 20
TRAIN_ROWS = 5000
TRAIN_CHARS = 20_000
MIN_DOCS = 3
PREFIX = 5
WIDTHS = (1, 2, 3)
FILTERS = 6
DIMS = 8
HELD_OUT = (5, 0)

#: Frequent function words of the languages with a threshold of their own.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with was on are be this",
    "fr": "le la les de des et un une en du que qui dans pour est",
    "de": "der die das und in zu den von mit ist nicht ein eine dem auf",
    "es": "el la los las de y que en un una del por con para es",
}
_words = re.compile(rb"[a-z\x80-\xff]+")


def hashed(text: str | None) -> np.ndarray:
    """Buckets of each word of a whole text: rows for the words, and for their prefixes."""
    found = _words.findall((text or "").lower().encode("utf-8", "replace"))
    out = np.zeros((2, len(found)), np.uint32)
    out[0] = np.fromiter(map(crc32, found), np.uint32, len(found))
    out[1] = np.fromiter((crc32(w[:PREFIX], 1) if len(w) > PREFIX else 0 for w in found), np.uint32, len(found))
    return out & np.uint32(BUCKETS - 1)


class Network:
    """Embeddings, filters, and a logistic layer."""

    def __init__(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, steps: int = 300, seed: int = 2):
        rng = np.random.default_rng(seed)
        seen = np.concatenate([np.unique(d) for d in docs])
        toxic = np.repeat(y, [len(np.unique(d)) for d in docs])
        buckets, back, n = np.unique(seen, return_inverse=True, return_counts=True)
        keep = n >= MIN_DOCS
        odds = self._log_odds(np.bincount(back, toxic, len(buckets)), n, y)[keep]
        self.row_of = np.zeros(BUCKETS, np.int32)
        self.row_of[buckets[keep]] = np.arange(1, keep.sum() + 1)
        self.row_of[0] = 0  # stands for no prefix
        # embeddings start near zero, with the word's log odds along the first axis
        self.e = np.vstack([np.zeros((1, DIMS)), rng.normal(0, 0.05, (keep.sum(), DIMS))]).astype(np.float32)
        self.e[1:, 0] += odds
        self.w = [rng.normal(0, 0.3, (k, DIMS, FILTERS)).astype(np.float32) for k in WIDTHS]
        for w in self.w:
            w[:, 0, :] = np.abs(w[:, 0, :])
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        self.bias = np.array([np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)) - 1.0], np.float32)
        self.shift = dict.fromkeys(["", *FUNCTION_WORDS], 0.0)
        self.language_bits = np.zeros(len(self.e), np.uint8)
        for k, v in enumerate(FUNCTION_WORDS.values()):
            self.language_bits[np.unique(self.row_of[hashed(v)[0]])] |= 1 << k
        self.language_bits[0] = 0
        rows = [self.row_of[d] for d in docs]
        self._train(rows, y, max(epochs, -(-steps * batch // len(rows))), batch, rate, rng)
        self._calibrate(rows, y)

    @staticmethod
    def _log_odds(hits, n, y, prior: float = 5.0):
        """Log odds ratio of a word's documents against all, shrunk to 0 where it is rare."""
        base = y.mean()
        p = (hits + prior * base) / (n + prior)
        return np.clip(np.log(p / (1 - p)) - np.log(base / (1 - base)), -1.5, 4.5) / 3

    def _layout(self, rows: list[np.ndarray]):
        """One long sequence of row pairs with gaps of zero rows, and where each text begins in it."""
        gap = np.zeros((2, max(WIDTHS) - 1), np.int32)
        flat = np.concatenate([x for r in rows for x in (r, gap)], axis=1)
        ends = np.cumsum([r.shape[1] + gap.shape[1] for r in rows])
        return flat, np.concatenate([[0], ends[:-1]])

    def _pool(self, flat, starts, where=False):
        """Pooled filter values of each text, and the positions they came from."""
        pooled, at = [], []
        n = flat.shape[1]
        last = np.concatenate([starts[1:], [n]])
        used, back = np.unique(flat, return_inverse=True)
        back = back.reshape(flat.shape)
        e = self.e[used]
        for w, b in zip(self.w, self.b):
            z = np.zeros((n, FILTERS), np.float32)
            for j in range(len(w)):
                table = np.einsum("nd,df->nf", e, w[j])
                z[: n - j] += table[back[0, j:]] + table[back[1, j:]]
            top = np.maximum.reduceat(z, starts, axis=0)
            if where:
                spot = np.empty((len(starts), FILTERS), np.int64)
                for k, (a, c) in enumerate(zip(starts, last)):
                    spot[k] = a + z[a:c].argmax(axis=0)
                at.append(spot)
            pooled.append(top + b)
        return np.concatenate(pooled, axis=1), at

    def _train(self, rows, y, epochs, batch, rate, rng):
        params = [self.e, *self.w, *self.b, self.out, self.bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) ** 0.5
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                pick = order[k : k + batch]
                flat, starts = self._layout([rows[i] for i in pick])
                pooled, at = self._pool(flat, starts, where=True)
                h = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-(h @ self.out + self.bias)))
                g = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                grads = [np.zeros_like(x) for x in params]
                grads[-2], grads[-1] = h.T @ g + 1e-4 * self.out, g.sum(keepdims=True)
                dh = g[:, None] * self.out * (pooled > 0)
                for m, w in enumerate(self.w):
                    d = dh[:, m * FILTERS : (m + 1) * FILTERS]
                    grads[1 + len(self.w) + m] = d.sum(axis=0)
                    for j in range(len(w)):
                        spot = at[m] + j
                        r = flat[:, np.minimum(spot, flat.shape[1] - 1)] * (spot < flat.shape[1])
                        grads[1 + m][j] = np.einsum("nf,knfd->df", d, self.e[r])
                        np.add.at(grads[0], r, d[:, :, None] * w[j].T[None])
                grads[0][0] = 0
                step += 1
                for x, gr, a, b in zip(params, grads, first, second):
                    a += 0.1 * (gr - a)
                    b += 0.01 * (gr * gr - b)
                    x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
                self.e[0] = 0

    def _languages(self, rows):
        """Language of each text by its function words, empty if it has none."""
        names = list(FUNCTION_WORDS)
        has = np.array([[c >> k & 1 for k in range(len(names))] for c in range(1 << len(names))])
        hits = np.array([np.bincount(self.language_bits[r[0]], minlength=len(has)) for r in rows]).reshape(-1, len(has)) @ has
        return [names[k] if h else "" for k, h in zip(hits.argmax(axis=1), hits.max(axis=1))]

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        flat, starts = self._layout(rows)
        return np.maximum(self._pool(flat, starts)[0], 0) @ self.out + self.bias[0]

    def _calibrate(self, rows, y, least: int = 20):
        """Per language, the threshold that errs least on the training rows, midway between its neighbours."""
        z = np.concatenate([self.logits(rows[k : k + 256]) for k in range(0, len(rows), 256)])
        langs = np.array(self._languages(rows))
        for name in self.shift:
            own = np.ones(len(y), bool) if name == "" else langs == name
            if name and (y[own].sum() < least or (1 - y[own]).sum() < least):
                self.shift[name] = self.shift[""]
                continue
            order = np.argsort(z[own])
            zs, ys = z[own][order], y[own][order]
            wrong = np.concatenate([[0], np.cumsum(ys)]) / max(1, ys.sum()) + 0.0
            false = (len(ys) - ys.sum() - np.concatenate([[0], np.cumsum(1 - ys)])) / max(1, (1 - ys).sum())
            cost = wrong + false
            best = np.flatnonzero(cost <= cost.min() + 1e-12)
            k = int(best[len(best) // 2])
            low, high = zs[max(0, k - 1)], zs[min(len(zs) - 1, k)]
            self.shift[name] = float((low + high) / 2)

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        rows = [self.row_of[d] for d in docs]
        z = self.logits(rows) - np.array([self.shift[k] for k in self._languages(rows)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, held_out: tuple[int, int] | None = HELD_OUT) -> Network | None:
    """Train on at most ``train_rows`` labelled documents outside the held-out fold."""
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    if held_out:
        ids = ids.where(fold(F.col("doc_id"), held_out[0]) != held_out[1])
    ids = ids.orderBy(unit_hash(F.col("doc_id"), F.lit(2)), "doc_id").limit(train_rows)
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.coalesce(F.char_length("t"), F.lit(0)) <= TRAIN_CHARS)
    rows = rows.join(F.broadcast(ids), F.col("i") == F.col("doc_id"))

    def make():
        return lambda texts: [[hashed(t).tobytes() for t in texts]]

    keep = [F.col("doc_id"), F.xxhash64("t").alias("h"), F.col("y").cast("int").alias("y")]
    got = map_texts(rows, keep, F.col("t"), [("x", "binary")], make)
    got = got.groupBy("doc_id").agg(F.min(F.struct("h", "y", "x")).alias("m")).select("doc_id", "m.y", "m.x").toArrow()
    y = np.array(got.column("y").to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return None
    docs = [np.frombuffer(x, np.uint32).reshape(2, -1) for x in got.column("x").to_pylist()]
    order = np.argsort(np.array(got.column("doc_id").to_pylist()))
    return Network([docs[k] for k in order], y[order])


def score(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(network)

    def make():
        m = shared.value

        def one(texts):
            s = m.score([hashed(t) for t in texts]) if m else np.zeros(len(texts))
            return [s.astype(float), (s >= 0.5).astype(np.int32)]

        return one

    return map_texts(df, [F.col(id_col).alias("doc_id")], F.col(text_col), [("score", "double"), ("predicted", "int")], make)
