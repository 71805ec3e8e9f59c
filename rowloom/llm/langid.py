"""Hierarchical language identification.

A text's language family is predicted first, by one linear support vector
machine per family; within the family, one-versus-one linear support vector
machines between its languages vote.  Features are square-rooted relative
frequencies of hashed character 1-, 2- and 3-grams of the whole lower-cased
text, scaled to unit length; ASCII characters other than letters count as spaces.

Training uses at most about ``per_language`` documents of each language and
``TRAIN_ROWS`` in all, of the ``MAX_LANGUAGES`` languages with most documents,
taken by a hash of id and text, so that rows without an id are sampled like any
other.  It reads only their text and language.  Feature vectors of fixed size go
to the driver: at most ``TRAIN_ROWS`` times 8 KB (96 MB), laid out once for
training at twice that, of which a machine copies only its own languages' rows;
the trained model is 16 KB a machine.

A null text and a text without a letter get ``und`` and score 0; so does every
text if there is nothing to learn from.  A text of any length is read whole;
equal margins and votes go to the language that comes first by code point;
repeated rows get equal predictions; a null id is outside the held-out fold; an
empty table gives an empty result; columns other than id, text and (in training)
language are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, fold, give_back, map_texts, ship, unit_hash

UNKNOWN = "und"
DIMS = 4096
PER_LANGUAGE = 400
TRAIN_ROWS = 12_000
MAX_LANGUAGES = 200
#: ``recognised`` takes a text for another language below this share of the score that all but 1 % of training documents reach.
FLOOR = 0.47
HELD_OUT = (3, 1)

#: Language families by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga cy br gd",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt tk",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "iranian": "fa ku ps tg",
    "austronesian": "id ms tl jv mg",
    "sinitic": "zh yue",
}
_family_of = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_letter = re.compile(r"[^\W\d_]")
_space_table = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
_BLOCK = 1 << 18


def family(lang: str) -> str:
    """Family of a language code."""
    return _family_of.get(lang.split("-")[0].lower(), f"only {lang}")


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of one whole text."""
    out = np.zeros(DIMS, np.int64)
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    for at in range(0, len(codes), _BLOCK):
        c = codes[at : at + _BLOCK + 2]
        c = np.where(c < 128, _space_table[np.minimum(c, 127)], c)
        one = c[:_BLOCK] * np.uint32(2654435761)
        two = (c[:-1] * np.uint32(40503) + c[1:])[:_BLOCK] * np.uint32(2246822519)
        three = ((c[:-2] * np.uint32(40503) + c[1:-1]) * np.uint32(40503) + c[2:]) * np.uint32(3266489917)
        for h in (one, two, three):
            out += np.bincount(h >> np.uint32(20), minlength=DIMS)
    return out


def features(text: str) -> np.ndarray:
    """Unit-length feature vector."""
    x = np.sqrt(counts(text).astype(np.float32))
    return x / max(np.linalg.norm(x), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 80, ones: bool = False) -> np.ndarray:
    """Linear SVM with squared hinge loss, classes weighted equally; the last weight is the bias.

    ``ones``: the last column of ``x`` is the bias's already.
    """
    x = x if ones else np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = np.zeros(x.shape[1], x.dtype)
    v, step = w.copy(), 1.0 / (1.0 + 4 * c)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * c * ((weight * slack * y) @ x))
        v, w = new + (k / (k + 3)) * (new - w), new
    return w


class Model:
    """Family machines, then one-versus-one machines inside each family."""

    def __init__(self, x: np.ndarray, langs: list[str], ones: bool = False):
        self.langs = sorted(set(langs))
        self.families = sorted({family(v) for v in self.langs})
        of = np.array(langs)
        fam = np.array([family(v) for v in langs])
        sign = lambda m: np.where(m, 1.0, -1.0).astype(np.float32)
        self.family_w = np.array([train_svm(x, sign(fam == f), ones=ones) for f in self.families]) if len(self.families) > 1 else None
        self.members = {f: [v for v in self.langs if family(v) == f] for f in self.families}
        self.pairs = {}
        for f, own in self.members.items():
            for a, b in combinations(own, 2):
                rows = (of == a) | (of == b)
                self.pairs[a, b] = train_svm(x[rows], sign(of[rows] == a), ones=ones)
        scores = np.concatenate([self.predict(x[k : k + 1024], ones)[1] for k in range(0, len(x), 1024)])
        self.floor = FLOOR * float(np.quantile(scores, 0.01))

    def predict(self, x: np.ndarray, ones: bool = False) -> tuple[list[str], np.ndarray]:
        """Language and score of each feature row; ``ones`` as in ``train_svm``."""
        prob = lambda m: 1 / (1 + np.exp(-4 * m))
        x = x if ones else np.hstack([x, np.ones((len(x), 1), x.dtype)])
        if self.family_w is None:
            best, score = np.zeros(len(x), int), np.ones(len(x))
        else:
            m = x @ self.family_w.T
            best, score = m.argmax(axis=1), prob(m.max(axis=1))
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            own = self.members[f]
            votes = np.zeros((len(rows), len(own)))
            margin = np.full((len(rows), len(own)), np.inf)
            for (i, a), (j, b) in combinations(enumerate(own), 2):
                m = x[rows] @ self.pairs[a, b]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                margin[:, i] = np.minimum(margin[:, i], m)
                margin[:, j] = np.minimum(margin[:, j], -m)
            if len(rows):
                order = votes + np.clip(np.where(np.isinf(margin), 0, margin), -9, 9) / 100
                pick = order.argmax(axis=1)
                out[rows] = np.array(own, object)[pick]
                score[rows] *= np.where(len(own) > 1, prob(np.minimum(margin[np.arange(len(rows)), pick], 9)), 1.0)
        return out.tolist(), np.clip(score, 0.0, 1.0)


def assemble(rows: pa.Table) -> tuple[np.ndarray, list[str]]:
    """Feature rows by language, with a last column of ones, and their languages; what came in is not copied on the way."""
    langs = rows.column("l").to_pylist()
    cells = [np.frombuffer(c.as_buffer(), np.float16) for c in rows.column("x")]
    order = sorted(range(len(langs)), key=lambda k: (langs[k], cells[k][:8].astype(np.float32).tobytes()))
    x = np.ones((len(langs), DIMS + 1), np.float32)
    for to, k in enumerate(order):
        x[to, :-1] = cells[k]
    return x, [langs[k] for k in order]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] | None = HELD_OUT, per_language: int = PER_LANGUAGE) -> Model | None:
    """Train on a bounded sample of rows with a language; rows of the held-out fold are never read."""
    ids = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    ids = ids.where(F.col("l").isNotNull() & F.col("t").isNotNull())
    if held_out:
        ids = ids.where(fold(F.col("i"), held_out[0]) != held_out[1])
    counted = ids.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l").limit(MAX_LANGUAGES)
    sizes = {r["l"]: r["n"] for r in counted.collect()}
    if not sizes:
        return None
    most = min(per_language, TRAIN_ROWS // len(sizes))
    shares = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, most / n))])
    picked = ids.where(unit_hash(F.col("i"), F.col("t"), F.lit(10)) < F.element_at(shares, F.col("l")))

    def make():
        def one(texts):
            return [[features(t).astype(np.float16).tobytes() if _letter.search(t) else None for t in texts]]

        return one

    x, langs = assemble(map_texts(picked, [F.col("l")], F.col("t"), [("x", "binary")], make).where("x is not null").toArrow())
    model = Model(x, langs, ones=True) if langs else None
    del x
    give_back(df.sparkSession)
    return model


def _predictor(model: Model | None):
    """Function from texts to (languages, scores)."""

    def one(texts):
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [k for k, t in enumerate(texts) if model and t and _letter.search(t)]
        if rows:
            for k, lang, s in zip(rows, *model.predict(np.array([features(texts[k]) for k in rows]))):
                langs[k], scores[k] = lang, float(s)
        return [langs, scores]

    return one


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = [("lang_pred", "string"), ("score", "double")]
    return map_texts(df, [F.col(id_col).alias("doc_id")], F.col(text_col), out, lambda: _predictor(shared.value))


def recognised(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Rows of ``df``, all columns, whose text the machines take for a learned language.

    A text without letters is rejected, and one whose score lies well below
    that of training documents: no machine claims it, so it is in none of the
    learned languages.  Only the texts go to Python and only the verdicts
    come back; the other columns stay in the JVM.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        predict, floor = _predictor(m), m.floor if m else 0.0
        for b in batches:
            got: list[bool] = []
            for at in range(0, len(b), SLICE_ROWS):
                got += [lang != UNKNOWN and score >= floor for lang, score in zip(*predict(b.slice(at, SLICE_ROWS).to_pylist()))]
            yield pa.array(got, pa.bool_())

    return df.where(known(F.col(text_col)))
