"""Byte-level BPE encoding and decoding by tree concatenation.

Texts of up to ``leaf_chars`` code points are encoded at once by the tokenizers
library.  A longer text without split points chosen beforehand is halved until
its parts fit; all parts are encoded in parallel, then joined pairwise up the
tree.  At each join a window around the cut is encoded again and grows until it
agrees with what both sides hold:

* between pre-tokens, the window starts at the last pre-token of the left side
  that begins ``LOOK`` or more before the cut and must reach a pre-token start
  that the right side has too, ``LOOK`` or more before its own end.  The
  splitting pattern settles a pre-token's end within that distance (to tell
  ``'ll`` from ``'``), so what lies before and after stays as it is;
* within one pre-token that spans the cut, a window of the last tokens of the
  left and the first of the right must begin and end with the tokens the sides
  hold there.  A token sequence is a BPE encoding exactly if each adjacent pair
  is, so the joined sequence is the encoding of the whole.

Special tokens in a text are taken out first, as the library does.

Inside a leaf, pre-tokens are found by the definition's splitting pattern and
their ids remembered (prose repeats its words), so that the library encodes
each pre-token once per worker.  Python's pattern engine and the library agree
on the code points in ``KNOWN``; a leaf with any other is split by the library.

Parts of a text of over ``spread_chars`` code points are encoded in tasks of their
own, on whatever machines, and joined afterwards; those of a shorter one go to
the library in one call, which encodes them side by side where a task owns
several cores.

A null text counts as empty; an empty text has no tokens; texts of any length
are encoded whole; equal texts, repeated rows among them, get equal ids, and
where two merges are equally good the library's order holds; an empty table
gives an empty result; columns other than id and text are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
import json
import os
from bisect import bisect_left
from collections import ChainMap
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, map_texts, tidy

LEAF_CHARS = 16_384
#: Texts of more code points are cut into parts of at most so many, which separate tasks encode.
SPREAD_CHARS = 1 << 20
#: Code points from a pre-token's start or end within which the pattern decides it.
LOOK = 3
#: Pre-tokens remembered by a worker, and the longest that are.
MEMO, MEMO_CHARS = 600_000, 48
#: Fixed value: the splitting pattern of byte-level definitions.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Code points whose class does not depend on the Unicode version in use.
KNOWN = "\\x00-\\u0557\\u2010-\\u206f\\u20a0-\\u20bf\\u3000-\\u3029\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3"
_other = regex.compile(f"[^{KNOWN}]")
_cache: dict[str, TreeCodec] = {}


class TreeCodec:
    """Encoder and decoder over one tokenizers definition (its JSON text)."""

    def __init__(self, definition: str, leaf_chars: int = LEAF_CHARS, window: int = 8):
        self.tok = Tokenizer.from_str(definition)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf_chars, self.window = max(2, leaf_chars), max(1, window)
        self.memo: dict[str, bytes] = {}  # ids as little-endian unsigned 32-bit integers
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        size = self.tok.get_vocab_size(with_added_tokens=True)
        back = _byte_of_char()
        self.bytes_of = [b""] * size
        for piece, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = piece.encode() if piece in self.special else bytes(back[c] for c in piece)

    # -- encoding -----------------------------------------------------------
    def encode_batch(self, texts: Sequence[str]) -> list[list[int]]:
        """Token ids of each text, equal to the library's without added special tokens."""
        return [_unpacked(x) for x in self.encode_packed(texts)]

    def encode_packed(self, texts: Sequence[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if len(t) > self.leaf_chars:
                out[k] = _packed(self.encode_long(t))
            elif any(c in t for c in self.special) or _other.search(t):
                out[k] = _packed(self.tok.encode(t, add_special_tokens=False).ids)
            else:
                plain.append(k)
        pieces = [PATTERN.findall(texts[k]) for k in plain]
        ids = self._remembered({p for x in pieces for p in x})
        for k, x in zip(plain, pieces):
            out[k] = b"".join(map(ids.__getitem__, x))
        return out

    def _remembered(self, pieces: set[str]) -> Mapping[str, bytes]:
        """A table that has the packed ids of all these pre-tokens."""
        memo = self.memo
        missing = [p for p in pieces if p not in memo]
        if not missing:
            return memo
        if len(memo) + len(missing) > MEMO:
            memo.clear()
            missing = list(pieces)
        got = {p: _packed(e.ids) for p, e in zip(missing, self.tok.encode_batch_fast(missing, add_special_tokens=False))}
        memo.update((p, ids) for p, ids in got.items() if len(p) <= MEMO_CHARS)
        return memo if all(len(p) <= MEMO_CHARS for p in missing) else ChainMap(got, memo)

    def encode_long(self, text: str) -> list[int]:
        """Ids of one long text."""
        parts: list[str | int] = [text]
        for content, i in self.special.items():
            split: list[str | int] = []
            for p in parts:
                if isinstance(p, int):
                    split.append(p)
                    continue
                for n, piece in enumerate(p.split(content)):
                    split += ([i] if n else []) + [piece]
            parts = split
        out: list[int] = []
        for p in parts:
            if isinstance(p, int):
                out.append(p)
            elif p:
                for _, ids in self._tree(p):
                    out += ids
        return out

    def _tree(self, text: str) -> list[tuple[int, list[int]]]:
        """Pre-tokens (start, ids) of a text without special tokens."""
        bounds = [0, len(text)]
        while max(b - a for a, b in zip(bounds, bounds[1:])) > self.leaf_chars:
            bounds = sorted({*bounds, *((a + b) // 2 for a, b in zip(bounds, bounds[1:]) if b - a > self.leaf_chars)})
        leaves = [text[a:b] for a, b in zip(bounds, bounds[1:])]
        split = [self._split(leaf) for leaf in leaves]
        ids = self._remembered({leaf[s:e] for leaf, spans in zip(leaves, split) for s, e in spans})
        level = [(a, [(a + s, _unpacked(ids[leaf[s:e]])) for s, e in spans]) for a, leaf, spans in zip(bounds, leaves, split)]
        return self.joined(text, level)

    def joined(self, text: str, level: list[tuple[int, list[tuple[int, list[int]]]]]) -> list[tuple[int, list[int]]]:
        """Pre-tokens of a text from its parts' (start, pre-tokens), joined pairwise up the tree."""
        ends = [a for a, _ in level[1:]] + [len(text)]
        while len(level) > 1:
            joined, new_ends = [], []
            for k in range(0, len(level) - 1, 2):
                joined.append((level[k][0], self._join(text, level[k][1], level[k + 1][1], level[k + 1][0], ends[k + 1])))
                new_ends.append(ends[k + 1])
            if len(level) % 2:
                joined.append(level[-1])
                new_ends.append(ends[-1])
            level, ends = joined, new_ends
        return level[0][1]

    def _split(self, text: str) -> list[tuple[int, int]]:
        """Spans of the pre-tokens of a text without special tokens."""
        if _other.search(text):
            return [span for _, span in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return [m.span() for m in PATTERN.finditer(text)]

    def _join(self, text, left, right, cut, end):
        """Pre-tokens of text[left start:end] from those of its two sides."""
        first = len(left) - 1
        while first and left[first][0] > cut - LOOK:
            first -= 1
        begin, starts = left[first][0], [s for s, _ in right]
        ahead = 2
        while True:
            reach = starts[ahead] if ahead < len(starts) else end
            pieces = self._split(text[begin:reach])
            for s, _ in pieces:
                at = bisect_left(starts, begin + s)
                sure = reach == end or begin + s <= reach - LOOK
                if sure and begin + s >= cut and at < len(starts) and starts[at] == begin + s:
                    break
            else:
                at = None if reach < end else len(starts)
            if at is not None:
                break
            ahead *= 2
        stop = starts[at] if at < len(starts) else end
        middle = []
        for s, e in pieces:
            s, e = begin + s, begin + e
            if s >= stop:
                break
            alone = e == (starts[1] if len(starts) > 1 else end)  # the right part is one pre-token
            if first == len(left) - 1 and s == begin and s < cut < e and e - s > self.leaf_chars and alone:
                middle.append((s, self._merge(left[-1][1], right[0][1])))
            else:
                middle.append((s, self.tok.encode(text[s:e], add_special_tokens=False).ids))
        return left[:first] + middle + right[at:]

    def _merge(self, left: list[int], right: list[int]) -> list[int]:
        """Join the encodings of two adjacent parts of one pre-token."""
        a = b = self.window
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            while a < len(left) and _inside(self.bytes_of[left[-a]]):
                a += 1
            while b < len(right) and _inside(self.bytes_of[right[b]]):
                b += 1
            raw = b"".join(self.bytes_of[i] for i in (*left[len(left) - a :], *right[:b]))
            ids = self.tok.encode(raw.decode(), add_special_tokens=False).ids
            left_ok = a == len(left) or ids[0] == left[-a]
            right_ok = b == len(right) or ids[-1] == right[b - 1]
            if left_ok and right_ok:
                return left[: len(left) - a] + ids + right[b:]
            a, b = (a if left_ok else 2 * a), (b if right_ok else 2 * b)

    # -- decoding -----------------------------------------------------------
    def decode(self, ids: Sequence[int]) -> str:
        """Text of a token sequence, special tokens kept."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    return np.fromiter(ids, "<u4", len(ids)).tobytes()


def _unpacked(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def _inside(raw: bytes) -> bool:
    """Whether a token starts inside a character's UTF-8 bytes."""
    return 0x80 <= raw[0] < 0xC0


def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def codec(definition: str, leaf_chars: int = LEAF_CHARS) -> TreeCodec:
    """The codec of this Python process for a definition."""
    key = hashlib.sha256(f"{leaf_chars}:{definition}".encode()).hexdigest()
    if key not in _cache:
        _cache[key] = TreeCodec(definition, leaf_chars)
    return _cache[key]


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """``(doc_id, ids, decoded)``: ids of every whole text, and the text decoded from them.

    The definition is read on the driver and broadcast: its size is that of the
    vocabulary file, whatever the input.  The library's own threads are used
    only where a task owns several cores (``spark.task.cpus``); else tasks are
    the parallelism and threads would contend for the same cores.
    """
    return _apply(df, tokenizer_path, id_col, text_col, leaf_chars, spread_chars, digest=False)


def encode_digest(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text."""
    return _apply(df, tokenizer_path, id_col, text_col, leaf_chars, spread_chars, digest=True)


def _apply(df, tokenizer_path, id_col, text_col, leaf_chars, spread_chars, digest):
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    shared = df.sparkSession.sparkContext.broadcast(definition)
    threads = int(df.sparkSession.conf.get("spark.task.cpus", "1")) > 1
    special = [t["content"] for t in json.loads(definition).get("added_tokens", [])]

    def opened() -> TreeCodec:
        os.environ["TOKENIZERS_PARALLELISM"] = str(threads).lower()
        return codec(shared.value, leaf_chars)

    def results(c: TreeCodec, packed: list[bytes]) -> list[list]:
        ids = list(map(_unpacked, packed))
        texts = [c.decode(i) for i in ids]
        if not digest:
            return [ids, texts]
        return [
            [len(i) for i in ids],
            [hashlib.sha256(x).hexdigest() for x in packed],
            [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts],
        ]

    def make():
        c = opened()
        return lambda texts: results(c, c.encode_packed([t or "" for t in texts]))

    out = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] if digest else [("ids", "array<int>"), ("decoded", "string")]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if (rows.agg(F.max(F.char_length("text"))).first()[0] or 0) <= spread_chars:
        return map_texts(rows, [F.col("doc_id")], F.col("text"), out, make)
    # a special token may lie across a cut, so texts that hold one are not spread
    held = reduce(lambda a, b: a | b, [F.contains("text", F.lit(t)) for t in special], F.lit(False))
    far = F.coalesce((F.char_length("text") > spread_chars) & ~held, F.lit(False))
    near = map_texts(rows.where(~far), [F.col("doc_id")], F.col("text"), out, make)
    return near.unionByName(_spread(rows.where(far), opened, results, out, spread_chars))


def _spread(rows: DataFrame, opened: Callable[[], TreeCodec], results: Callable, out: list[tuple[str, str]], spread_chars: int) -> DataFrame:
    """Very long texts: their parts are encoded in tasks of their own, and joined one text a time.

    A text is cut into a power of two of parts, which are the upper levels of
    its tree.  A part's pre-tokens travel as their numbers of code points and of
    ids, and the packed ids; the task that joins holds one text and its ids.
    """
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # numbered once: the plan is not run again
    n = F.char_length("text")
    rows = rows.withColumn("parts", F.pow(F.lit(2.0), F.ceil(F.log2(n / float(spread_chars)))).cast("int"))
    rows = rows.select("doc_id", "row", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), n.alias("n"), "parts")
    begin = lambda k: F.floor(F.col("n").cast("long") * k / F.col("parts")).cast("int")
    piece = F.substring("text", begin(F.col("part")) + 1, begin(F.col("part") + 1) - begin(F.col("part")))
    pieces = rows.select("doc_id", "row", "part", piece.alias("piece")).repartition("row", "part")

    def make():
        c = opened()

        def one(texts):
            chars, sizes, ids = [], [], []
            for t in texts:
                tokens = c._tree(t)
                starts = [s for s, _ in tokens] + [len(t)]
                chars.append(np.diff(np.array(starts, "<u4")).astype("<u4").tobytes())
                sizes.append(np.array([len(x) for _, x in tokens], "<u4").tobytes())
                ids.append(b"".join(_packed(x) for _, x in tokens))
            return [texts, chars, sizes, ids]

        return one

    kinds = [("text", "string"), ("chars", "binary"), ("sizes", "binary"), ("ids", "binary")]
    encoded = map_texts(pieces, [F.col("doc_id"), F.col("row"), F.col("part")], F.col("piece"), kinds, make)
    encoded = encoded.repartition("row").sortWithinPartitions("row", "part")
    arrow = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    first = encoded.schema["doc_id"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, now, text, level, kind = None, None, [], [], None

        def done():
            whole = "".join(text)
            packed = b"".join(_packed(x) for _, x in c.joined(whole, level))
            cols = [pa.array([now[0]], type=kind), *[pa.array(v, type=arrow[t]) for v, (_, t) in zip(results(c, [packed]), out)]]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", *[name for name, _ in out]])

        for b in batches:
            kind, c = b.schema.field(0).type, c or opened()
            for k in range(b.num_rows):
                doc, row, _, piece, chars, sizes, ids = (b.column(f)[k].as_py() for f in range(7))
                if now != (doc, row):
                    if now is not None:
                        yield done()
                    now, text, level = (doc, row), [], []
                at = sum(map(len, text))
                starts = at + np.concatenate(([0], np.cumsum(np.frombuffer(chars, "<u4"))))[:-1]
                ends, flat = np.cumsum(np.frombuffer(sizes, "<u4")), _unpacked(ids)
                level.append((at, [(int(s), flat[e - m : e]) for s, e, m in zip(starts, ends.tolist(), np.frombuffer(sizes, "<u4").tolist())]))
                text.append(piece)
        if now is not None:
            yield done()

    return encoded.mapInArrow(tidy(join), ", ".join([f"doc_id {first}", *[f"{name} {t}" for name, t in out]]))
