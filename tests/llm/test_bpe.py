import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_small_leaves_agree_with_library(library, tricky):
    rng = random.Random(1)
    texts = [r.text for r in tricky.collect() if r.text]
    texts = [t[:4000] for t in texts]
    alphabet = ["a", "b", "th", "é", "日", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", "!", "?", "<|endoftext|>", " ", "😀"]
    for _ in range(150):
        some = rng.sample(alphabet, rng.randint(1, 6))
        texts.append("".join(rng.choice(some) for _ in range(rng.randint(1, 300))))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for leaf in (2, 3, 7, 16, 64):
        c = bpe.TreeCodec(open(PATH).read(), leaf_chars=leaf, window=2)
        for t, ids in zip(texts, want):
            got = c.encode_batch([t])[0]
            assert got == ids, (leaf, t[:80])
            assert c.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_one_giant_pretoken(library):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefé") for _ in range(40_000))
    c = bpe.TreeCodec(open(PATH).read(), leaf_chars=1000)
    calls, encode = [], c.tok.encode

    class Counting:
        def __getattr__(self, name):
            return getattr(tok, name)

        def encode(self, t, **kw):
            calls.append(len(t))
            return encode(t, **kw)

    tok, c.tok = c.tok, Counting()
    assert c.encode_batch([text])[0] == library.encode(text, add_special_tokens=False).ids
    assert calls and max(calls) < 2000  # windows, never the whole text again


def test_operator(library, tricky, nothing):
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.encode_digest(tricky, PATH, leaf_chars=500).collect()}
    for r in tricky.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        row = got[r.doc_id, digest]
        text = library.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids) and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_digest(nothing, PATH).count() == 0
    ids = {r.doc_id: r for r in bpe.encode(tricky.where("doc_id = 5"), PATH).collect()}
    assert ids[5].decoded == "a b c"


@pytest.mark.parametrize("spread", [40, 700, 9000])
def test_parts_of_long_texts_in_tasks_of_their_own(spark, library, tricky, spread):
    rng = random.Random(7)
    alphabet = ["a", "b", "th", "é", "日", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", "!", "?", " ", "😀"]
    extra = ["".join(rng.choice(rng.sample(alphabet, 4)) for _ in range(rng.randint(50, 900))) for _ in range(60)]
    extra += ["x" * 5000, " " * 3000, "ab " * 2000 + "<|endoftext|>" + "cd" * 50, extra[0]]
    docs = tricky.select("doc_id", "text").union(spark.createDataFrame([(None if k % 9 == 0 else k % 20, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    got = bpe.encode(docs, PATH, leaf_chars=30, spread_chars=spread).collect()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == sorted(want)
    digests = bpe.encode_digest(docs, PATH, spread_chars=spread)
    assert digests.count() == len(want) and digests.where("doc_id IS NULL").count() == sum(w[0] == "None" for w in want)
