import random

import pytest
from pyspark.sql import functions as F

#: The columns of documents, then others under names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string, key long, term string"
EXTRA = ["fp", "root", "text_hash", "spans", "size", "bucket", "target", "copies", "keep", "ids", "anchors", "score", "lang_pred", "u", "v", "x", "y", "h", "left", "edited"]

TRICKY = [
    None, "", " \t\n\x0b\x0c\r ", "x", "one two", "a b c", "a b c d", "A B C D e", "  x y",
    "mail a@b.co, c.d_e@f.g_h@i.j.k now @x.y z@ q@w", "a@b.c_d@e.f", "a@a@a.b@c.d-", "..@a.b", "%@-.-",
    "1.2.3.4 999.1.1.1 01.002.3.255 1.2.3.4.5.6.7 1.2.3 256.1.1.1 1..2.3.4 0000255.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 1111 1111 378282246310005 12 34 5",
    "+1 (988) 555-2485 x +12 +1234567890123456789 ++44 20 7946 0958. +1.2.3.4 tel+49-30-123456",
    "ünï @ é.à@x.de \U0001f600+1 (988) 555-2485\U0001f600 1.1.1.1",
    "###$$$ %%% &&& || <<>> ***", "line\nline\nline\n\n \nother\nline", "w " * 40, "a b c d e f g h i " * 3,
    "<|endoftext|>", "x <|endoftext|>\n\n<|endoftext|>y<|endof", "   lead and   trail   ", "tabs\t\tand\r\nlines\n\n\n",
    "don't we'll I'd 'tis ''''s", "日本語のテキスト。これは長い文です。", "é ‍\U0001f468‍\U0001f469",
]


def long_texts():
    rng = random.Random(5)
    letters = "abcdefghij"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return [
        " ".join(rng.choice(words) for _ in range(6000)),
        "".join(rng.choice("abcé日") for _ in range(30000)),
        "7" * 20000 + "@" + "a" * 20000 + ".b",
        " " * 9000 + "x" + "\n" * 9000 + "'" * 500,
        "a@b.co " * 1500,
    ]


def rows():
    out = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], 0, "email", 7, "x") for i, t in enumerate(TRICKY)]
    out += [(1000 + i, t, "en", "s1", 0, "ip", 7, "x") for i, t in enumerate(long_texts())]
    out += [out[9], out[9], (9, "other text, same id", None, None, None, None, None, None), (None, "no id at all here", "en", "s1", 1, None, None, None)]
    return out


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(rows(), SCHEMA).withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="session")
def small(spark):
    """The whole documents of a small generated table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
