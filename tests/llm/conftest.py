import os

import pytest

DATA = "/root/testdata/sf0.01"

#: Columns whose names the operators use themselves.
CLASHES = "rid long, fp long, host string, w string, length long, start long, part int, n long, pii string, score double, size long, shard int, curata_words string, key string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
NOTE = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of jade and quartz near the old mill " * 3
MIXED = "Straße ÀÉ 日本語 テキスト e-mail: Jo.Doe@mail.example.org, tel +44 20 7946 0958, card 4111 1111 1111 1111, ip 10.0.0.255, Licensed under CC BY 4.0. All rights reserved! GB82 WEST 1234 5698 7654 32"
TEXTS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\r\x0b\x0c ", "en", None), (4, LONG, "en", "a"), (5, NOTE, "en", "a"),
    (6, NOTE, None, "a"), (7, NOTE + "end", "de", "b"), (8, MIXED, "xx", "b"), (8, MIXED, "xx", "b"), (None, NOTE, "en", "c"),
    (9, "1" * 30_000 + " a@b" + ".c" * 20_000 + " +1" + " (2) 3-4." * 5_000, "en", "a"), (10, "x" * 300_000, "en", "a"),
    (11, "\n".join(["same line here"] * 60), "en", "d"), (12, "a b\u00a0c\u2003d\u0085e \x1c f \x00 g", "en", "a"), (13, "word", "en", "a"),
    (14, "Word", "en", "a"), (15, "<|endoftext|> don't it's İstanbul ǅ ß ﬁ", "en", "a"), (-7, NOTE, "en", "a"),
]


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty values, long texts, repeated rows, ties, and columns with clashing names."""
    extra = (None, None, "h", "w", 3, 7, 1, 2, "p", 0.5, 9, 5, "c", "k")
    rows = [(i, t, lang, s, len(t) if t else None, *extra) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
