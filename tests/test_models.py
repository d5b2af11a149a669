"""Language and sentence models learned from small corpora: accuracy on held-out texts, cases, and plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.functions import constraints as K
from curata.operators import languages, sentences

DATA = "/root/testdata/sf0.01/documents.parquet"


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", column(F.col("t")).alias("v"))
    return [r.v for r in sorted(rows.collect())]


def test_language_accuracy(spark):
    docs = spark.read.parquet(DATA)
    held = docs.where("doc_id % 4 = 0 and lang is not null and length(text) >= 50")
    detect = languages.detector(spark, languages.learn(docs.where("doc_id % 4 <> 0")))
    got = held.agg(F.avg((detect(F.col("text")) == F.col("lang")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert got.n > 200 and got.right >= 0.97, got


def test_language_models(spark):
    """Counts do not depend on how rows are split; odd texts; languages that tie; the checks of instructions."""
    rng = random.Random(2)
    rows = [("".join(rng.choices("abcde " if i % 2 else "vwxyz ", k=40)), "ab" if i % 2 else "vz") for i in range(60)]
    rows += [(None, "ab"), ("", "vz"), ("日本", None), ("x", "vz")]
    df = spark.createDataFrame(rows, "text string, lang string")
    one, many = languages.learn(df.repartition(1)), languages.learn(df.repartition(7))
    assert one.languages == ["ab", "vz"] and np.array_equal(one.logs, many.logs)
    detect = languages.detector(spark, one)
    assert values(spark, ["abcd eeda", "xyz wvv", None, "", " ", "日本語"], detect)[:4] == ["ab", "vz", None, None]
    none = languages.learn(df.limit(0))
    assert values(spark, ["abc"], languages.detector(spark, none)) == [None]
    checks = K.with_models(detect=detect)
    assert values(spark, ["abba cab", "vwx", None], lambda t: checks["language:response_language"](t, "ab")) == [True, False, None]
    english = K.language_instructions(detect, "ab")["change_case:english_lowercase"]
    assert values(spark, ["abba cab", "Abba cab", "vwx"], english) == [True, False, False]


CASES = [
    ("Dr. Who met Mrs. Smith. They left! Did they? Yes.", ["Dr. Who met Mrs. Smith.", "They left!", "Did they?", "Yes."]),
    ("It cost 3.50 at www.example.com today. Fine", ["It cost 3.50 at www.example.com today.", "Fine"]),
    ("J. K. Rowling wrote it. (She did.) \"Really?\" he asked.", ["J. K. Rowling wrote it.", "(She did.)", "\"Really?\"", "he asked."]),
    ("Wait... what happened... Then it ended. no capital. 42 is next.", ["Wait... what happened...", "Then it ended. no capital.", "42 is next."]),
    ("  \n ", []), ("", []), (None, []), ("one", ["one"]), ("A.\nB\x01.  C", ["A.\nB .", "C"]), ("Ende. Ärger. ß. Ok", ["Ende.", "Ärger. ß. Ok"]),
]


def test_fixed_titles(spark):
    assert values(spark, [c[0] for c in CASES], sentences.split_sentences) == [c[1] for c in CASES]


def plain_scores(texts):
    """Counts and scores of abbreviations, word by word."""
    stopped, plain = {}, {}
    for text in texts:
        for w in (text or "").split():
            w = w.strip("\"'()[]{}")
            if any(c.isalpha() for c in w):
                one = w.endswith(".") and not w.endswith("..")
                kind = (w[:-1] if w.endswith(".") else w).lower()
                (stopped if one else plain)[kind] = (stopped if one else plain).get(kind, 0) + 1
    stops, words = sum(stopped.values()), sum(stopped.values()) + sum(plain.values())
    out = {}
    for kind, k in stopped.items():
        n, p, letters = k + plain.get(kind, 0), stops / words, len(kind.replace(".", ""))
        ratio = -2 * (k * math.log(p) + (n - k) * math.log(1 - p) - k * math.log(0.99) - (n - k) * math.log(0.01))
        out[kind] = ratio * math.exp(-letters) * (len(kind) - letters + 1) * letters ** -(n - k)
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    """Sentences that begin with a few words, and an abbreviation that only this corpus has."""
    rng, rows = random.Random(4), []
    nouns = ["river", "market", "teacher", "window", "garden", "letter"]
    for i in range(400):
        say = lambda: f"{rng.choice(['The', 'However', 'Nobody'])} {rng.choice(nouns)} saw xqz. {rng.choice(['Miller', 'Jones'])} near the {rng.choice(nouns)}."
        rows.append((i, " ".join(say() for _ in range(3))))
    rows += [(900, None), (901, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_abbreviation_scores(spark, corpus):
    got = {r.type: r.score for r in sentences.abbreviation_scores(sentences.type_counts(corpus, "text")).collect()}
    want = plain_scores([r.text for r in corpus.collect()])
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-4 * max(1, abs(want[k])) for k in got)


def test_learned_model(spark, corpus):
    """``xqz.`` is an abbreviation, sentence starters end a sentence after it, and names do not."""
    model = sentences.learn(corpus)
    assert "xqz" in model.abbreviations and not {"river", "garden"} & set(model.abbreviations)
    assert {"the", "however", "nobody"} <= set(model.starters) and "miller" not in model.starters
    split = lambda t: sentences.split_sentences(t, model)
    texts = ["The river saw xqz. Miller near it. However it saw xqz. Nobody came.", corpus.where("doc_id = 3").first().text]
    got = values(spark, texts, split)
    assert got[0] == ["The river saw xqz. Miller near it.", "However it saw xqz.", "Nobody came."] and len(got[1]) == 3
    count = K.with_models(split)["length_constraints:number_sentences"]
    assert values(spark, texts, lambda t: count(t, 3, "at least")) == [True, True]
    assert sentences.learn(corpus.limit(0)) == sentences.SentenceModel(tuple(sorted(sentences.TITLES)), ())


def test_all_starters_count(spark, corpus, monkeypatch):
    """A model may hold a few starters only, but the table has all of them; null, empty and equal texts keep their rows."""
    monkeypatch.setattr(sentences, "MOST", 1)
    assert len(sentences.learn(corpus).starters) == 1
    abbreviations, starters = sentences.learn_all(corpus)
    assert "xqz" in abbreviations and {"the", "however", "nobody"} <= {r.type for r in starters.collect()}
    texts = [f"The river saw xqz. {w} came." for w in ("The", "However", "Nobody", "Miller", "However")] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rows = sentences.with_starters(rows, "t", abbreviations, starters, "known")
    split = sentences.split_sentences(F.col("t"), sentences.SentenceModel(abbreviations, F.col("known")))
    assert [r.n for r in rows.select("i", F.size(split).alias("n")).orderBy("i").collect()] == [2, 2, 2, 1, 2, 0, 0]
