"""Sentence boundaries with abbreviations and sentence starters learned from the texts themselves, without labels.

A type is an abbreviation if it is seen with a full stop far more than by chance (a log-likelihood ratio), is short, and
is seldom seen without one; a type is a starter if it follows the end of a sentence far more often than by chance. Both
are counts of words, added up in each task first, and only the types that pass come to the driver. Splitting is an
expression over one row: whole texts, no explosion. Starters grow with the vocabulary: a model holds the best of them, and
:func:`with_starters` brings each text those of all that it needs, by a join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.native import let
from curata.runtime import free_name

#: Scores from which a type is an abbreviation, or starts sentences.
ABBREVIATION, STARTER = 0.3, 30.0
#: Occurrences that a type needs to be either, and types of each kind that :func:`learn` holds at most, the best first.
SUPPORT, MOST = 5, 5_000
#: Share of abbreviations that keep their full stop.
KEPT = 0.99
# Abbreviations of titles and companies, which hold without any text to learn from.
TITLES = ("mr", "mrs", "ms", "dr", "st", "prof", "capt", "cpt", "lt", "inc", "ltd", "jr", "sr", "co", "ph.d")

_BLANK = r"[ \t-\r]"
_OPEN, _CLOSE = "[\"'(\\[{“‘«]+", "[\"')\\]}”’»]+"
_BREAK = "\x01"


class SentenceModel(NamedTuple):
    """``starters`` are types, or a column with an array of those that matter to the row's text."""

    abbreviations: tuple[str, ...] = TITLES
    starters: tuple[str, ...] | Column = ()


def pieces(text: Column) -> Column:
    """Words with the blanks after them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^ \t-\r]+{_BLANK}*"), 0)


def core(piece: Column) -> Column:
    """A word without blanks, brackets and quotes around it."""
    return F.regexp_replace(F.regexp_replace(piece, rf"{_BLANK}+$", ""), f"^{_OPEN}|{_CLOSE}$", "")


def word_type(word: Column) -> Column:
    """A word in lower case without its last full stop."""
    return F.lower(F.regexp_replace(word, r"\.$", ""))


def _stopped(word: Column) -> Column:
    return word.rlike(r"(^|[^.])\.$")


def _short(word: Column, abbreviations: tuple[str, ...]) -> Column:
    """A single letter with a full stop, or an abbreviation."""
    return word.rlike(r"^\p{L}\.$") | _known(word_type(word), abbreviations)


def _known(kind: Column, types: tuple[str, ...] | Column) -> Column:
    if isinstance(types, Column):
        return F.array_contains(types, kind)
    return kind.isin(list(types)) if types else F.lit(False)


def type_counts(docs: DataFrame, text: str) -> DataFrame:
    """``type, stopped, plain``: how often each type with a letter has a full stop, and has none."""
    words = docs.select(F.explode(F.transform(pieces(F.col(text)), core)).alias("w")).where(F.col("w").rlike(r"\p{L}"))
    flag = _stopped(F.col("w")).cast("long")
    return words.groupBy(word_type(F.col("w")).alias("type")).agg(F.sum(flag).alias("stopped"), F.sum(1 - flag).alias("plain"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``type, stopped, plain, score`` of ``type_counts``: the ratio of likelihoods, less for long types and for plain uses."""
    totals = counts.agg(F.sum("stopped").alias("stops"), F.sum(F.col("stopped") + F.col("plain")).alias("words"))  # one row
    rows = counts.crossJoin(F.broadcast(totals))
    k, n, p = F.col("stopped"), F.col("stopped") + F.col("plain"), F.col("stops") / F.col("words")
    chance = k * F.ln(p) + (n - k) * F.ln(F.greatest(1 - p, F.lit(1e-9)))
    bound = k * F.ln(F.lit(KEPT)) + (n - k) * F.ln(F.lit(1 - KEPT))
    letters = F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    inner = F.length("type") - letters
    score = -2 * (chance - bound) * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -F.col("plain"))
    return rows.where(k > 0).select("type", "stopped", "plain", F.round(score, 6).alias("score"))


def starter_scores(docs: DataFrame, text: str, abbreviations: tuple[str, ...]) -> DataFrame:
    """``type, starts, uses, score``: how much more often a type follows a sure end of a sentence than by chance."""

    def flagged(words: Column) -> Column:
        after = lambda i: F.when(i > 0, ends(F.get(words, i - 1))).otherwise(F.lit(False))
        return F.transform(words, lambda w, i: F.struct(word_type(w).alias("type"), F.coalesce(after(i), F.lit(False)).cast("long").alias("start")))

    def ends(w: Column) -> Column:
        return w.rlike("[?!]$") | (_stopped(w) & ~w.rlike(r"^\p{L}\.$") & ~_known(word_type(w), abbreviations))

    words = docs.select(F.explode(let(F.transform(pieces(F.col(text)), core), flagged)).alias("x")).where(F.col("x.type").rlike(r"\p{L}"))
    counts = words.groupBy("x.type").agg(F.sum("x.start").alias("starts"), F.count("*").alias("uses"))
    totals = counts.agg(F.sum("starts").alias("all_starts"), F.sum("uses").alias("words"))  # one row
    rows = counts.crossJoin(F.broadcast(totals))
    k, n, s, w = F.col("starts"), F.col("uses"), F.col("all_starts"), F.col("words")

    def likely(k: Column, n: Column, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.ln(p) + (n - k) * F.ln(1 - p)

    alike = likely(k, s, n / w) + likely(n - k, w - s, n / w)
    apart = likely(k, s, k / s) + likely(n - k, w - s, (n - k) / (w - s))
    rows = rows.where((k > 0) & (k * w > n * s))
    return rows.select("type", "starts", "uses", F.round(-2 * (alike - apart), 6).alias("score"))


def _passed(scores: DataFrame, least: float, seen: Column) -> DataFrame:
    return scores.where((F.col("score") >= least) & (seen >= SUPPORT))


def _best(scores: DataFrame, least: float, seen: Column) -> tuple[str, ...]:
    rows = _passed(scores, least, seen).orderBy(F.desc("score"), "type").limit(MOST)
    return tuple(sorted(r.type for r in rows.select("type").collect()))


def learn(docs: DataFrame, text: str = "text") -> SentenceModel:
    """Abbreviations and starters of a table; the fixed titles are among the abbreviations. Null texts count nowhere."""
    found = _best(abbreviation_scores(type_counts(docs, text)), ABBREVIATION, F.col("stopped"))
    abbreviations = tuple(sorted({*TITLES, *found}))
    return SentenceModel(abbreviations, _best(starter_scores(docs, text, abbreviations), STARTER, F.col("starts")))


def learn_all(docs: DataFrame, text: str = "text") -> tuple[tuple[str, ...], DataFrame]:
    """All abbreviations, and a table ``type`` of all starters, of which there may be any number.

    The abbreviations come to the driver, for their scores fall with the power of e of their letters: they are few (8 with
    a score of 0.3 in the 51,282 documents of the check tool's 0.1 GB, but 16,284 starters). Starters stay in Spark.
    """
    found = _passed(abbreviation_scores(type_counts(docs, text)), ABBREVIATION, F.col("stopped")).select("type").collect()
    abbreviations = tuple(sorted({*TITLES, *(r.type for r in found)}))
    return abbreviations, _passed(starter_scores(docs, text, abbreviations), STARTER, F.col("starts")).select("type")


def with_starters(docs: DataFrame, text: str, abbreviations: tuple[str, ...], starters: DataFrame, name: str) -> DataFrame:
    """``docs`` with an array ``name`` of the ``starters(type)`` that matter to each text.

    These are among the capitalised words after abbreviations and single letters, which are few. They are looked up by a join
    and come back under a hash of the text; texts of one hash share their starters, which harms none.
    """
    key = free_name(docs, "curata_text")

    def asked(words: Column) -> Column:
        after = F.transform(words, lambda w, i: F.when(_short(w, abbreviations), F.get(words, i + 1)))
        return F.array_distinct(F.transform(F.filter(after, lambda f: f.rlike(r"^\p{Lu}")), word_type))

    own = F.xxhash64(text)
    wanted = docs.select(own.alias(key), F.explode(let(F.transform(pieces(_unmarked(F.col(text))), core), asked)).alias("type")).distinct()
    known = wanted.join(starters, "type", "left_semi").groupBy(key).agg(F.collect_list("type").alias(name))
    out = docs.withColumn(key, own).join(known, key, "left").drop(key)
    return out.withColumn(name, F.coalesce(name, F.expr("cast(array() as array<string>)")))


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(_BREAK), F.lit(" "))


def split_sentences(text: Column, model: SentenceModel = SentenceModel()) -> Column:
    """The sentences of a text, trimmed; none of a null or blank one.

    A question or exclamation mark ends a sentence. A full stop does unless a word in lower case follows, and after an
    abbreviation or a single letter only if a capitalised starter follows; several full stops do before a capital.
    """

    def marked(parts: Column) -> Column:
        return let(F.transform(parts, core), lambda words: joined(parts, words))  # each word is stripped once

    def joined(parts: Column, words: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            w, following = F.get(words, i), F.get(words, i + 1)
            capital = following.rlike(r"^\p{Lu}")
            short = _short(w, model.abbreviations)
            ends = (
                F.when(F.endswith(w, F.lit("?")) | F.endswith(w, F.lit("!")), True)
                .when(~F.endswith(w, F.lit(".")), False)
                .when(F.endswith(w, F.lit("..")), capital)
                .when(short, capital & _known(word_type(following), model.starters))
                .otherwise(~following.rlike(r"^\p{Ll}"))
            )
            return F.concat(piece, F.when(ends, F.lit(_BREAK)).otherwise(""))

        return F.array_join(F.transform(parts, one), "")

    parts = F.split(let(pieces(_unmarked(text)), marked), _BREAK)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, rf"^{_BLANK}+|{_BLANK}+$", "")), lambda s: s != "")
