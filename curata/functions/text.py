"""Text normalisation and n-grams as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions.native import let

#: Separators of the analyzer: blank, comma, full stop, question and exclamation mark, colon, semicolon, parentheses,
#: double quote, hyphen, line break and backslash.
SEPARATORS = r'[ ,.?!:;()"\n\\-]+'


def analyzed(text: Column) -> Column:
    """Lower-cased tokens of a text between the separators."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def grams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by blanks, in order."""
    return let(
        tokens,
        lambda w: F.when(
            F.size(w) >= n,
            F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")),
        ).otherwise(F.expr("cast(array() as array<string>)")),
    )


def gram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of all runs of ``n`` tokens: what is shuffled stays narrow."""
    return let(
        tokens,
        lambda w: F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, n)))
        ),
    )


def squeezed(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks.

    Most characters begin no article, so their pattern looks at the letter before it looks behind.
    """
    bare = F.regexp_replace(F.lower(text), r"""[!-/:-@\[-`{-~]""", "")
    return squeezed(F.regexp_replace(bare, r"(?=[at])(?<![\p{L}\p{N}_])(?:a|an|the)(?![\p{L}\p{N}_])", " "))


def after_last(text: Column, mark: str) -> Column:
    """What follows the last ``mark``; all of it without one."""
    return F.substring_index(text, mark, -1)


def before_first(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)
