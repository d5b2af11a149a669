"""Instruction-following constraints as boolean columns, by the names under which data sets list them.

``FUNCTIONS`` holds the older functions, ``INSTRUCTIONS`` the registered instruction ids. Instructions about languages and
sentences are made for a detector and a splitter, see :func:`with_models`, which may be learned from texts
(``curata.operators.languages`` and ``sentences``). Without them sentences come from a pattern, and languages have no check.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions.native import BLANKS, let

W = r"[\p{L}\p{N}_]"
TOKEN = rf"{W}+|[^\p{{L}}\p{{N}}_\s]"
Check = Callable[..., Column]

#: Characters in which :func:`unique_tokens` first looks for a repeated token.
HEAD = 512


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Words and single marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), 0))


def reaches(text: Column, others: str, unit: str, n: int) -> Column:
    """Whether a text has ``n`` units, each after any number of other things.

    The pattern stops at the last unit needed and makes no array. Its loops are possessive: they never look back, and need no
    stack however long the text is.
    """
    return text.rlike(rf"\A(?:(?:{others})*+{unit}){{{max(n, 0)}}}+")


def letters(text: Column) -> Callable[[int], Column]:
    """Whether a text has at least so many ASCII letters."""
    return lambda n: reaches(text, "[^a-zA-Z]", "[a-zA-Z]", n)


def whole_words(text: Column, chars: str = W) -> Callable[[int], Column]:
    """Whether a text has at least so many words made of a class of word characters only."""
    return lambda n: reaches(text, rf"[^\p{{L}}\p{{N}}_]+|(?!{chars}+(?!{W})){W}+", f"{chars}+(?!{W})", n)


def capital_words(text: Column) -> Column:
    """How many tokens upper case leaves and lower case changes.

    In ASCII texts a pattern finds them. In others, words without small ASCII letters and marks beyond ASCII are taken out and
    compared. Java looks behind by 16 bits, so that it is two for one character beyond them.
    """
    ascii = count(text, r"(?=[A-Z0-9_])(?<!\w)[0-9_]*[A-Z][A-Z0-9_]*(?!\w)")
    big = rf"(?!.[a-z])(?<!{W}{{1,2}})[\p{{L}}\p{{N}}_&&[^a-z]]++(?!{W})"
    some = F.regexp_extract_all(text, F.lit(rf"(?=[A-Z0-9_\x{{80}}-\x{{10FFFF}}])(?:{big}|[^\x00-\x7F\p{{L}}\p{{N}}])"), 0)
    capital = F.size(F.filter(some, lambda w: (w == F.upper(w)) & (w != F.lower(w))))
    return F.when(F.octet_length(text) == F.length(text), ascii).otherwise(capital)


def compared(n: Column, relation: str, limit: float, around: float = 0) -> Column:
    if relation in ("at least",):
        return n >= limit
    if relation in ("less than",):
        return n < limit
    if relation == "at most":
        return n <= limit
    return F.abs(n - limit) <= around


def bounded(reached: Callable[[int], Column], relation: str, limit: float, around: float = 0) -> Column:
    """:func:`compared` for a number of which only is known whether it is ``n`` or more."""
    if relation == "at least":
        return reached(math.ceil(limit))
    if relation == "less than":
        return ~reached(math.ceil(limit))
    if relation == "at most":
        return ~reached(math.floor(limit) + 1)
    return reached(math.ceil(limit - around)) & ~reached(math.floor(limit + around) + 1)


def whole_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    Spark's parser stops after the first value and takes what follows for granted. So the text is parsed again as the first
    of two elements, of which the second is the text's digest: it is only found there if one value ends right before it.
    """
    digest = F.md5(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    return F.try_parse_json(text).isNotNull() & F.coalesce(F.try_variant_get(pair, "$[1]", "string") == digest, F.lit(False))


def literal(word: str) -> str:
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", word)


# the older functions

def verify_keywords(t: Column, keyword_list: list[str]) -> Column:
    ok = F.lit(True)
    for k in keyword_list:
        ok = ok & F.contains(F.lower(t), F.lit(k.lower()))
    return ok


def verify_keyword_frequency(t: Column, word: str, N: int) -> Column:
    return F.size(F.filter(F.regexp_extract_all(F.lower(t), F.lit(f"{W}+"), 0), lambda x: x == word.lower())) == N


def validate_forbidden_words(t: Column, forbidden_words: list[str]) -> Column:
    ok = F.lit(True)
    for k in forbidden_words:
        ok = ok & ~F.contains(F.lower(t), F.lit(k.lower()))
    return ok


def verify_letter_frequency(t: Column, letter: str, N: int) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit(letter), F.lit(""))) == N


def verify_paragraph_count(t: Column, N: int) -> Column:
    parts = F.split(F.array_join(F.transform(lines(t), lambda x: F.trim(x)), "\n"), r"\* \* \*")
    return (F.size(parts) == N) & F.forall(parts, lambda p: F.regexp_replace(p, r"\s", "") != "")


def validate_word_constraint(t: Column, N: int, quantifier: str) -> Column:
    return compared(F.size(split_words(t)), quantifier, N, max(round(N * 0.1), 1))


def verify_sentence_constraint(t: Column, N: int, quantifier: str) -> Column:
    return compared(F.size(F.split(t, r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s")), quantifier, N, 1)


def validate_paragraphs(t: Column, N: int, first_word: str, i: int) -> Column:
    parts = F.split(t, "\n\n")
    return (F.size(parts) == N) & F.coalesce(F.startswith(F.ltrim(F.get(parts, F.lit(i - 1))), F.lit(first_word)), F.lit(False))


def verify_postscript(t: Column, postscript_marker: str) -> Column:
    at = F.locate(postscript_marker, t)
    rest = F.trim(F.substring(t, at, F.length(t)))
    return (at > 0) & (F.length(rest) > len(postscript_marker))


def validate_sections(t: Column, N: int, section_splitter: str) -> Column:
    parts = F.split(t, literal(section_splitter))
    return F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") == N


def validate_two_responses(t: Column) -> Column:
    parts = F.split(t, r"\*\*\*\*\*\*")
    return (F.size(parts) == 2) & (F.trim(F.get(parts, F.lit(0))) != F.trim(F.get(parts, F.lit(1))))


def validate_frequency_capital_words(t: Column, N: int, quantifier: str) -> Column:
    return bounded(whole_words(t, "[A-Z]"), quantifier, N)


FUNCTIONS: dict[str, Check] = {
    "verify_keywords": verify_keywords,
    "verify_keyword_frequency": verify_keyword_frequency,
    "validate_forbidden_words": validate_forbidden_words,
    "verify_letter_frequency": verify_letter_frequency,
    "verify_paragraph_count": verify_paragraph_count,
    "validate_word_constraint": validate_word_constraint,
    "verify_sentence_constraint": verify_sentence_constraint,
    "validate_paragraphs": validate_paragraphs,
    "verify_postscript": verify_postscript,
    "validate_placeholders": lambda t, N: count(t, r"\[.*?\]") >= N,
    "verify_bullet_points": lambda t, N: F.size(F.filter(lines(t), lambda x: F.trim(x).rlike("^[*-]"))) == N,
    "validate_title": lambda t: t.rlike("<<.*?>>"),
    "validate_choice": lambda t, options: F.exists(F.array(*map(F.lit, options)), lambda o: F.contains(o, t)),
    "validate_highlighted_sections": lambda t, N: count(t, r"\*.*?\*") >= N,
    "validate_sections": validate_sections,
    "validate_json_format": whole_json,
    "validate_repeat_prompt": lambda t, original_prompt: F.startswith(t, F.lit(original_prompt)),
    "validate_two_responses": validate_two_responses,
    "validate_uppercase": lambda t: t == F.upper(t),
    "validate_lowercase": lambda t: t == F.lower(t),
    "validate_frequency_capital_words": validate_frequency_capital_words,
    "validate_end": lambda t, end_phrase: F.endswith(t, F.lit(end_phrase)),
    "validate_quotation": lambda t: F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"')),
    "validate_no_commas": lambda t: ~F.contains(t, F.lit(",")),
}


# the registered instruction ids

def starred_paragraphs(t: Column, n: int) -> Column:
    return _paragraphs(F.split(t, r"\s?\*\*\*\s?"), n)


def _paragraphs(parts: Column, n: int) -> Column:
    """Count without empty first and last parts; an empty part inside fails."""
    blank = lambda p: F.regexp_replace(p, r"\s", "") == ""

    def check(ps: Column) -> Column:
        last = F.size(ps) - 1
        inner = F.exists(F.transform(ps, lambda p, i: blank(p) & (i > 0) & (i < last)), lambda x: x)
        ends = F.size(F.filter(F.transform(ps, lambda p, i: blank(p) & ((i == 0) | (i == last))), lambda x: x))
        return ~inner & (F.size(ps) - ends == n)

    return let(parts, check)


def nth_paragraph_first_word(t: Column, num_paragraphs: int, nth_paragraph: int, first_word: str) -> Column:
    def check(ps: Column) -> Column:
        full = F.size(F.filter(ps, lambda p: F.trim(p) != ""))
        mine = F.regexp_extract(F.trim(F.get(ps, F.lit(nth_paragraph - 1))), "^\\S+", 0)
        word = F.lower(F.regexp_extract(F.regexp_replace(F.regexp_replace(mine, "^'+", ""), '^"+', ""), "^[^.,?!'\"]*", 0))
        return (full == num_paragraphs) & F.lit(nth_paragraph <= num_paragraphs) & F.coalesce(word == first_word.lower(), F.lit(False))

    return let(F.split(t, "\n\n"), check)


def postscript(t: Column, postscript_marker: str) -> Column:
    fixed = {"P.P.S": r"p\.\s?p\.\s?s", "P.S.": r"p\.\s?s\."}
    return F.lower(t).rlike(fixed.get(postscript_marker, postscript_marker.lower()))


def highlights(t: Column, n: int) -> Column:
    single = F.filter(F.regexp_extract_all(t, F.lit(r"\*[^\n*]*\*"), 0), lambda h: F.trim(F.replace(h, F.lit("*"), F.lit(""))) != "")
    double = F.filter(F.regexp_extract_all(t, F.lit(r"\*\*[^\n*]*\*\*"), 0), lambda h: F.trim(F.replace(h, F.lit("*"), F.lit(""))) != "")
    return F.size(single) + F.size(double) >= n


def json_format(t: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(t), r"^```(?:json|Json|JSON)?", ""), r"```$", "")
    return whole_json(F.trim(bare))


def two_responses(t: Column) -> Column:
    def check(ps: Column) -> Column:
        full = F.filter(F.transform(ps, lambda p: F.trim(p)), lambda p: p != "")
        last = F.size(ps) - 1
        inner = F.exists(F.transform(ps, lambda p, i: (F.trim(p) == "") & (i > 0) & (i < last)), lambda x: x)
        return ~inner & (F.size(full) == 2) & (F.get(full, F.lit(0)) != F.get(full, F.lit(1)))

    return let(F.split(t, r"\*\*\*\*\*\*"), check)


def repeat_phrase(t: Column, phrase: str, small_n: int) -> Column:
    """Exactly ``small_n`` matches from first to last word, none with more than one other word, the last with one."""
    ref = phrase.split()

    def differences(m: Column) -> Column:
        return let(F.split(m, r"\s+"), lambda ws: F.when(
            F.size(ws) == len(ref), F.size(F.filter(F.zip_with(ws, F.array(*map(F.lit, ref)), lambda a, b: a != b), lambda x: x))
        ).otherwise(99))

    found = F.regexp_extract_all(t, F.lit(f"{literal(ref[0])} .*? {literal(ref[-1])}"), 0)
    return let(found, lambda ms: (F.size(ms) == small_n) & F.forall(ms, lambda m: differences(m) <= 1) & F.coalesce(differences(F.try_element_at(ms, F.lit(-1))) == 1, F.lit(False)))


def same_text(t: Column, prompt: str) -> Column:
    return F.lower(F.trim(t)) == prompt.strip().lower()


def no_adjacent_initials(t: Column) -> Column:
    def check(ws: Column) -> Column:
        code = lambda w: F.ascii(F.lower(F.substring(w, 1, 1)))
        return F.forall(F.transform(ws, lambda w, i: F.coalesce(code(F.get(ws, i + 1)) - code(w) != 1, F.lit(True))), lambda x: x)

    return let(split_words(t), check)


def wrapped_bigrams(t: Column) -> Column:
    def check(ws: Column) -> Column:
        bad = F.transform(ws, lambda w, i: (F.pmod(i, F.lit(2)) == 0) & (i + 1 < F.size(ws)) & ~(F.startswith(w, F.lit("<<")) & F.coalesce(F.endswith(F.get(ws, i + 1), F.lit(">>")), F.lit(False))))
        return ~F.exists(bad, lambda x: x)

    return let(split_words(t), check)


def bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}_\s]", ""))


def unique_tokens(t: Column) -> Column:
    """Most texts repeat a token early. Where the first ``HEAD`` characters do not, all tokens of the text are compared.

    The last token of the head is left out, for it may be part of a longer one.
    """
    unique = lambda ws: F.size(F.array_distinct(ws)) == F.size(ws)
    head = let(tokens(F.substring(t, 1, HEAD)), lambda ws: unique(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0)))))
    return head & let(tokens(t), unique)


def start_is_end(t: Column) -> Column:
    """A token is a run of word characters or a single mark, so the last one is the first of the reversed text."""
    first, last = F.regexp_extract(t, TOKEN, 0), F.reverse(F.regexp_extract(F.reverse(t), TOKEN, 0))
    return F.coalesce((F.lower(first) == F.lower(last)) & (F.trim(t, F.lit(BLANKS)) != first), F.lit(False))


def palindrome(t: Column) -> Column:
    """A word of one character is one; only texts without any have their words reversed."""
    return t.rlike(r"(?<!\S)\S(?!\S)") | F.exists(split_words(t), lambda w: w == F.reverse(w))


def bounded_word(word: str) -> str:
    """The pattern of a word that begins and ends where words do. Few characters begin it, so it is looked for before what precedes it."""
    ahead = f"(?={word})" if word.isalnum() else ""
    return rf"(?i){ahead}(?<!{W}){word}(?!{W})"


def section_count(t: Column, section_spliter: str, num_sections: int) -> Column:
    return F.size(F.split(t, rf"\s?{literal(section_spliter)}\s?\d+\s?")) - 1 >= num_sections


INSTRUCTIONS: dict[str, Check] = {
    "keywords:existence": lambda t, keywords: _all(t.rlike(f"(?i){k}") for k in keywords),
    "keywords:frequency": lambda t, keyword, frequency, relation: compared(count(t, f"(?i){keyword}"), relation, frequency),
    "keywords:forbidden_words": lambda t, forbidden_words: _all(~t.rlike(bounded_word(w)) for w in forbidden_words),
    "keywords:letter_frequency": lambda t, letter, let_frequency, let_relation: compared(F.length(t) - F.length(F.replace(F.lower(t), F.lit(letter.lower()), F.lit(""))), let_relation, let_frequency),
    "keywords:no_adjacent_consecutive": no_adjacent_initials,
    "keywords:word_once": lambda t, keyword: count(t, f"(?i){keyword}") == 1,
    "keywords:word_count_different_numbers": lambda t, keyword, frequency, relation: compared(count(t, f"(?i){keyword}"), relation, frequency),
    "keywords:exclude_word_harder": lambda t, keyword: ~F.contains(t, F.lit(f" {keyword} ")),
    "keywords:palindrome": palindrome,
    "keywords:start_end": start_is_end,
    "length_constraints:number_paragraphs": lambda t, num_paragraphs: starred_paragraphs(t, num_paragraphs),
    "length_constraints:number_words": lambda t, num_words, relation: bounded(whole_words(t), relation, num_words),
    "length_constraints:nth_paragraph_first_word": nth_paragraph_first_word,
    "detectable_content:number_placeholders": lambda t, num_placeholders: count(t, r"\[.*?\]") >= num_placeholders,
    "detectable_content:postscript": postscript,
    "detectable_format:number_bullet_lists": lambda t, num_bullets: count(t, r"(?m)^\s*\*[^*].*$") + count(t, r"(?m)^\s*-.*$") == num_bullets,
    "detectable_format:constrained_response": lambda t, options: _any(F.contains(F.trim(t), F.lit(o)) for o in options),
    "detectable_format:number_highlighted_sections": lambda t, num_highlights: highlights(t, num_highlights),
    "detectable_format:multiple_sections": section_count,
    "detectable_format:json_format": json_format,
    "detectable_format:title": lambda t: F.exists(F.regexp_extract_all(t, F.lit(r"<<[^\n]+>>"), 0), lambda x: F.trim(F.regexp_replace(x, "^<+|>+$", "")) != ""),
    "detectable_format:square_brackets": lambda t: F.forall(split_words(t), lambda w: F.startswith(w, F.lit("[")) & F.endswith(w, F.lit("]"))),
    "detectable_format:bigram_wrapping": wrapped_bigrams,
    "combination:two_responses": two_responses,
    "combination:repeat_prompt": lambda t, prompt_to_repeat: F.startswith(F.lower(F.trim(t)), F.lit(prompt_to_repeat.strip().lower())),
    "startend:end_checker": lambda t, end_phrase: F.endswith(F.lower(F.regexp_replace(F.trim(t), '^"+|"+$', "")), F.lit(end_phrase.strip().lower())),
    "startend:quotation": lambda t: (F.length(F.trim(t)) > 1) & F.startswith(F.trim(t), F.lit('"')) & F.endswith(F.trim(t), F.lit('"')),
    "change_case:capital_word_frequency": lambda t, capital_frequency, capital_relation: compared(capital_words(t), capital_relation, capital_frequency),
    "punctuation:no_comma": lambda t: ~F.contains(t, F.lit(",")),
    "punctuation:punctuation_dot": lambda t: ~F.contains(t, F.lit(".")),
    "punctuation:punctuation_exclamation": lambda t: ~F.contains(t, F.lit("!")),
    "copy:repeat_phrase": repeat_phrase,
    "copy:copy": same_text,
    "copy:copying_simple": same_text,
    "copy:copying_multiple": lambda t, prompt, n: let(F.split(t, r"\*\*\*\*\*\*"), lambda ps: (F.size(ps) == n) & F.forall(ps, lambda p: same_text(p, prompt))),
    "copy:copy_span_idx": lambda t, prompt, n_start, n_end: same_text(t, prompt[n_start:n_end]),
    "paragraphs:paragraphs": lambda t: starred_paragraphs(t, 2),
    "paragraphs:paragraphs2": lambda t: _paragraphs(F.split(t, "\n\n"), 2),
    "first_word:first_word_answer": lambda t, first_word: F.coalesce(F.lower(F.get(split_words(t), F.lit(0))) == first_word.lower(), F.lit(False)),
    "last_word:last_word_answer": lambda t, last_word: F.coalesce(bare(F.try_element_at(split_words(t), F.lit(-1))) == last_word.lower(), F.lit(False)),
    "count:lowercase_counting": lambda t, n: bounded(whole_words(t, "[a-z]"), "at most", n),
    "letters:letter_counting": lambda t, n, relation: bounded(letters(t), relation, n),
    "letters:letter_counting2": lambda t, letter, let_frequency, let_relation: compared(F.length(t) - F.length(F.replace(F.lower(t), F.lit(letter.lower()), F.lit(""))), let_relation, let_frequency),
    "count:count_unique": unique_tokens,
    "count:count_increment_word": lambda t, keyword1, keyword2: (count(t, f"(?i){keyword1}") == 1) & (count(t, f"(?i){keyword2}") == 2),
    "content:constrained_start": lambda t, starter: t.rlike(rf"(?m)^\s*{starter}.*$"),
}


def sentence_instructions(split: Callable[[Column], Column]) -> dict[str, Check]:
    """The instructions about sentences, with the function that gives the sentences of a text."""

    def composition(t: Column, n_sent: int, n_words: int) -> Column:
        parts = F.split(t, r"\s?\*\*\*\s?")
        fits = lambda p: let(split(p), lambda ss: (F.size(ss) == n_sent) & F.forall(ss, lambda s: F.size(tokens(s)) == n_words))
        return _paragraphs(parts, 3) & F.forall(parts, fits)

    def hyphenated(t: Column) -> Column:
        gold, got = split(F.replace(t, F.lit("-"), F.lit(" "))), F.split(t, "-")
        same = F.zip_with(got, gold, lambda a, b: a.isNull() | b.isNull() | ((F.trim(a) == a) & (a == b)))
        return F.forall(same, lambda x: x)

    def keyword_at(t: Column, keyword: str, n: int, m: int) -> Column:
        return F.coalesce(F.get(tokens(F.get(split(t), F.lit(n - 1))), F.lit(m - 1)) == keyword, F.lit(False))

    last = lambda s: bare(F.try_element_at(split_words(s), F.lit(-1)))
    return {
        "keywords:keyword_specific_position": keyword_at,
        "length_constraints:number_sentences": lambda t, num_sentences, relation: compared(F.size(split(t)), relation, num_sentences),
        "detectable_format:sentence_hyphens": hyphenated,
        "first_word:first_word_sent": lambda t, first_word: F.forall(split(t), lambda s: F.lower(F.get(split_words(s), F.lit(0))) == first_word.lower()),
        "last_word:last_word_sent": lambda t, last_word: F.forall(split(t), lambda s: last(s) == last_word.lower()),
        "count:counting_composition": composition,
        "content:key_sentences": lambda t, key_sentences, n: F.size(F.array_intersect(split(t), F.array(*map(F.lit, key_sentences)))) == n,
    }


def language_instructions(detect: Callable[[Column], Column], english: str = "en") -> dict[str, Check]:
    """The instructions about languages, with the function that detects the language of a text; ``english`` is its name there."""
    return {
        "validate_response_language": lambda t, language: detect(t) == language,
        "language:response_language": lambda t, language: detect(t) == language,
        "change_case:english_capital": lambda t: (t == F.upper(t)) & (t != F.lower(t)) & (detect(t) == english),
        "change_case:english_lowercase": lambda t: (t == F.lower(t)) & (t != F.upper(t)) & (detect(t) == english),
    }


def with_models(split: Callable[[Column], Column] | None = None, detect: Callable[[Column], Column] | None = None) -> dict[str, Check]:
    """``INSTRUCTIONS`` with those about sentences for ``split`` and those about languages for ``detect``."""
    return INSTRUCTIONS | (sentence_instructions(split) if split else {}) | (language_instructions(detect) if detect else {})


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def followed(text: Column, checks: list[tuple[str, dict]], registry: dict[str, Check] = INSTRUCTIONS) -> Column:
    """Share of the instructions that a text follows; 0 for an empty text, null for no instructions."""
    passed = [F.coalesce(registry[name](text, **args), F.lit(False)).cast("double") for name, args in checks]
    if not passed:
        return F.lit(None).cast("double")
    total = passed[0]
    for p in passed[1:]:
        total = total + p
    return F.when(F.trim(text) == "", 0.0).otherwise(total / len(passed))


INSTRUCTIONS |= sentence_instructions(sentences)
