"""Short license notices in texts, exact and with edits.

Each notice is cut into one piece more than it may have edits, so an edited copy still holds some piece unchanged. One
Aho-Corasick automaton finds all pieces in one pass; around each hit the ``regex`` library's bounded-error matching
looks for the whole notice and tells its span and number of edits. A match begins and ends at the edges of words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from curata.runtime import arrow_rows

#: Phrases that are counted exactly, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Notices that are also found with edits, as words in lower case.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the mozilla public license", "mpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("this work is dedicated to the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
]
#: Edits allowed for each so many characters of a notice.
CHARS_PER_EDIT = 12

_BLANK = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_BLANK + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_BLANK) + b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII digits and letters, lower-cased, and of anything beyond ASCII."""
    return text.translate(_TABLE).split()


class NoticeIndex:
    """Pieces of all notices in an automaton, and a bounded-error pattern for each notice."""

    def __init__(self, notices=NOTICES, phrases=PHRASES, chars_per_edit: int = CHARS_PER_EDIT):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases]
        self.notices = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (text, label) in enumerate(notices):
            flat = text.encode().decode("latin-1")
            edits = max(1, len(flat) // chars_per_edit)
            pattern = regex.compile(rf"(?b)(?<= )(?:{regex.escape(flat)}){{e<={edits}}}(?= )")
            self.notices.append((flat, label, edits, pattern))
            bounds = [len(flat) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                pieces.setdefault(flat[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def base(self, padded: bytes, blanks: np.ndarray) -> list[tuple[int, str]]:
        """(first word, label) of all exact places of the phrases in words that are joined and framed by blanks.

        ``blanks`` are the places of the blanks; word k follows the k-th of them.
        """
        places, labels = [], []
        for phrase, label in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                places.append(at)
                labels.append(label)
                at = padded.find(phrase, at + 1)
        return list(zip(np.searchsorted(blanks, places).tolist(), labels, strict=True))

    def fuzzy(self, padded: bytes, blanks: np.ndarray) -> list[tuple[int, int, str, int, float]]:
        """(first word, word after the last, label, edits, score) of the notices, from word edge to word edge; of those
        that overlap the best."""
        text = padded.decode("latin-1")  # a character for each byte
        windows: set[tuple[int, int, int]] = set()
        for end, (size, owners) in self.automaton.iter(text):
            for k, offset in owners:
                flat, _, edits, _ = self.notices[k]
                lo = max(0, end - size + 1 - offset - edits)
                hi = min(len(text), lo + len(flat) + 2 * edits + 2)
                windows.add((k, lo, hi))
        matches = set()
        for k, lo, hi in windows:  # each hit has its own: in a longer one a better copy would hide those before it
            flat, _, most, pattern = self.notices[k]
            spans = [(lo, hi)]
            while spans:
                lo, hi = spans.pop()
                m = pattern.search(text, lo, hi) if hi - lo > len(flat) - most else None
                if m and m.end() > m.start():
                    matches.add((k, m.start(), m.end(), sum(m.fuzzy_counts)))
                    spans += [(lo, m.start()), (m.end(), hi)]
        order = sorted(matches)
        firsts = np.searchsorted(blanks, [start - 1 for _, start, _, _ in order]).tolist()
        stops = np.searchsorted(blanks, [stop for _, _, stop, _ in order]).tolist()
        found = set()
        for (k, _, _, edits), first, stop in zip(order, firsts, stops, strict=True):
            flat, label, _, _ = self.notices[k]
            found.add((first, stop, label, edits, 1 - edits / len(flat)))
        kept: list[tuple[int, int, str, int, float]] = []  # in order, none overlaps another
        for x in sorted(found, key=lambda x: (-x[4], -(x[1] - x[0]), x[0], x[2])):
            at = bisect_left(kept, x)
            if (at == 0 or kept[at - 1][1] <= x[0]) and (at == len(kept) or x[1] <= kept[at][0]):
                kept.insert(at, x)
        return kept


def scan(text: bytes, index: NoticeIndex) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of a text."""
    words = words_of(text)
    padded = b" " + b" ".join(words) + b" "
    blanks = np.flatnonzero(np.frombuffer(padded, dtype=np.uint8) == 32)
    base = index.base(padded, blanks)
    fuzzy = index.fuzzy(padded, blanks)
    base_labels = sorted({x for _, x in base})
    labels = sorted({*base_labels, *(x[2] for x in fuzzy)})
    score = 1.0 if base else max((x[4] for x in fuzzy), default=0.0)
    places = [p for p, _ in base]
    return (
        len(words), len(base), min(places, default=None), max(places, default=None), ",".join(base_labels), ",".join(labels),
        score, [{"label": x[2], "first": x[0], "end": x[1], "edits": x[3]} for x in fuzzy],
    )


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first:long,end:long,edits:long>>"
)
_TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
    pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])),
]


def _scan_batches(notices, phrases, chars_per_edit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = NoticeIndex(notices, phrases, chars_per_edit)
        names = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", SCHEMA)]
        for batch in batches:
            rows = [scan(t or b"", index) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    return run


def license_scan(docs: DataFrame, notices=NOTICES, phrases=PHRASES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row for each row of ``doc_id, text``: word and phrase counts, labels, score and the fuzzy spans in words.

    ``score`` is 1 with an exact phrase, else that of the notice with the fewest edits for its length, else 0. A null
    text counts as empty; repeated rows return each; an empty table gives an empty result. Of notices that overlap, the
    one with the higher score counts, then the longer, then the earlier.
    """
    arrow_rows(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scan_batches(notices, phrases, chars_per_edit), f"doc_id {kind}, {SCHEMA}")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
