"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, kind number, kind, end) of the base kinds."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        if kind == "email" and "@" not in (text or ""):  # the pattern is quadratic in long runs
            continue
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def pii_row(text: str | None) -> tuple:
    spans = pii(text)
    n = Counter(s[2] for s in spans)
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
    return (*(n[k] for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest())


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def fingerprint(text: str | None) -> int:
    """Majority bits of the hashes of the 4-word shingles."""
    import xxhash

    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def shingles(text: str | None, width: int = 5) -> frozenset[str]:
    """The set of word shingles; the whole text if it has fewer words."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def similar_pairs(sets: dict, least: float) -> list[tuple]:
    """(a, b, Jaccard similarity) of all pairs of keys that share a shingle and reach ``least``."""
    where: dict = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    common: Counter = Counter()
    for ids in where.values():
        common.update((a, b) for k, b in enumerate(ids) for a in ids[:k])
    out = [(a, b, n / (len(sets[a]) + len(sets[b]) - n)) for (a, b), n in common.items()]
    return [x for x in out if x[2] >= least]


def components(prints: list[int], budget: int = 4) -> list[int]:
    """Index of the first member of each item's component; every two are compared."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def licenses(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def unigram(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """n_tokens, n_known, train_tokens, base score, held out of documents with distinct ids."""
    import zlib
    from math import log10

    def tokens(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [*WORD.findall(lower), None]

    out_of = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    count = Counter(t for i, text in docs if not out_of[i] for t in tokens(text))
    n, v = sum(count.values()), len(count)
    out = {}
    for i, text in docs:
        ts = tokens(text)
        score = sum(log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        out[i] = (len(ts), sum(count[t] > 0 for t in ts), n, score, out_of[i])
    return out
