"""Toxicity scores from a learned lexicon, misspellings of its terms and the context of each hit.

A lexicon of words and word stems is learned from one half of a bounded sample of labelled texts. Its terms form a trie;
a Levenshtein automaton for a word is intersected with it, so all terms within the edit budget are found in one walk. The
automaton's states and steps do not depend on the word but for where its letters agree, so they are compiled once and
shared by all words; two letters that have changed places are one edit. A misspelling weighs what the labelled texts that
have it say of it, shrunk towards what misspellings of such terms say, so a common word that is near a term by chance
weighs little and one that was never seen counts like its term. Each hit is weighed by a window of its context: marks of
quotation or reported speech make it count a share, which is fitted. A logistic model over these sums is fitted on the other
half of the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.runtime import arrow_rows, discard, materialize, share

#: Labelled rows that the lexicon and the classifier are fitted on, at most; chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: A term is in at least this share of the toxic texts, and in so many of them.
LEAST_SHARE, LEAST_TEXTS = 0.02, 4
#: Least log-odds of a term.
LEAST_ODDS = 2.5
STEMS = (4, 5, 6)
#: Letters of a term from which one edit is allowed.
FUZZY_FROM = 5
#: Weight of a misspelled hit as a share of the term's, before any is seen.
EDITED = 0.7
#: Texts with a misspelling, and kinds of misspellings of a term, that count as much as what is known without them.
OWN_TEXTS, KINDS = 2.0, 2.0
#: Standard errors by which the odds of a misspelling are taken lower than they are.
DOUBT = 1.64
#: Shares of a quoted hit's weight that are tried.
QUOTED_SHARES = (0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0)
#: Bytes of context on each side of a hit.
WINDOW = 48
CUT = 0.3
#: Words that a worker remembers.
CACHE = 300_000

_BLANK = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_BLANK + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_BLANK) + b"abcdefghijklmnopqrstuvwxyz")
#: Signs of quotation or of reported speech around a hit.
_QUOTED = re.compile(
    "[\"“”„«»]|\\b(?:said|says|wrote|called|quote|quoted|according|dijo|sagte|schrieb|dit)\\b".encode(), re.IGNORECASE
)


class LevenshteinAutomaton:
    """States and steps for any word. A state is a set of (letters read beyond a base, edits so far, turned), a step reads a
    letter; ``turned`` is 1 between two letters that have changed places.

    Whether the letter equals each of the next ``2 * edits + 2`` letters of the word, as bits, is all that a step needs
    to know of the word; steps are kept as they are met.
    """

    def __init__(self, edits: int):
        self.edits, self.window = edits, 2 * edits + 2
        self.start: tuple = ((0, 0, 0),)
        self.steps: dict[tuple[tuple, int], tuple[tuple, int]] = {}

    def step(self, state: tuple, equal: int) -> tuple[tuple, int]:
        """The next state and how far its base moves on; an empty state accepts nothing more."""
        key = (state, equal)
        if key not in self.steps:
            least: dict[int, int] = {}
            turned: dict[int, int] = {}

            def reach(offset: int, edits: int, into: dict[int, int]) -> None:
                if edits <= self.edits and edits < into.get(offset, self.edits + 1):
                    into[offset] = edits

            for offset, edits, half in state:
                if half:
                    if equal >> offset & 1:
                        reach(offset + 2, edits, least)
                    continue
                reach(offset, edits + 1, least)  # a letter too many
                reach(offset + 1, edits + 1, least)  # another letter
                if equal >> offset + 1 & 1:
                    reach(offset, edits + 1, turned)
                for skipped in range(self.edits - edits + 1):  # letters left out, then the right one
                    if equal >> offset + skipped & 1:
                        reach(offset + skipped + 1, edits + skipped, least)
            kept = {(o, e, 0) for o, e in least.items() if not any(x < e and abs(p - o) <= e - x for p, x in least.items())}
            kept |= {(o, e, 1) for o, e in turned.items()}
            base = min((o for o, _, _ in kept), default=0)
            self.steps[key] = tuple(sorted((o - base, e, h) for o, e, h in kept)), base
        return self.steps[key]


class TermTrie:
    """Terms in a trie; ``near`` intersects it with the Levenshtein automaton of a word."""

    def __init__(self, terms: list[str], edits: int = 1):
        self.automaton = LevenshteinAutomaton(edits)
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
        #: Of the letters before the middle but one, and those from the middle on, an edit leaves one as it is.
        self.heads = {t[: max(1, len(t) // 2 - 1)] for t in terms}
        self.tails = {t[len(t) // 2 :] for t in terms}
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})

    def may_have(self, word: str) -> bool:
        """False only if no term is within one edit: an edit leaves one end of the term at its end of the word."""
        if self.automaton.edits > 1 or len(word) < 4:
            return True
        return any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes)

    def near(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest edits within the budget, and the edits; of several the first by alphabet."""
        step, window, size = self.automaton.step, self.automaton.window, len(word)
        best: tuple[int, str] | None = None
        stack = [(self.root, self.automaton.start, 0)]
        while stack:
            node, state, base = stack.pop()
            for c, child in node.items():
                if c == "":
                    edits = min((e + size - base - o for o, e, half in state if not half), default=self.automaton.edits + 1)
                    if edits <= self.automaton.edits and (best is None or (edits, child) < best):
                        best = (edits, child)
                    continue
                equal, at = 0, word.find(c, base, base + window)
                while at >= 0:
                    equal |= 1 << at - base
                    at = word.find(c, at + 1, base + window)
                after, moved = step(state, equal)
                after = tuple(x for x in after if base + moved + x[0] <= size) if base + moved + window > size else after
                if after:
                    stack.append((child, after, base + moved))
        return (best[1], best[0]) if best else None


class Lexicon:
    """Words and stems (``abc*``) with a weight each, and what misspellings weigh.

    ``seen`` has the texts, toxic and clean, of words near a term in the labelled texts, and ``totals`` how many texts of
    either kind there are.
    """

    def __init__(self, weights: dict[str, float], seen: dict[str, tuple[int, int]] | None = None, totals: tuple[int, int] = (0, 0)):
        self.words = {k: w for k, w in weights.items() if not k.endswith("*")}
        self.stems = {k[:-1]: w for k, w in weights.items() if k.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.trie = TermTrie(sorted(k for k in self.words if len(k) >= FUZZY_FROM))
        self.totals = totals
        self.known: dict[bytes, tuple[float, float] | None] = {}
        #: Texts and odds of misspellings that were seen; of each term the kinds of them, and their odds together.
        self.own: dict[str, tuple[int, float]] = {}
        kinds: dict[str, list[int]] = {}
        for word, (toxic, clean) in (seen or {}).items():
            term = self.misspelled(word)
            if term is not None:
                self.own[word] = (toxic + clean, self.odds(toxic, clean))
                kinds.setdefault(term, [0, 0, 0])
                kinds[term] = [a + b for a, b in zip(kinds[term], (1, toxic, clean), strict=True)]
        self.kinds = {term: (n, self.odds(toxic, clean)) for term, (n, toxic, clean) in kinds.items()}

    def odds(self, toxic: int, clean: int) -> float:
        """Log-odds of a word in the labelled texts, less its doubt, 0 at least."""
        odds = np.log((toxic + 0.5) / (self.totals[0] + 1)) - np.log((clean + 0.5) / (self.totals[1] + 1))
        return max(0.0, float(odds - DOUBT * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))))

    def exact(self, word: str) -> float | None:
        if word in self.words:
            return self.words[word]
        return next((self.stems[word[:n]] for n in self.lengths if len(word) > n and word[:n] in self.stems), None)

    def misspelled(self, word: str) -> str | None:
        """The term that a word is a misspelling of."""
        if len(word) < FUZZY_FROM - 1 or self.exact(word) is not None or not self.trie.may_have(word):
            return None
        found = self.trie.near(word)
        return found[0] if found else None

    def look_up(self, raw: bytes) -> tuple[float, bool] | None:
        """Weight of the term that a word is, and whether it is a misspelling of it; None if it is no term."""
        word = raw.decode("utf-8", "replace")
        weight = self.exact(word)
        if weight is not None:
            return weight, False
        term = self.misspelled(word)
        return None if term is None else (self.words[term], True)

    def weigh(self, raw: bytes) -> tuple[float, bool] | None:
        """Weight of a word itself, which of a misspelling is its own, and whether it is one; None if it is no term."""
        found = self.look_up(raw)
        if found is None or not found[1]:
            return found
        word = raw.decode("utf-8", "replace")
        kinds, together = self.kinds.get(self.misspelled(word), (0, 0.0))
        weight = (kinds * together + KINDS * EDITED * found[0]) / (kinds + KINDS)
        texts, odds = self.own.get(word, (0, 0.0))
        return (texts * odds + OWN_TEXTS * weight) / (texts + OWN_TEXTS), True

    def hit(self, raw: bytes) -> tuple[float, float] | None:
        """Weight of a word, and how much of a hit it is: a misspelling so much as it weighs of its term."""
        found = self.weigh(raw)
        if found is None:
            return None
        weight, misspelled = found
        return weight, min(1.0, weight / max(self.look_up(raw)[0], 1e-9)) if misspelled else 1.0

    def sums(self, text: bytes) -> list[float]:
        """Weights of the hits that read as abuse and of those in a quoting context, and the hits for each 100 words."""
        flat = text.translate(_TABLE)
        words = flat.split()
        known, hits = self.known, {}
        for w in set(words):
            if w not in known:
                if len(known) > CACHE:
                    known.clear()
                known[w] = self.hit(w)
            if known[w] is not None:
                hits[w] = known[w]
        abuse = quoted = total = 0.0
        for w, (weight, part) in hits.items():
            framed = re.compile(rb"(?:^|(?<= ))" + re.escape(w) + rb"(?= |$)")
            for m in framed.finditer(flat):
                if _QUOTED.search(text[max(0, m.start() - WINDOW) : m.end() + WINDOW]):
                    quoted += weight
                else:
                    abuse += weight
                total += part
        return [abuse, quoted, 100 * total / max(1, len(words))]

    def features(self, text: bytes, share: float = 0.3) -> list[float]:
        """Logs of: weight of the hits, of which quoted ones count a share, and weight of the quoted ones alone."""
        abuse, quoted, _ = self.sums(text)
        return [float(np.log1p(abuse + share * quoted)), float(np.log1p(quoted))]


def features(sums: np.ndarray, share: float) -> np.ndarray:
    """What the logistic model sees: logs of the weights, of which quoted ones count a share, and of the rate of hits."""
    return np.log1p(np.c_[sums[:, 0] + share * sums[:, 1], sums[:, 2]])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())],
            ["term", "toxic", "clean"],
        )
        counts.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {w.decode("utf-8", "replace") for w in (text or b"").translate(_TABLE).split()}
            for key in words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}:
                counts.setdefault(key, [0, 0])[0 if toxic else 1] += 1
        if len(counts) > CACHE:
            yield flush()
    yield flush()


def _near_words(get):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([get().misspelled(w) is not None for w in batch.column("term").to_pylist()], pa.bool_()))

    return run


def learn_lexicon(train: DataFrame) -> Lexicon:
    """The lexicon of ``train(text, toxic)``, whose size the caller bounds. Counts are summed in Spark."""
    toxic, n = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    least = max(LEAST_TEXTS, LEAST_SHARE * toxic)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (n - toxic + 1))
    counts = train.select("text", "toxic").mapInArrow(_term_counts, "term string, toxic long, clean long")
    counts = materialize(counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-counts")
    known = materialize(counts.where(F.col("toxic") >= LEAST_TEXTS).withColumn("odds", odds), "toxic-terms")
    found = known.where((F.col("toxic") >= least) & (F.col("odds") >= LEAST_ODDS))
    rows = sorted(found.collect(), key=lambda r: (-r.toxic, r.term))  # each in a stated share of the toxic texts of a bounded sample
    score = {r.term: (r.toxic, r.odds) for r in rows}
    words = {t for t in score if not t.endswith("*")}
    chosen: dict[str, float] = {}
    for stem in sorted((t for t in score if t.endswith("*")), key=len):
        body = stem[:-1]
        if any(f"{body[:n]}*" in chosen for n in STEMS if n < len(body)):
            continue
        # a stem says more than its commonest word only if it is clearly commoner
        if score[stem][0] >= 1.3 * max((score[w][0] for w in words if w.startswith(body)), default=0):
            chosen[stem] = score[stem][1]
    stems = {s[:-1] for s in chosen}
    for r in rows:
        if r.term in words and not any(r.term[:n] in stems for n in STEMS if n < len(r.term)):
            chosen[r.term] = r.odds
    # the words of a stem's family, rarer ones too, weigh what the stem does and make its misspellings known
    family = F.lit(False)
    for size in sorted(set(map(len, stems))):
        family |= (F.length("term") > size) & F.substring("term", 1, size).isin(sorted(x for x in stems if len(x) == size))
    kin = [r.term for r in known.where(family & ~F.endswith("term", F.lit("*"))).collect()]  # words of a bounded sample
    for term in kin:
        chosen[term] = next(chosen[f"{term[:n]}*"] for n in STEMS if term[:n] in stems)
    # words of the sample that are near a term, and the texts that have them
    get = share(train.sparkSession, Lexicon(chosen))
    near = counts.where(~F.endswith("term", F.lit("*")) & (F.length("term") >= FUZZY_FROM - 1)).mapInArrow(_near_words(get), "term string, toxic long, clean long")
    seen = {r.term: (r.toxic, r.clean) for r in near.collect()}
    discard(counts)
    discard(known)
    return Lexicon(chosen, seen, (toxic, n - toxic))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a logistic model with ridge penalty; the bias comes last."""
    x = np.c_[x, np.ones(len(x))]
    weights = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    weights[-1] = np.log(rate / (1 - rate))
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def log_loss(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    z = np.clip(x @ weights[:-1] + weights[-1], -30, 30)
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, quoted_share: float = 0.3):
        self.lexicon, self.weights, self.quoted_share = lexicon, weights, quoted_share

    def score(self, text: bytes) -> float:
        x = features(np.array([self.lexicon.sums(text)]), self.quoted_share)[0]
        return 1 / (1 + np.exp(-np.clip(float(x @ self.weights[:-1] + self.weights[-1]), -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit lexicon and classifier on at most ``rows`` labelled texts that are not held out."""
    spark = docs.sparkSession
    arrow_rows(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # `rows` bounds the broadcast; a repeated id in docs counts once, with its least text
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    train = train.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    train = materialize(train.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))), "toxic-train")
    lexicon = learn_lexicon(train.where("half = 0"))
    get = share(spark, lexicon)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([get().sums(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column("toxic")], ["a", "b", "c", "toxic"])

    fit = train.where("half = 1").select("text", "toxic")
    table = fit.mapInArrow(sums, "a double, b double, c double, toxic int").toPandas().to_numpy(dtype=float)  # bounded
    discard(train)
    table = table[np.lexsort(table.T)]
    tried = []
    for quoted in QUOTED_SHARES:
        x = features(table[:, :3], quoted)
        weights = fit_logistic(x, table[:, 3])
        tried.append((round(log_loss(x, table[:, 3], weights), 6), abs(quoted - 0.3), quoted, weights))
    _, _, quoted, weights = min(tried, key=lambda t: t[:3])
    return Model(lexicon, weights, quoted)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``doc_id, text``.

    A null text counts as empty and gets the score of a text without hits; a null ``doc_id`` is not held out; repeated
    rows return each; an empty table gives an empty result; without usable labels every score is the prior.
    """
    arrow_rows(docs.sparkSession)
    get = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [get().score(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
