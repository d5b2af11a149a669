"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

Every token has a class and a slot in it. The commonest words have a slot each; all others share slots by a hash of
their ending and are told apart by their corpus counts. P(token) = P(class | history) * P(slot | class, history)
* P(word | slot). Both softmax factors add up weight rows that n-gram and skip features of the history's words select by
hash, on top of the corpus' unigram logits. The number of rows follows the number of training tokens up to a bound, for
every input partition sends its table once; the counts of all distinct words are gathered without a bound. The weights are trained by gradient steps on all training texts: each input partition
takes its steps in numpy, and the partitions' weight rows are averaged by how often each saw the row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.runtime import arrow_rows, materialize, share, shuffle_width

CLASSES = SLOTS = 32
#: Words with a slot of their own, in the first classes; the other slots are shared.
OWN = CLASSES // 2 * SLOTS
#: Words whose counts every worker holds; the counts of all others are joined. This bounds what is broadcast.
HEAD = 200_000
#: Rows of weights of each factor: one for so many training tokens, between these powers of two.
TOKENS_A_ROW, LEAST_BITS, MOST_BITS = 512, 13, 15
#: Weight rows that travel together.
BLOCK = 64
#: Tokens of a gradient step, and the step size.
BATCH, RATE = 4096, 0.3
#: Words that a worker counts before it passes them on.
FLUSH = 300_000

_BOS = CLASSES * SLOTS
#: The code of what stands before the first token of a text.
_BEFORE = 0x5BD1E995


def tokens_of(text: bytes) -> list[bytes]:
    """Words between white space of one byte, A-Z lower-cased, then the end token, which is empty."""
    return [*text.lower().split(), b""]


def shared_slot(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % (_BOS - OWN)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array([shared_slot(w) for w in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            ["w", "slot", "c"],
        )
        counts.clear()
        return out

    get = counts.get
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            for w in tokens_of(text or b""):
                counts[w] = get(w, 0) + 1
            if len(counts) > FLUSH:
                yield flush()
    yield flush()


def token_counts(train: DataFrame) -> DataFrame:
    """``w, slot, c`` of every distinct token of all training texts; ``slot`` is its shared slot."""
    parts = train.select("text").mapInArrow(_count, "w string, slot int, c long")
    return parts.groupBy("w", "slot").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Slots and counts of the head words, and the totals of the shared slots."""

    def __init__(self, head: list[tuple[bytes, int]], slot_totals: dict[int, tuple[int, int]], tokens: int, distinct: int):
        self.tokens, self.distinct = tokens, distinct
        self.index = {w: i for i, (w, _) in enumerate(head)}
        self.count = np.array([c for _, c in head], dtype=np.float64)
        own = min(OWN, len(head))
        self.slot = np.array([*range(own), *(shared_slot(w) for w, _ in head[own:])], dtype=np.int64)
        #: Hashes of the words, by which they stand in histories.
        self.code = np.array([zlib.crc32(w) for w, _ in head], dtype=np.int64)
        self.row_bits = min(MOST_BITS, max(LEAST_BITS, (tokens // TOKENS_A_ROW).bit_length()))
        total = np.zeros(_BOS)
        types = np.zeros(_BOS)
        for s, (c, v) in slot_totals.items():
            total[s], types[s] = c, v
        for i in range(own):  # these words are not in their shared slots
            s = shared_slot(head[i][0])
            total[s] -= head[i][1]
            types[s] -= 1
        total[:own], types[:own] = self.count[:own], 1
        #: log10 of what the counts of a shared slot add up to, with one unseen word
        self.log_slot = np.log10(total + 0.1 * (types + 1))
        mass = (total + 0.1 * (types + 1)) * np.r_[np.arange(OWN) < own, np.ones(_BOS - OWN, bool)] + 1e-6
        grid = mass.reshape(CLASSES, SLOTS)
        self.class_bias = np.log(grid.sum(1) / grid.sum()).astype(np.float32)
        self.slot_bias = np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32)

    def look_up(self, texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each text, their head index (-1: none), slots and codes, and the number of tokens of each text."""
        words = [tokens_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        get = self.index.get
        found = chain.from_iterable(map(get, ws, repeat(-1)) for ws in words)
        ids = np.fromiter(found, dtype=np.int64, count=int(sizes.sum()))
        slots, codes = (x[ids] if len(x) else np.zeros(len(ids), dtype=np.int64) for x in (self.slot, self.code))
        tail = np.flatnonzero(ids < 0)
        if len(tail):
            starts = np.r_[0, np.cumsum(sizes)]
            text = np.searchsorted(starts, tail, side="right") - 1
            others = [words[d][p] for d, p in zip(text.tolist(), (tail - starts[text]).tolist(), strict=True)]
            slots[tail], codes[tail] = list(map(shared_slot, others)), list(map(zlib.crc32, others))
        return words, ids, slots, codes, sizes


def histories(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The codes one, two and three tokens back, a mark before the first token of a text."""
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((3, len(codes)), _BEFORE, dtype=np.int64)
    for k in (1, 2, 3):
        out[k - 1, k:] = np.where(place[k:] >= k, codes[:-k], _BEFORE)
    return out


def _row(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Multiplicative hash of numbers below 2 ** 33 to rows."""
    return ((x * 0x9E3779B1 + salt * 0x85EBCA6B) & 0xFFFFFFFF) >> 32 - bits


def class_features(h: np.ndarray, bits: int) -> np.ndarray:
    """Weight rows of the class factor: bigram, trigram, and skips over one and two tokens."""
    both = (h[0] * 0x27D4EB2F + h[1]) & 0xFFFFFFFF
    return np.stack([_row(h[0], 1, bits), _row(both, 2, bits), _row(h[1], 3, bits), _row(h[2], 4, bits)], axis=1)


def slot_features(h: np.ndarray, kind: np.ndarray, bits: int) -> np.ndarray:
    """Weight rows of the slot factor, hashed together with the class: bigram and skip."""
    with_class = lambda x: (x ^ (kind * 0xC2B2AE35)) & 0xFFFFFFFF
    return np.stack([_row(with_class(h[0]), 5, bits), _row(with_class(h[1]), 6, bits)], axis=1)


def logits(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = np.empty((len(rows), weights.shape[1]), dtype=np.float32)
    z[:] = bias
    picked = np.empty_like(z)
    for k in range(rows.shape[1]):
        np.take(weights, rows[:, k], axis=0, out=picked, mode="clip")
        z += picked
    return z


def softmax(z: np.ndarray) -> np.ndarray:
    """Probabilities, in place. The logits are log-probabilities with modest changes, so they rarely need a shift."""
    if z.max() > 60 or z.min() < -60:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def log_probability(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the softmax at the target of each row; overwrites ``z``."""
    if z.max() > 60 or z.min() < -60:
        z -= z.max(1, keepdims=True)
    at = z[np.arange(len(target)), target]
    np.exp(z, out=z)
    return at - np.log(z.sum(1))


def _run_sums(values: np.ndarray, index: np.ndarray, first: np.ndarray, times: np.ndarray, few: int = 8) -> np.ndarray:
    """Sums of ``values[index]`` over runs of ``times`` entries from ``first``: most runs are short, and are added up entry
    by entry over all of them at once; the long ones are reduced together."""
    total = np.take(values, index[first], axis=0)
    short = times <= few
    for k in range(1, few):
        more = np.flatnonzero(short & (times > k))
        if not len(more):
            break
        total[more] += np.take(values, index[first[more] + k], axis=0)
    many = np.flatnonzero(~short)
    if len(many):
        starts = np.r_[0, np.cumsum(times[many])]
        places = np.repeat(first[many] - starts[:-1], times[many]) + np.arange(starts[-1])
        total[many] = np.add.reduceat(np.take(values, index[places], axis=0), starts[:-1], axis=0)
    return total


class Trainer:
    """Gradient steps on the weight rows of one input partition, each scaled by its own past gradients."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        rows = [1 << vocabulary.row_bits] * 2
        self.weights = [np.zeros((n, SLOTS), dtype=np.float32) for n in rows]
        self.past = [np.ones(n, dtype=np.float32) for n in rows]
        self.seen = [np.zeros(n, dtype=np.float32) for n in rows]

    def step(self, which: int, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
        weights, past, seen = self.weights[which], self.past[which], self.seen[which]
        gradient = softmax(logits(bias, weights, rows))
        gradient[np.arange(len(target)), target] -= 1
        flat = rows.T.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        touched = ordered[first].astype(np.int64)
        times = np.diff(np.r_[first, len(ordered)])
        total = _run_sums(gradient, order % len(rows), first, times)
        past[touched] += np.einsum("ij,ij->i", total, total)
        total *= (RATE / np.sqrt(past[touched]))[:, None]
        weights[touched] -= total
        seen[touched] += times

    def learn(self, texts: list[bytes], seed: int) -> None:
        v = self.vocabulary
        _, _, slots, codes, sizes = v.look_up(texts)
        h = histories(codes, sizes)
        kind, slot = np.divmod(slots, SLOTS)
        rows = class_features(h, v.row_bits), slot_features(h, kind, v.row_bits)
        order = np.random.default_rng(seed).permutation(len(slots))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            self.step(0, v.class_bias, rows[0][part], kind[part])
            self.step(1, v.slot_bias[kind[part]], rows[1][part], slot[part])

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """Number and bytes (times seen, sums of weights by times seen) of each block of rows that was seen."""
        seen = np.concatenate(self.seen)
        table = np.c_[seen, np.concatenate(self.weights) * seen[:, None]].astype(np.float32)
        for b in range(0, len(table), BLOCK):
            if seen[b : b + BLOCK].any():
                yield b // BLOCK, table[b : b + BLOCK].tobytes()


def _train(get):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(get())
        for n, batch in enumerate(batches):
            trainer.learn([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], n)
        found = list(trainer.blocks())
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["block", "rows"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            x = np.frombuffer(raw, dtype=np.float32)
            sums[block] = sums[block] + x if block in sums else x.astype(np.float64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "rows"]
    )


class Model:
    def __init__(self, vocabulary: Vocabulary, weights: list[np.ndarray]):
        self.vocabulary, self.weights = vocabulary, weights

    def parts(self, texts: list[bytes]) -> tuple:
        """Of each text: tokens, tokens in the head, sum of log10(c + 0.1) of those, rest of the score, other words.

        The score is the sum of the last two figures and of log10(c + 0.1) of the other words, except that words with a
        slot of their own count nothing below the slot.
        """
        v = self.vocabulary
        words, ids, slots, codes, sizes = v.look_up(texts)
        h = histories(codes, sizes)
        kind, slot = np.divmod(slots, SLOTS)
        path = np.empty(len(slots))
        for at in range(0, len(slots), BATCH):
            part = slice(at, at + BATCH)
            k, s = kind[part], slot[part]
            path[part] = log_probability(logits(v.class_bias, self.weights[0], class_features(h[:, part], v.row_bits)), k)
            path[part] += log_probability(logits(v.slot_bias[k], self.weights[1], slot_features(h[:, part], k, v.row_bits)), s)
        path /= np.log(10)
        known = ids >= 0
        logs = np.where(known, np.log10(v.count[ids] + 0.1), 0.0) if len(v.count) else np.zeros(len(ids))
        shared = slots >= OWN
        path += np.where(shared, logs - v.log_slot[slots], 0.0)
        text = np.repeat(np.arange(len(texts)), sizes)
        total = lambda x: np.bincount(text, x, minlength=len(texts))
        tail: list[dict[bytes, int]] = [{} for _ in texts]
        starts = np.cumsum(sizes) - sizes
        for d, p in zip(text[~known].tolist(), (np.flatnonzero(~known) - starts[text[~known]]).tolist(), strict=True):
            w = words[d][p]
            tail[d][w] = tail[d].get(w, 0) + 1
        return sizes, total(known).astype(np.int64), total(logs), total(path), tail


def _score(get):
    kind = pa.list_(pa.struct([("w", pa.string()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        for batch in batches:
            sizes, known, base, path, tail = model.parts([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            others = pa.array([[{"w": w.decode(), "n": n} for w, n in x.items()] for x in tail], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), *map(pa.array, (sizes, known, base, path)), others],
                ["rid", "doc_id", "n_tokens", "n_head", "head_sum", "path", "tail"],
            )

    return run


def head_words(counts: DataFrame, head: int = HEAD) -> DataFrame:
    """``w, c`` of the commonest words, ``head`` at most; words of about one count are in or out together.

    A histogram of the counts, a thousand rows at most, tells where to cut, so no task or driver sorts the words.
    """
    level = F.floor(16 * F.log2(F.col("c").cast("double"))).cast("int")  # exact for small counts
    least, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r.n
        if held > head:
            break
        least = r.level
    return counts.select("w", "c").where(level >= least if least is not None else F.lit(False))


def train_model(train: DataFrame, counts: DataFrame, head: int = HEAD) -> Model:
    """The model of all rows of ``train(text)``; ``counts`` is their written :func:`token_counts`.

    The driver gets the ``head`` commonest words, the totals of the shared slots and the weight table, all of a fixed
    greatest size. Each input partition takes its own steps, so the weights depend a little on how the rows are split.
    """
    spark = train.sparkSession
    top = sorted(((r.w.encode(), r.c) for r in head_words(counts, head).collect()), key=lambda x: (-x[1], x[0]))
    totals = {r.slot: (r.c, r.v) for r in counts.groupBy("slot").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    vocabulary = Vocabulary(
        top, totals, sum(c for c, _ in totals.values()), sum(v for _, v in totals.values())
    )
    steps = train.select("text").mapInArrow(_train(share(spark, vocabulary)), "block int, rows binary")
    added = steps.repartition(shuffle_width(spark), "block").mapInArrow(_add_up, "block int, rows binary")
    rows = 1 << vocabulary.row_bits
    table = np.zeros((2 * rows, SLOTS + 1))
    for r in added.collect():  # the weight table, whose size is bounded
        table[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.rows, dtype=np.float64).reshape(-1, SLOTS + 1)
    mean = (table[:, 1:] / np.maximum(table[:, :1], 1)).astype(np.float32)
    return Model(vocabulary, [mean[:rows], mean[rows:]])


def scored(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """One row for each row of ``doc_id, text`` with its base and model scores, learned from the rows not held out.

    A null text counts as empty, that is one end token; a null ``doc_id`` is not held out; repeated rows count and return
    each; an empty table gives an empty result; without training rows all words are unknown. Words outside the head get
    their counts by a join on the word.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    train = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = materialize(token_counts(train), "token-counts")
    model = train_model(train, counts, head)
    kind = dict(docs.dtypes)["doc_id"]
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    parts = numbered.mapInArrow(
        _score(share(spark, model)),
        f"rid long, doc_id {kind}, n_tokens long, n_head long, head_sum double, path double, tail array<struct<w:string,n:int>>",
    )
    parts = materialize(parts, "score-parts")
    other = parts.select("rid", F.inline("tail")).join(counts.select("w", "c").hint("merge"), "w", "left")
    c = F.coalesce("c", F.lit(0))
    sums = other.groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(c + 0.1)).alias("tail_sum"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known")
    )
    v = model.vocabulary
    tail_sum, base = F.coalesce("tail_sum", F.lit(0.0)), float(np.log10(v.tokens + 0.1 * (v.distinct + 1)))
    return parts.join(sums.hint("merge"), "rid", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + tail_sum - F.col("n_tokens") * base).alias("base_score"), (F.col("path") + tail_sum).alias("score"),
    )


def op2_maxent(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

