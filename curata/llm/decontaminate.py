"""Benchmark items in training texts: a BM25 index of the items, block-max WAND, and an overlap check.

Every passage of every text is a query. A passage's score for an item is the BM25 score divided by that of the item's
own text, so it is the share of the item that the passage holds, weighted by rarity. All items at or above the threshold
are retrieved, none is left out. Before WAND runs, one vectorised pass bounds the score of each passage and item: the
exact weights of the item's rarest terms that are there plus all its other terms, which stay below the threshold. WAND
sees only the passages that could reach the threshold for some item. What it retrieves is kept if the passage holds
enough of the item's question and of its answer, each in order.

Items are grouped by length, and a group's passages are twice as long as its longest item, half overlapping: a copy of an
item lies within one passage, and a long item does not make the passages of short ones long.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from curata.runtime import arrow_rows, materialize, share

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach.
THRESHOLD = 0.5
#: Share of the words of the question, and of the answer, that must stand in the passage in order.
OVERLAP = 0.6
#: Postings in a block of a term's list.
BLOCK = 32
#: Items whose index is broadcast at once; more are taken in blocks, each against all documents.
ITEMS = 50_000
#: Terms in more items than this count as common in the vectorised bound, but for items that have too few others.
COMMON = 8
#: Words of the shortest items' group at most; every further group takes items up to so many times longer.
SHORT, LONGER = 64, 4
#: Pairs of a passage and an item that are bounded at once.
PAIRS = 1 << 22
#: A last sentence of so many words at most is part of the question.
FEW = 3

_BLANK = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_BLANK + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_BLANK) + b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """An item's last line is its answer if it has several lines, else its last sentence if it has several, else none.

    A last sentence of ``FEW`` words at most is no answer of its own but the end of the question.
    """
    for mark, least in ((b"\n", 1), (b". ", FEW + 1)):
        head, cut, tail = text.strip().rpartition(mark)
        if cut and words_of(head) and len(words_of(tail)) >= least:
            return words_of(head), words_of(tail)
    return words_of(text), []


class ItemIndex:
    """An inverted index with block maxima. Impacts are shares of the item's own score."""

    def __init__(self, items: list[tuple], df: dict[bytes, int], count: int, mean_length: float):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        self.words = [q + a for q, a in self.parts]
        group = lambda n: next(g for g in range(64) if n <= SHORT * LONGER**g)
        self.group = [group(len(w)) for w in self.words]
        #: Words from one passage of a group to the next; a passage has twice as many.
        self.strides = {g: max(len(w) for w, x in zip(self.words, self.group, strict=True) if x == g) for g in sorted(set(self.group))}
        self.masks = [tuple(_masks(part) for part in parts) for parts in self.parts]
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for k, words in enumerate(self.words):
            tf: dict[bytes, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / max(mean_length, 1))
            raw = {w: np.log1p((count - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            own = sum(raw.values())
            for w, x in raw.items():
                postings.setdefault(w, []).append((k, float(x / own)))
        self.term = {w: t for t, w in enumerate(postings)}
        self.lists = [([k for k, _ in p], [x for _, x in p]) for p in postings.values()]
        self.top = [max(x) for _, x in self.lists]
        self.block_top = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for _, x in self.lists]
        self.bounds: dict[tuple[float, int], tuple] = {}

    def bound_lists(self, threshold: float, group: int) -> tuple:
        """Flat lists for a group's bound: sizes and starts by term, items, shares, and what is left of each item.

        A term is taken for all its items if it is rare, and for single items besides: for each its rarest terms, until
        the others add up to less than ``threshold``. So a passage at the threshold holds a taken term of the item.
        Items with the same words bound the same passages, so one of them stands for all.
        """
        if (threshold, group) not in self.bounds:
            alike = {tuple(sorted(ws)): k for k, ws in reversed(list(enumerate(self.words))) if self.group[k] == group}
            terms: dict[int, list[tuple[int, int, float]]] = {k: [] for k in alike.values()}
            for t, (ks, xs) in enumerate(self.lists):
                for k, x in zip(ks, xs, strict=True):
                    if k in terms:
                        terms[k].append((len(ks), t, x))
            left = np.zeros(len(self.ids))
            taken = []
            for k, mine in terms.items():
                rest = sum(x for _, _, x in mine)
                for df, t, x in sorted(mine):
                    if df > COMMON and rest < threshold - 1e-6:
                        break
                    taken.append((t, k, x))
                    rest -= x
                left[k] = max(rest, 0.0)
            taken.sort()
            size = np.bincount(np.array([t for t, _, _ in taken], dtype=np.int64), minlength=len(self.lists) + 1)
            item = np.array([k for _, k, _ in taken], dtype=np.int64)
            self.bounds[threshold, group] = size, np.r_[0, np.cumsum(size)[:-1]], item, np.array([x for _, _, x in taken]), left
        return self.bounds[threshold, group]

    def candidates(self, ids: np.ndarray, segment: np.ndarray, last: np.ndarray, threshold: float, group: int = 0) -> np.ndarray:
        """Passages that may reach the threshold for an item of the group. ``segment`` numbers runs of words; a passage is
        a segment and the next.

        ``last`` tells of each segment whether its text ends there.
        """
        sizes, starts, items, shares, left = self.bound_lists(threshold, group)
        hit = np.flatnonzero(sizes[ids])
        kinds, n = len(sizes), len(self.ids)
        key = np.unique(segment[hit] * kinds + ids[hit])
        seg = key // kinds
        follows = (seg > 0) & ~last[np.maximum(seg - 1, 0)]  # segments that end an earlier passage
        passage, term = np.divmod(np.unique(np.r_[key, key[follows] - kinds]), kinds)  # each term once in a passage
        ends = np.cumsum(sizes[term])
        out, lo = [], 0
        while lo < len(term):  # whole passages, of so many pairs at once
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right"))
            if hi < len(term):
                first = int(np.searchsorted(passage, passage[hi]))
                hi = first if first > lo else int(np.searchsorted(passage, passage[hi], side="right"))
            t = term[lo:hi]
            size = sizes[t]
            at = np.repeat(starts[t] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
            both, place = np.unique(np.repeat(passage[lo:hi], size) * n + items[at], return_inverse=True)
            mine, item = np.divmod(both, n)
            out.append(np.unique(mine[np.bincount(place, shares[at]) + left[item] >= threshold - 1e-9]))
            lo = hi
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score at least ``threshold`` for distinct terms: document-at-a-time with block maxima."""
        theta = threshold - 1e-9
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]  # item, place in the list, term
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.top[t]
                if bound >= theta:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            blocks, ends = 0.0, []
            for _, at, t in cursors[: pivot + 1]:
                ks = self.lists[t][0]
                at = bisect_left(ks, item, at)
                if at < len(ks):
                    blocks += self.block_top[t][at // BLOCK]
                    end = (at // BLOCK + 1) * BLOCK
                    ends.append(ks[end] if end < len(ks) else len(self.ids))
            if blocks < theta:  # no item before the next block boundary or cursor can reach it
                jump = min([*ends, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.ids)])
                jump = max(jump, item + 1)
            else:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    ks, xs = self.lists[c[2]]
                    at = bisect_left(ks, item, c[1])
                    if at < len(ks) and ks[at] == item:
                        score += xs[at]
                if score >= theta:
                    found.append((item, score))
                jump = item + 1
            kept = []
            for k, c in enumerate(cursors):
                if k <= pivot:
                    ks = self.lists[c[2]][0]
                    at = bisect_left(ks, jump, c[1])
                    if at == len(ks):
                        continue
                    c = [ks[at], at, c[2]]
                kept.append(c)
            cursors = kept
        return found

    def overlap(self, item: int, passage: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and of the answer's words in their longest common subsequences with the passage."""
        (question, answer), (q, a) = self.parts[item], self.masks[item]
        return _common(q, len(question), passage) / max(1, len(question)), _common(a, len(answer), passage) / len(answer) if answer else 1.0


def _masks(words: list[bytes]) -> dict[bytes, int]:
    """The places of each word as the bits of a number."""
    out: dict[bytes, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _common(masks: dict[bytes, int], size: int, passage: list[bytes]) -> int:
    """Length of the longest common subsequence: a bit for each word of the one text, a step for each of the other."""
    full = (1 << size) - 1
    row = full
    for w in passage:
        hit = masks.get(w)
        if hit:
            taken = row & hit
            row = (row + taken | row - taken) & full
    return size - row.bit_count()


def find_items(texts: list[bytes], index: ItemIndex, threshold: float, overlap: float) -> list[dict[int, tuple]]:
    """For each text its items: ``item -> (score, question overlap, answer overlap, first word of the passage)``."""
    found: list[dict[int, tuple]] = [{} for _ in texts]
    if not index.ids:
        return found
    get, none = index.term.get, len(index.lists)
    words = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    ids = np.fromiter((get(w, none) for ws in words for w in ws), dtype=np.int64, count=int(lengths.sum()))
    starts = np.r_[0, np.cumsum(lengths)]
    within = np.arange(len(ids)) - np.repeat(starts[:-1], lengths)
    for group, stride in index.strides.items():
        segments = -(-lengths // stride)
        base = np.r_[0, np.cumsum(segments)]
        segment = np.repeat(base[:-1], lengths) + within // stride
        last = np.zeros(base[-1] + 1, dtype=bool)
        last[base[1:][segments > 0] - 1] = True
        for p in index.candidates(ids, segment, last, threshold, group):
            d = int(np.searchsorted(base, p, side="right")) - 1
            lo = int(p - base[d]) * stride
            passage = words[d][lo : lo + 2 * stride]
            terms = sorted({get(w, none) for w in passage} - {none})
            for item, score in index.wand(terms, threshold):
                if index.group[item] != group:
                    continue
                q, a = index.overlap(item, passage)
                if q >= overlap and a >= overlap and (item not in found[d] or score > found[d][item][0]):
                    found[d][item] = (score, q, a, lo)
    return found


def item_indexes(benchmark: DataFrame, limit: int = ITEMS) -> Iterator[ItemIndex]:
    """Indexes of at most ``limit`` items each, with the statistics of the whole table.

    Items without words are left out. The number of items is checked: up to ``limit`` make one index, more are dealt
    into blocks by hash.
    """
    spark = benchmark.sparkSession
    text = F.coalesce("text", F.lit(""))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = benchmark.select(F.col("item_id"), F.col("text"), words.alias("words")).where(F.size("words") > 0)
    items = materialize(items, "items")
    total = items.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    if not total.n:
        return
    df = materialize(items.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "terms")
    blocks = -(-total.n // limit)
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = [(r.item_id, r.text.encode()) for r in mine.select("item_id", "text").orderBy("item_id", "text").collect()]
        own = mine.select(F.explode("words").alias("w")).distinct()
        counts = {r.w.encode(): r.n for r in df.join(own, "w", "left_semi").collect()}
        needed = {w for _, t in rows for w in words_of(t)}
        yield ItemIndex(rows, {w: counts.get(w, 1) for w in needed}, total.n, total.mean)


def _hits_type(item_type: pa.DataType) -> pa.DataType:
    return pa.list_(
        pa.struct([("item_id", item_type), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("first_word", pa.int64())])
    )


def _hits(shared, item_kind: str, item_type: pa.DataType, threshold: float, overlap: float):
    kind = _hits_type(item_type)

    @arrow_udf(f"array<struct<item_id:{item_kind},score:double,question:double,answer:double,first_word:bigint>>")
    def hits(text: pa.Array) -> pa.Array:
        index = shared()
        found = find_items([t or b"" for t in text.cast(pa.binary()).to_pylist()], index, threshold, overlap)
        names = ("score", "question", "answer", "first_word")
        rows = [[{"item_id": index.ids[i], **dict(zip(names, x, strict=True))} for i, x in sorted(f.items())] for f in found]
        return pa.array(rows, kind)

    return hits


def _hit_columns(docs: DataFrame, benchmark: DataFrame, threshold: float, overlap: float, limit: int):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_rows(docs.sparkSession)
    field = benchmark.schema["item_id"]
    for index in item_indexes(benchmark, limit):
        shared = share(docs.sparkSession, index)
        yield _hits(shared, field.dataType.simpleString(), to_arrow_type(field.dataType), threshold, overlap)(F.col("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, limit: int = ITEMS) -> DataFrame:
    """``doc_id, item_id, score, question, answer, first_word``: the best passage of each text for each item it holds.

    Null and empty texts hold nothing, nor do items without words; repeated rows of ``docs`` return each, repeated items
    too; of passages with the same score the first counts; an empty table on either side gives an empty result.
    """
    out = None
    for column in _hit_columns(docs, benchmark, threshold, overlap, limit):
        part = docs.select("doc_id", F.explode(column).alias("hit")).select("doc_id", "hit.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = dict(docs.dtypes) | dict(benchmark.dtypes)
        schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, score double, question double, answer double, first_word bigint"
        return docs.sparkSession.createDataFrame([], schema)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, limit: int = ITEMS) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are, whatever their names.

    Null and empty texts hold nothing and stay; repeated rows stay or go together; with an empty ``benchmark``, or one of
    items without words, all rows stay; an empty table stays empty.
    """
    for column in _hit_columns(docs, benchmark, threshold, overlap, limit):
        docs = docs.where(F.size(column) == 0)
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
