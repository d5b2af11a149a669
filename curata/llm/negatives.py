"""Hard negatives by norm-bucketed search over integer vectors.

Candidates are dealt to groups that each hold vectors of all lengths; in each group they are sorted by length, the longest
first, and come to a task as a stream that is cut into buckets. Anchors are dealt to chunks of bounded size and meet every
group. A bucket is searched for an anchor only if the bound of Cauchy and Schwarz, the anchor's length times the bucket's
largest, reaches what the anchor still needs: the score of its running k-th row, and for negatives also the lower limit of
a window. Lengths fall along the stream, so a group is done with once no anchor needs any more of it.

The running rows of all groups are at last merged by rank. Scores are exact: products of float32 or float64 where the
bound says that they hold the sums, else of 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.runtime import materialize

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these shares of its positive's, in hundredths.
LOWER, UPPER = 50, 95
#: Values of the anchors' vectors in one chunk; a chunk is held by a task, so this bounds memory.
ANCHOR_VALUES = 4_000_000
#: Groups for each core that the cluster has; with several chunks of anchors so many fewer.
GROUPS_A_CORE = 4
#: Candidates of the first bucket of a group, when nothing is known yet, and of the largest; sizes double from one to the next.
FIRST_BUCKET, LAST_BUCKET = 64, 2048
#: Anchors whose scores are computed at once.
BLOCK = 512

_NONE, _LAST = -(1 << 63), (1 << 63) - 1


def scores_of(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Inner products of the rows of ``b`` with those of ``a``, none of them above ``bound`` in size, as int64."""
    if bound < 1 << 24:
        return (b.astype(np.float32) @ a.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (b.astype(np.float64) @ a.astype(np.float64).T).astype(np.int64)
    return b @ a.T


def bounds(a: np.ndarray, longest: int) -> np.ndarray:
    """No inner product of vectors with squared lengths ``a`` and one of at most ``longest`` is above this."""
    return np.minimum(np.ceil(np.sqrt(a.astype(np.float64)) * np.sqrt(float(longest)) * (1 + 1e-12)), 2.0**62).astype(np.int64)


def share_below(score: np.ndarray, hundredths: int) -> np.ndarray:
    """``floor(score * hundredths / 100)`` without a product that could overflow."""
    return score // 100 * hundredths + score % 100 * hundredths // 100


class Best:
    """The first ``k`` rows of each query: higher scores first, ties by smaller id."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), _NONE, dtype=np.int64)
        self.id = np.full((queries, k), _LAST, dtype=np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        k, seen = self.score.shape[1], np.unique(query)
        q = np.concatenate([np.repeat(seen, k), query])
        s = np.concatenate([self.score[seen].ravel(), score])
        i = np.concatenate([self.id[seen].ravel(), ids])
        order = np.lexsort((i, ~s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        first = starts[:, None] + np.arange(k)
        self.score[seen], self.id[seen] = s[first], i[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(self.score != _NONE)
        return query, self.score[query, place], self.id[query, place]


class PositiveSearch:
    """The first other rows of the anchor's own label."""

    def __init__(self, anchors: dict, k: int):
        order = np.argsort(anchors["label"], kind="stable")
        self.rid, self.label, self.norm2, self.v = (anchors[c][order] for c in ("rid", "label", "norm2", "v"))
        self.best = Best(len(self.rid), k)

    def search(self, c: dict) -> bool:
        """Take a bucket; whether any anchor may need the next one."""
        bound = bounds(self.norm2, int(c["norm2"].max()))
        alive = bound >= self.best.score[:, -1]
        for label in np.unique(c["label"]):
            lo, hi = np.searchsorted(self.label, [label, label + 1])
            mine = np.flatnonzero(c["label"] == label)
            need = lo + np.flatnonzero(alive[lo:hi])
            for at in range(0, len(need), BLOCK):
                a = need[at : at + BLOCK]
                s = scores_of(self.v[a], c["v"][mine], int(bound[a].max()))
                kth, kth_id = self.best.score[a, -1], self.best.id[a, -1]
                ids = c["vec_id"][mine]
                row, col = np.nonzero((s > kth) | (s == kth) & (ids[:, None] < kth_id))
                other = c["rid"][mine][row] != self.rid[a][col]
                row, col = row[other], col[other]
                self.best.add(a[col], s[row, col], ids[row])
        return bool(alive.any())

    def found(self) -> dict:
        query, score, ids = self.best.rows()
        return {"rid": self.rid[query], "place": np.zeros(len(query), np.int64), "found_id": ids, "found_score": score}


class NegativeSearch:
    """The first rows of other labels in the window of each of an anchor's positives."""

    def __init__(self, anchors: dict, k: int, lower: int, upper: int):
        self.rid, self.label, self.norm2, self.v = (anchors[c] for c in ("rid", "label", "norm2", "v"))
        positive = anchors["positives"]  # padded on the right by _NONE
        real = positive != _NONE
        self.low = np.where(real, -share_below(-positive, lower), _LAST)
        self.high = np.where(real, share_below(positive, upper), _NONE)
        self.windows = positive.shape[1]
        self.best = Best(positive.size, k)

    def search(self, c: dict) -> bool:
        bound = bounds(self.norm2, int(c["norm2"].max()))
        kth = self.best.score[:, -1].reshape(-1, self.windows)
        need = np.maximum(self.low, kth).min(axis=1, initial=_LAST)
        open_ = (self.low <= self.high).any(axis=1) & (bound >= need)
        alive = np.flatnonzero(open_)
        top = self.high.max(axis=1, initial=_NONE)
        for at in range(0, len(alive), BLOCK):
            a = alive[at : at + BLOCK]
            s = scores_of(self.v[a], c["v"], int(bound[a].max()))
            row, col = np.nonzero((s >= need[a]) & (s <= top[a]))
            other = c["label"][row] != self.label[a][col]
            row, col = row[other], col[other]
            score, ids, anchor = s[row, col], c["vec_id"][row], a[col]
            for w in range(self.windows):
                query = anchor * self.windows + w
                last, last_id = self.best.score[query, -1], self.best.id[query, -1]
                fits = (score >= self.low[anchor, w]) & (score <= self.high[anchor, w])
                fits &= (score > last) | (score == last) & (ids < last_id)
                self.best.add(query[fits], score[fits], ids[fits])
        return bool(len(alive))

    def found(self) -> dict:
        query, score, ids = self.best.rows()
        return {"rid": self.rid[query // self.windows], "place": query % self.windows, "found_id": ids, "found_score": score}


def _matrix(column: pa.Array, width: int, fill: int) -> np.ndarray:
    """A list column as rows of ``width`` values, filled on the right."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if len(ends) and (ends == width).all():
        return values.reshape(len(ends), width)
    out = np.full((len(ends), width), fill, dtype=np.int64)
    out[np.arange(width) < ends[:, None]] = values
    return out


def _searcher(make, width: int, windows: int):
    """The task: a stream of (group, chunk) keys, of each first its anchors and then its candidates by falling length."""

    def arrays(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "role", "rid", "vec_id", "label", "norm2")}
        return out | {"v": _matrix(batch.column("v"), width, 0), "positives": _matrix(batch.column("positives"), windows, _NONE)}

    def joined(parts: list[dict]) -> dict:
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, anchors, held, rows, size, search, more = None, [], [], 0, FIRST_BUCKET, None, True

        def flush():
            nonlocal held, rows, search, more, size
            if not held:
                return
            if search is None:
                search = make(joined(anchors)) if anchors else None
                more = search is not None
            if more:
                more = search.search(joined(held))
            held, rows, size = [], 0, min(2 * size, LAST_BUCKET)

        def close():
            flush()
            if search is not None:
                found = search.found()
                if len(found["rid"]):
                    yield pa.RecordBatch.from_pydict({c: pa.array(found[c], pa.int64()) for c in ("rid", "place", "found_id", "found_score")})

        for batch in batches:
            a = arrays(batch)
            cuts = np.flatnonzero(np.r_[True, (a["unit"][1:] != a["unit"][:-1]) | (a["role"][1:] != a["role"][:-1])])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(a["unit"])], strict=True):
                if a["unit"][lo] != unit:
                    yield from close()
                    unit, anchors, held, rows, size, search, more = a["unit"][lo], [], [], 0, FIRST_BUCKET, None, True
                if a["role"][lo] == 0:
                    anchors.append({c: x[lo:hi] for c, x in a.items()})
                    continue
                while more and lo < hi:
                    take = min(hi - lo, size - rows)
                    held.append({c: x[lo : lo + take] for c, x in a.items()})
                    rows, lo = rows + take, lo + take
                    if rows >= size:
                        flush()
        yield from close()

    return run


def _search(rows: DataFrame, anchors: DataFrame, count: int, make, width: int, windows: int) -> DataFrame:
    """``rid, place, found_id, found_score`` that each group found for each of the ``count`` anchors."""
    spark = rows.sparkSession
    chunks = max(1, -(-count * max(width, 1) // ANCHOR_VALUES))
    groups = max(1, -(-GROUPS_A_CORE * spark.sparkContext.defaultParallelism // chunks))
    none = F.array().cast("array<long>").alias("positives")
    unit = lambda g, c: (g * F.lit(chunks) + c).cast("long").alias("unit")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("*", F.pmod(F.xxhash64("rid"), F.lit(groups)).alias("g"), each(chunks).alias("c"))
    candidates = candidates.select(unit(F.col("g"), F.col("c")), F.lit(1).alias("role"), "rid", "vec_id", "label", "norm2", "v", none)
    dealt = anchors.select("*", each(groups).alias("g"), F.pmod(F.xxhash64("rid"), F.lit(chunks)).alias("c"))
    dealt = dealt.select(unit(F.col("g"), F.col("c")), F.lit(0).alias("role"), "rid", "vec_id", "label", "norm2", "v", "positives")
    met = dealt.unionByName(candidates).repartition(groups * chunks, "unit")
    met = met.sortWithinPartitions("unit", "role", F.desc("norm2"), "vec_id")
    return met.mapInArrow(_searcher(make, width, windows), "rid long, place long, found_id long, found_score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each (rid, place), with their rank from 1."""
    order = Window.partitionBy("rid", "place").orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable_vectors(rows: DataFrame) -> DataFrame:
    """``rid, vec_id, label, v, norm2`` of ``rows(vec_id, label, v)`` with ``v`` an array of doubles, as a written table.

    Left out are rows with a null id, label, vector or component, with a component that is not finite, and with a squared
    length of 2^62 or more, whose scores would not fit a long. Components are floored to integers.
    """
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(fine)
    whole = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("v", lambda x: F.floor(x)).alias("v"))
    rough = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = whole.where(rough < 2.0**62 * (1 - 1e-9))
    norm2 = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    return materialize(whole.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "v", norm2.alias("norm2")), "vectors")


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``rows(vec_id, label, v)``.

    ``anchor`` tells which rows are anchors. An anchor's positives are its first ``positives`` other rows with the same
    label by inner product, ties by smaller id; for each the first ``negatives`` rows of other labels whose score is between
    ``lower`` and ``upper`` hundredths of the positive's. Rows that take no part are in :func:`usable_vectors`; a vector
    that is shorter than others counts as filled with zeros, an empty one scores zero; repeated rows are rows of their
    own, and a repeat of the anchor is another row; an empty table gives an empty result; other columns are not read.
    """
    base = usable_vectors(rows)
    asked = base.where(anchor)
    width, count = base.agg(F.max(F.size("v")), F.count(F.when(anchor, 1))).first()
    width = width or 0
    no_positives = F.array().cast("array<long>")
    found = _search(base, asked.withColumn("positives", no_positives), count, lambda a: PositiveSearch(a, positives), width, 0)
    first = materialize(_ranked(found, positives).drop("place"), "positives")
    listed = first.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "found_score"))).alias("p"))
    windows = asked.join(listed, "rid").withColumn("positives", F.col("p.found_score")).drop("p")
    found = _search(base, windows, count, lambda a: NegativeSearch(a, negatives, lower, upper), width, positives)
    last = materialize(_ranked(found, negatives), "negatives")
    pairs = first.join(asked.select("rid", F.col("vec_id").alias("anchor_id")), "rid").select(
        "rid", (F.col("rank") - 1).alias("place"), "anchor_id", F.col("found_id").alias("positive_id"), F.col("found_score").alias("positive_score")
    )
    out = pairs.join(last, ["rid", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("found_score").alias("negative_score")
    )
    return out


def op11_negatives(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.lit(256) * x.cast("double")).alias("v"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


ORACLE_SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.rid <> b.rid
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) AS place FROM s WHERE same
  QUALIFY place <= 5
), n AS (
  SELECT p.anchor, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id, s.rid) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
  QUALIFY rank <= 3
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n
"""
