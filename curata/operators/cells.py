"""Approximate vector search by inverted cells: k-means centroids of a bounded sample, rows dealt to the nearest centroid,
queries to the nearest few.

Every row is indexed; only the centroids come from a sample. A cell with more rows than a task should read is cut into
parts by a hash, and the queries of a cell meet each part of it. With as many probes as cells the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.operators.contamination import best_rows, matrix, no_best, normalized, take_best
from curata.runtime import join_checked, materialize, share

#: Rows that centroids are learned from, chosen by a hash of the id, and rounds of k-means.
SAMPLE, ROUNDS = 20_000, 12
#: Rows of a part of a cell, and queries that meet a part at once.
PART_ROWS, QUERY_ROWS = 100_000, 10_000


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` of length 1; rows with a null id or vector, or a null or infinite component, take no part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), normalized(F.col("embedding")).alias("vector"))


def learn_centroids(units: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of spherical k-means on at most ``sample`` rows; fewer cells if there are fewer rows."""
    rows = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = np.array([r.vector for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
    centroids = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy() if len(x) else x
    for _ in range(ROUNDS if len(x) else 0):
        nearest = (x @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            mean = x[nearest == c].sum(axis=0)
            length = np.linalg.norm(mean)
            if length > 0:
                centroids[c] = mean / length
    return centroids


def probes_for(units: DataFrame, centroids: np.ndarray, target: float, k: int = 5, sample: int = SAMPLE, asked: int = 1_000) -> int:
    """The least number of probes with which a share of ``target`` of true neighbours is found, as a sample tells it.

    The ``k`` nearest of at most ``asked`` rows of the sample, within the sample, are looked for by brute force, and the place
    of each one's cell in the order in which its query probes cells is counted. Vectors without structure need most cells.
    """
    rows = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = np.array([r.vector for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
    if len(x) < 2:
        return max(1, len(centroids))
    cell, places = (x @ centroids.T).argmax(axis=1), []
    for q in range(min(asked, len(x))):
        score = x @ x[q]
        score[q] = -np.inf
        near = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        order = np.argsort(-(centroids @ x[q]), kind="stable")
        places.append(np.argsort(order)[cell[near]])
    counts = np.cumsum(np.bincount(np.concatenate(places), minlength=len(centroids)))
    return int(np.searchsorted(counts, target * counts[-1])) + 1


def _dealt(units: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """``cell, vec_id, vector`` of each vector under its nearest ``probes`` centroids; ties go to the first."""
    get = share(units.sparkSession, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(matrix(batch.column("vector")) @ get().T), axis=1, kind="stable")[:, :probes]
                taken = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), *taken.columns], ["cell", "vec_id", "vector"])

    return units.select("vec_id", "vector").mapInArrow(run, "cell int, vec_id long, vector array<double>")


def index_cells(units: DataFrame, centroids: np.ndarray) -> DataFrame:
    """All rows with their cell, as a written table; a cell's rows are together."""
    return materialize(_dealt(units, centroids, 1).sortWithinPartitions("cell"), "cells")


def _nearest_of(k: int):
    """The task: a stream of units, of each first its queries and then its vectors; the ``k`` best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, queries, best = None, [], [], None

        def take(own: np.ndarray, x: np.ndarray) -> None:
            nonlocal best, ids, queries
            if best is None:
                ids, queries = np.concatenate(ids), np.concatenate(queries)
                best = no_best(len(ids), k)
            take_best(ids, queries, *best, own, x)

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None:
                yield best_rows(ids, *best)

        for batch in batches:
            units, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "role"))
            own, x = batch.column("vec_id").to_numpy(zero_copy_only=False), matrix(batch.column("vector")) if batch.num_rows else None
            cuts = np.flatnonzero(np.r_[True, (units[1:] != units[:-1]) | (role[1:] != role[:-1])]) if batch.num_rows else []
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if units[lo] != unit:
                    yield from done()
                    unit, ids, queries, best = units[lo], [], [], None
                if role[lo] == 0:
                    ids.append(own[lo:hi])
                    queries.append(x[lo:hi])
                elif len(ids):
                    take(own[lo:hi], x[lo:hi])
        yield from done()

    return run


def cell_topk(index: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int = 5, probes: int = 8) -> DataFrame:
    """``query_id, vec_id, score, rank``: the ``k`` nearest by cosine in the ``probes`` cells nearest to each query.

    ``index`` is of :func:`index_cells`, ``queries`` of :func:`unit_vectors`. Ties go to the lesser id, and a query is not
    its own neighbour. Parts of a cell and chunks of its queries meet as units of bounded size.
    """
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    asked = materialize(_dealt(queries, centroids, probes), "cell-queries")
    chunks = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks"))
    grid = materialize(sizes.join(chunks, "cell"), "cell-grid")  # a row for each cell that is asked
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    unit = F.xxhash64("cell", "part", "chunk").alias("unit")
    left = join_checked(asked, grid, ["cell"], "inner").withColumn("chunk", mine(F.col("chunks"))).withColumn("part", each(F.col("parts")))
    right = join_checked(index, grid, ["cell"], "inner").withColumn("part", mine(F.col("parts"))).withColumn("chunk", each(F.col("chunks")))
    met = left.select(unit, F.lit(0).alias("role"), "vec_id", "vector").unionByName(right.select(unit, F.lit(1).alias("role"), "vec_id", "vector"))
    met = met.repartition("unit").sortWithinPartitions("unit", "role")
    found = met.mapInArrow(_nearest_of(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the rows of ``exact(query_id, vec_id)`` that are found."""
    hits, n = exact.join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").agg(F.count("hit"), F.count("*")).first()
    return hits / n if n else 1.0
