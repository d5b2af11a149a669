"""Inverted cells: exact with all probes, recall with few where vectors have structure, odd rows, split cells."""

import math

import numpy as np
import pyarrow as pa
import pytest

from curata.operators import cells, contamination

SCHEMA = "vec_id long, embedding array<float>, label string"


def plain(rows, asked, k):
    x = np.array([r[1] for r in rows], dtype=float)
    unit = x / np.where((n := np.linalg.norm(x, axis=1)) > 0, n, 1)[:, None]
    out = []
    for q in asked:
        s = np.round(unit @ unit[q], 6)
        order = sorted((-s[j], rows[j][0]) for j in range(len(rows)) if rows[j][0] != rows[q][0])[:k]
        out += [(rows[q][0], i, rank) for rank, (_, i) in enumerate(order, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def groups():
    """Twenty tight groups, one of which has a third of all rows, ties among them, and a zero vector."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(20, 16))
    rows = []
    for i in range(1_200):
        g = 0 if i % 3 == 0 else int(rng.integers(0, 20))
        rows.append((i, [float(np.float32(v)) for v in centres[g] + 0.15 * rng.normal(size=16)], "x"))
    rows += [(2_000 + i, rows[0][1], "copy") for i in range(9)] + [(3_000, [0.0] * 16, "zero")]
    return rows


@pytest.mark.parametrize(("part_rows", "query_rows"), [(100_000, 10_000), (50, 7)], ids=["whole", "split"])
def test_all_probes_are_exact(spark, groups, monkeypatch, part_rows, query_rows):
    monkeypatch.setattr(cells, "PART_ROWS", part_rows)
    monkeypatch.setattr(cells, "QUERY_ROWS", query_rows)
    odd = [(4_000, None, "n"), (None, [1.0] * 16, "n"), (4_001, [math.nan] * 16, "n"), (4_002, [None, *[1.0] * 15], "n"), (4_003, [math.inf] * 16, "n")]
    units = cells.unit_vectors(spark.createDataFrame(groups + odd, SCHEMA).repartition(4))
    centroids = cells.learn_centroids(units, 20)
    index = cells.index_cells(units, centroids)
    assert index.count() == len(groups)
    queries = units.where("vec_id % 50 = 0")
    got = cells.cell_topk(index, queries, centroids, 5, len(centroids))
    want = plain(groups, [k for k, r in enumerate(groups) if r[0] % 50 == 0], 5)
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got.collect()) == want
    few = cells.probes_for(units, centroids, 0.98)
    assert few <= 6
    assert cells.recall(cells.cell_topk(index, queries, centroids, 5, few), got) >= 0.95


def test_few_rows(spark, groups):
    none = cells.unit_vectors(spark.createDataFrame([], SCHEMA))
    one = cells.unit_vectors(spark.createDataFrame(groups[:1], SCHEMA))
    for units in (none, one):
        centroids = cells.learn_centroids(units, 8)
        assert cells.cell_topk(cells.index_cells(units, centroids), units, centroids, 5, cells.probes_for(units, centroids, 0.9)).collect() == []


def test_memory_of_a_task_is_a_tile(spark, groups):
    """Ten thousand vectors against three thousand queries hold tiles of scores, not all 30 million of them."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x = rng.normal(size=(10_000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[5_000:5_040] = x[7]  # ties
    ids = np.arange(10_000)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x), pa.list_(pa.float64()))], ["vec_id", "vector"])
    tracemalloc.start()
    (got,) = contamination._nearest(lambda: (ids[:3_000], x[:3_000]), 5)(iter([batch]))
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
    found = {}
    for q, v, s in sorted(zip(*(c.to_pylist() for c in got.columns), strict=True), key=lambda r: (r[0], -r[2], r[1])):
        found.setdefault(q, []).append(v)
    for q in (0, 7, 2_999):
        s = np.round(x @ x[q], 6)
        assert found[q] == [i for _, i in sorted((-s[j], j) for j in range(10_000) if j != q)[:5]]
