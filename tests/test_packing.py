"""Exact next-fit over composed runs, the order and fullness of best-fit packs, and the selection of packs."""

import random

import pytest
from pyspark.sql import functions as F

from curata.operators import packing


def plain_next_fit(lengths, size):
    out, fill, pack = [], 0, 0
    for n in lengths:
        if fill and fill + n > size:
            fill, pack = 0, pack + 1
        fill += n
        out.append(pack)
    return out, (pack, fill)


@pytest.mark.parametrize("seed", range(6))
def test_functions_compose(seed):
    """The function of any run gives what a fold gives for any fill, and so does that of several runs together."""
    rng = random.Random(seed)
    size = rng.choice([5, 12, 30])
    kinds = [[0, 1, 2, 3], [0, 0, 7, size + 3], [1, size, size + 1], [2, 3, 5]][seed % 4]
    runs = [[rng.choice(kinds) for _ in range(rng.randint(1, 9))] for _ in range(6)]
    f, done = None, []
    for lengths in runs:
        g = packing.run_function(lengths, size)
        f = g if f is None else packing.composed(f, g, size)
        done += lengths
        assert len(f[0]) <= size + 2
        for fill in range(size + 9):
            known = plain_next_fit([fill, *done] if fill else done, size)[1]
            assert packing.after_run((0, fill), f, size) == known, (done, size, fill)


@pytest.mark.parametrize(("run", "least"), [(1, 1), (3, 1), (7, 4), (1000, 3)])
def test_next_fit_is_one_fold(spark, monkeypatch, run, least):
    monkeypatch.setattr(packing, "BLOCK_RUNS", 4)
    rng = random.Random(run)
    rows = [(rng.choice(["a", "b", None]), i * 3 % 1009, rng.choice([None, 0, 1, 4, 9, 25])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, n int").repartition(5)
    got = {r.i: r.pack for r in packing.next_fit(df, "g", "i", "n", 20, run, least).collect()}
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        mine = sorted((i, n or 0) for x, i, n in rows if x == g)
        size = min(20, sum(n for _, n in mine) // least) if least > 1 else 20
        assert [got[i] for i, _ in mine] == plain_next_fit([n for _, n in mine], size)[0]
    assert packing.next_fit(df.limit(0), "g", "i", "n", 20, run, least).collect() == []


def test_least_packs(spark):
    """Three sequences that would share two packs fill three if three workers want one each."""
    df = spark.createDataFrame([("q", 0, 5), ("q", 1, 6), ("q", 2, 7)], "g string, i long, n long")
    packs = lambda least: len({r.pack for r in packing.next_fit(df, "g", "i", "n", 12, least_packs=least).collect()})
    assert packs(1) == 2 and packs(3) == 3


def test_best_fit_in_order(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([3, 5, 7, 10])) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, i long, n long")
    packed = packing.best_fit(df, "g", "i", "n", 10)
    for full in (None, 10):
        out = packing.in_order_of_first(packed, "g", "i", full, "n").collect()
        for g in ("a", "b", None):
            packs: dict = {}
            for r in out:
                if r.g == g:
                    packs.setdefault(r.pack, []).append((r.i, r.n))
            firsts = [min(packs[k])[0] for k in sorted(packs)]
            assert sorted(packs) == list(range(len(packs))) and firsts == sorted(firsts) and packs
            assert full is None or all(sum(n for _, n in p) == 10 for p in packs.values())
    with pytest.raises(ValueError, match="11 tokens"):
        packing.best_fit(df.union(spark.createDataFrame([("a", 999, 11)], df.schema)), "g", "i", "n", 10, over_long="raise")


def plain_selection(sizes, chosen, target, tolerance):
    """The tokens after the best single swaps, one after the other."""
    inside, outside, total = sorted(sizes[i] for i in chosen), sorted(s for i, s in enumerate(sizes) if i not in chosen), sum(sizes[i] for i in chosen)
    while abs(total - target) > tolerance:
        best = min(((abs(total - a + b - target), a, b) for a in set(inside) for b in set(outside)), default=None)
        if best is None or best[0] >= abs(total - target):
            break
        _, a, b = best
        inside.remove(a), outside.remove(b), inside.append(b), outside.append(a)
        total += b - a
    return total


@pytest.mark.parametrize("target", [0, 900, 2500, 4000, 10**6])
def test_selection_has_no_cap(spark, target):
    rng = random.Random(target)
    sizes = [rng.choice([5, 17, 40, 41, 90]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, n long")
    got = packing.select_packs(df, "i", "n", 50, target, 0, F.md5(F.col("i").cast("string"))).collect()
    chosen = {r.i for r in df.orderBy(F.md5(F.col("i").cast("string"))).limit(50).collect()}
    assert len({r.i for r in got}) == 50 and all(sizes[r.i] == r.n for r in got)
    want = plain_selection(sizes, chosen, target, 0)
    assert abs(sum(r.n for r in got) - target) <= abs(want - target)
