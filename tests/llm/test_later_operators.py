"""Hard negatives, fill-in-the-middle and exact copies against SQL and plain Python, on small tables and odd rows."""

import hashlib
import math
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.llm import copies, infill, negatives, registry

BLANK = "\x20\x09-\x0d"


@pytest.fixture(scope="module")
def folders(spark, data, odd, tmp_path_factory):
    tmp = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{tmp}/documents.parquet")
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=6)], int(rng.integers(0, 4))) for i in range(160)]
    vectors += [(i, [0.5, -0.25, 0.125, 1.0, 0.0, -1.0], i % 3) for i in range(200, 300)]  # ties
    vectors += [(50, vectors[50][1], vectors[50][2]), (7, vectors[7][1], vectors[7][2]), (300, [0.0] * 6, 1), (350, [-1.0, -2.0, 3.0, 0.5, 0.25, 9.0], 2)]
    vectors += [(400, None, 1), (401, [1.0] * 6, None), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (450, [math.nan] * 6, 1), (403, [math.inf] * 6, 2), (None, [1.0] * 6, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp}/embeddings.parquet")
    return [data, tmp]


@pytest.mark.parametrize("name", ["op11_negatives", "op12_infill", "op13_copies"])
@pytest.mark.parametrize("which", [0, 1], ids=["small", "odd"])
def test_sql(spark, folders, name, which):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{folders[which]}/{table}.parquet{'/*.parquet' if which else ''}'")
    df = registry.queries()[name](spark, folders[which])
    got, rel = df.select(*sorted(df.columns)).collect(), con.sql(registry.oracle_sql()[name])
    want = rel.select(*sorted(rel.columns)).fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and got


def plain_negatives(rows, anchors):
    """``rows`` of (vec_id, label, integer vector); every pair is scored with Python's integers."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))  # noqa: E731  a shorter vector ends in zeros
    out = []
    for i in anchors:
        vec_id, label, v = rows[i]
        scored = sorted((-dot(v, w), j, y == label) for k, (j, y, w) in enumerate(rows) if k != i)
        for s, j, _ in [x for x in scored if x[2]][:5]:
            fits = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(vec_id, j, rank, n[1], -s, -n[0]) for rank, n in enumerate(fits[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 3_000, 10_000_000], ids=["single", "double", "long"])
def test_negatives_in_chunks(spark, monkeypatch, scale):
    """Several chunks of anchors, small buckets, vectors of several lengths and all three kinds of arithmetic."""
    monkeypatch.setattr(negatives, "ANCHOR_VALUES", 60)
    monkeypatch.setattr(negatives, "FIRST_BUCKET", 3)
    monkeypatch.setattr(negatives, "LAST_BUCKET", 7)
    monkeypatch.setattr(negatives, "BLOCK", 4)
    monkeypatch.setattr(negatives, "GROUPS_A_CORE", 1)
    rng = np.random.default_rng(scale)
    rows = [(i, int(rng.integers(0, 3)), [int(x) * scale + 1 for x in rng.integers(-40, 80, int(rng.integers(0, 7)))]) for i in range(240)]
    rows += [(i, 1, [30 * scale] * 6) for i in range(300, 340)] + [(3, 1, [5 * scale])] * 3
    anchors = [k for k, r in enumerate(rows) if r[0] % 4 == 3]
    df = spark.createDataFrame([(i, y, [float(x) for x in v], 0.5, "x") for i, y, v in rows], "vec_id long, label int, v array<double>, rid double, norm2 string")
    got = negatives.hard_negatives(df.repartition(3), F.col("vec_id") % 4 == 3)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, anchors)
    for none in (df.limit(0), df.where("vec_id = 3")):
        assert negatives.hard_negatives(none, F.col("vec_id") % 4 == 3).collect() == []


def test_buckets_are_pruned(spark):
    """Once k long rows are known, a bucket of short ones is not scored; equal scores of smaller ids still are."""
    anchors = {"rid": np.array([0]), "label": np.array([1]), "norm2": np.array([100]), "v": np.array([[10, 0]])}
    search = negatives.PositiveSearch(anchors, 2)
    bucket = lambda ids, v: {"rid": np.array(ids), "vec_id": np.array(ids), "label": np.ones(len(ids), int), "v": np.array(v), "norm2": (np.array(v) ** 2).sum(axis=1)}
    assert search.search(bucket([5, 6], [[9, 0], [8, 0]]))
    assert search.search(bucket([2], [[8, 0]]))  # ties the second, and its id is smaller
    assert not search.search(bucket([1], [[7, 0]]))
    assert search.found()["found_id"].tolist() == [5, 2]


def plain_infill(doc_id, text):
    text = text or ""
    tokens = re.findall(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(tokens)
    if not text or c % 100 >= 50 or any(m in text for m in infill.MARKS):
        return n, "plain", None, None, text
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if d % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark):
    """Random texts of blanks, bytes of all widths, broken marks and whole ones; the text comes back from its pieces."""
    rng = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "\t\x0b", "\r\x0c", "a", "Wort", "ß", "日本", "🙂", " ", " ", "\x1c", "\x85", "<", "<S", "P>", "S>", "<", "<M", "\x00"]
    texts = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 40))) for _ in range(600)]
    texts += ["a <P> b", "<M>", "x <S>y", " " * 5_000, "word " * 60_000, "x" * 200_000, None, ""]
    rows = [(i if i % 90 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = infill.infilled(df)
    got = [tuple(r) for r in made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()]
    assert got == [(i, *plain_infill(i, t), t or "") for i, t in rows]
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert infill.infilled(df.limit(0)).collect() == []


def test_select_finds_every_rank():
    rng = np.random.default_rng(2)
    for width in (1, 2, 7, 64, 257):
        flags = rng.integers(0, 2, width)
        bits = int("".join(map(str, flags)), 2)
        places = list(np.flatnonzero(flags))
        assert [infill.select(bits, width, k) for k in range(len(places) + 2)] == [*places, width, width]


def plain_copies(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(f"[{BLANK}]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for content, members in groups.items():
        first = min(members)
        digest = hashlib.sha256(content.encode()).hexdigest()
        out += [(rows[m[3]][0], rows[first[3]][0], len(members), m[:3] == first[:3], digest) for m in members]
    return out


@pytest.mark.parametrize("weak", [False, True], ids=["sha256", "collisions"])
@pytest.mark.parametrize("even", [100, 2], ids=["few hot", "many hot"])
def test_copies(spark, monkeypatch, weak, even):
    """Hot groups under salts, digests that stand for different texts, repeated rows, nulls and ties."""
    monkeypatch.setattr(copies, "EVEN", even)
    texts = ["a b", "ab", " a b ", "", None, " \n", "x y z", "xyz", "日 本", "日本", " ", "q"] + ["hot text"] * 300 + [f"own {i}" for i in range(200)]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(3, "ab")] * 5 + [(7, "hottext  ")] * 3
    df = spark.createDataFrame([(*r, "k", 1, True) for r in rows], "doc_id long, text string, digest string, n int, kept boolean").repartition(6)
    digest = (lambda c: (F.length(c) % 3).cast("string")) if weak else copies.sha256
    got = copies.exact_groups(df, digest, salts=3).collect()
    want = plain_copies(rows)
    assert len({r.rid for r in got}) == len(rows)
    key = lambda x: tuple(map(repr, x))
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=key) == sorted([w[:3] for w in want], key=key)
    stay = {w[4]: (w[1], w[2]) for w in want}.values()
    assert sorted([(r.doc_id, r.group_size) for r in got if r.kept], key=key) == sorted(stay, key=key)
    if not weak:
        assert sorted((r.digest, repr(r.doc_id)) for r in got) == sorted((w[4], repr(w[0])) for w in want)
    assert copies.exact_groups(df.limit(0), digest).collect() == []


def test_drop_copies(spark, odd):
    left = copies.drop_copies(odd)
    assert left.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    kept = [re.sub(f"[{BLANK}]", "", r.text or "") for r in left.collect()]
    assert sorted(kept) == sorted({re.sub(f"[{BLANK}]", "", t or "") for _, t in rows})


def test_copies_stay_native(spark, data):
    plan = copies.op13_copies(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
