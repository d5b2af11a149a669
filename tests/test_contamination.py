"""Phrases, n-grams and the positional index against plain searches, for items with several fields."""

import math
import random

import pytest

from curata.operators import contamination, postings

SPLIT = str.maketrans(dict.fromkeys(' ,.?!:;()"\n\\-', " "))


def tokens(text):
    return (text or "").lower().translate(SPLIT).split()


def holds(body, phrase):
    return bool(phrase) and any(body[i : i + len(phrase)] == phrase for i in range(len(body) - len(phrase) + 1))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    words = ["a", "b", "c", "dd", "ee", "ö", "fff"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", ".", "-"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(150)] + [(200, None), (201, ""), (202, " . ,"), (None, text(9)), (203, "zz " * 3000 + "a b c dd ee fff ö a b zz")]
    docs += [docs[7]]  # a repeated row
    fields = []
    for item in range(60):
        for field in range(rng.choice([1, 1, 2])):
            fields.append((item, field, text(rng.choice([1, 2, 3, 4, 9, 12]))))
    fields += [(100, 0, None), (101, 0, "?!"), (102, 0, "a"), (102, 1, "..."), (103, 0, "A, b C; dd ee fff ö a b zz"), (104, 0, "never seen")]
    frames = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, number string").repartition(3), spark.createDataFrame(fields, "item_id long, field int, text string")
    return docs, fields, *frames


def plain_phrases(docs, fields):
    out, bodies = set(), [(i, tokens(t)) for i, t in docs]
    for item in {f[0] for f in fields}:
        phrases = [tokens(t) for i, _, t in fields if i == item]
        out |= {(item, i) for i, body in bodies if all(holds(body, p) for p in phrases)}
    return out


@pytest.mark.parametrize("most", [16_000_000, 0], ids=["automaton", "join"])
def test_phrases(spark, tables, monkeypatch, most):
    docs, fields, d, i = tables
    monkeypatch.setattr(contamination, "PHRASE_BYTES", most)
    got = [tuple(r) for r in contamination.phrase_matches(d, i).collect()]
    assert set(got) == plain_phrases(docs, fields) and len(got) == len(set(got)) > 20
    assert contamination.phrase_matches(d, i.limit(0)).collect() == [] and contamination.phrase_matches(d.limit(0), i).collect() == []


@pytest.mark.parametrize("most", [16_000_000, 0], ids=["automaton", "join"])
def test_grams(spark, tables, monkeypatch, most):
    docs, fields, d, i = tables
    monkeypatch.setattr(contamination, "PHRASE_BYTES", most)
    known = [(doc, {tuple(t[k : k + 3]) for k in range(len(t) - 2)}) for doc, t in ((doc, tokens(text)) for doc, text in docs)]
    want = {}
    for item in {f[0] for f in fields}:
        texts = [tokens(t) for k, _, t in fields if k == item]
        for doc, grams in known:
            total = 0.0
            for t in texts:
                last = {tuple(t[k : k + 3]): k for k in range(len(t) - 2)}
                total += len({k + j for g, k in last.items() if g in grams for j in range(3)}) / max(1, len(t))
            if total:
                want[item, doc] = round(total / len(texts), 6)
    got = {(r.item_id, r.doc_id): r.score for r in contamination.ngram_matches(d, i, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_index_grows(spark, tables, tmp_path):
    """An index that is built in three calls, one of them broken off, finds what one built at once finds."""
    docs, fields, d, i = tables
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    known = len([1 for k, _ in docs if k is not None])
    assert postings.extend(d, one) == known and postings.extend(d, one) == 0
    assert postings.extend(d.where("doc_id < 50"), many) == 51
    spark.createDataFrame([("a", 60, [1], 0)], "token string, doc_id long, places array<int>, bucket int").write.partitionBy("bucket").parquet(f"{many}/postings/segment=1")  # no line in the manifest
    assert postings.extend(d.where("doc_id < 120"), many) == 70 and postings.extend(d, many) == known - 121
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(postings.postings(spark, one)) == key(postings.postings(spark, many))
    assert key(postings.dictionary(spark, one)) == key(postings.dictionary(spark, many))
    want = {x for x in plain_phrases(docs, fields) if x[1] is not None}
    for path in (one, many):
        got = [tuple(r) for r in postings.phrase_matches(path, i).collect()]
        assert set(got) == want and len(got) == len(set(got))
    assert postings.phrase_matches(str(tmp_path / "none"), i).collect() == []


def test_suites(spark, tables):
    """All sets in one pass; a limit takes a set's first items; a column for each set."""
    docs, fields, d, i = tables
    sets = i.selectExpr("case when item_id % 2 = 0 then 'even' else 'odd' end as suite", "item_id", "field", "text")
    found = contamination.suite_matches(d, sets, {"odd": 5}, 3)
    rows = found.collect()
    every = contamination.ngram_matches(d, i, 3).collect()
    odd = sorted({f[0] for f in fields if f[0] % 2})[:5]
    assert {(r.item_id, r.doc_id) for r in rows} == {(r.item_id, r.doc_id) for r in every if r.item_id % 2 == 0 or r.item_id in odd}
    report = contamination.suite_report(d.withColumn("kind", d.doc_id % 2), found, ["even", "odd", "empty"], "kind", 0.4).collect()
    assert {r.kind for r in report} == {0, 1, None} and all(r.empty == 0.0 for r in report)
    assert sum(r.rows for r in report) == len(docs)


def test_places_need_no_shuffle():
    """Each document's places come from its own row, in bounded batches; equal ids and empty texts too."""
    import pyarrow as pa

    from curata.operators import postings

    batch = pa.RecordBatch.from_arrays([pa.array([3, 3, 4, 5]), pa.array([["a", "b", "a"], ["a"], [], ["é"]])], ["doc_id", "t"])
    got = [tuple(r.values()) for b in postings._places(iter([batch])) for r in b.to_pylist()]
    assert got == [("a", 3, [0, 2]), ("b", 3, [1]), ("a", 3, [0]), ("é", 5, [0])]


VECTOR_ROWS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def labelled():
    """Vectors in groups: ties, an opposite one, null labels and a repeated row."""
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + 0.4 * rng.gauss(0, 1) for c in centres[i % 6]], None if i % 11 == 0 else i % 6 // 2 + rng.choice([0, 0, 1])) for i in range(1, 241)]
    rows += [(1_000 + i, rows[3][1], i % 2) for i in range(9)] + [(-7, [-x for x in rows[0][1]], 1), rows[30]]
    return rows


@pytest.mark.parametrize("most", [(65_536, 1_024), (40, 1)], ids=["one", "groups"])
def test_label_votes_of_every_vector(spark, labelled, tmp_path, monkeypatch, most):
    """Not only of those whose id is divisible by 20; of SQL, the same rows."""
    import duckdb

    from curata.plans import catalogue

    monkeypatch.setattr(contamination, "GROUP_ROWS", most, raising=False)
    spark.createDataFrame(labelled, VECTOR_ROWS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in catalogue.queries()["vector_label_votes"](spark, str(tmp_path)).select("query_id", "hits", "agree").collect())
    assert [g[0] for g in got] == sorted({r[0] for r in labelled})
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(catalogue.oracle_sql()["vector_label_votes"]).fetchall())


@pytest.mark.parametrize("most", [(65_536, 1_024), (40, 1)], ids=["one", "groups"])
def test_neighbours_of_every_vector(spark, labelled, monkeypatch, most):
    """As the search by blocks of queries has them, with the labels of both rows; odd rows take no part."""
    monkeypatch.setattr(contamination, "GROUP_ROWS", most)
    odd = [(2_000, None, 1), (2_001, [math.nan] * 8, 1), (2_002, [None, *[1.0] * 7], 1), (2_003, [math.inf, *[1.0] * 7], 1)]
    df = spark.createDataFrame([*dict((r[0], r) for r in labelled).values(), *odd, (2_004, [0.0] * 8, 2)], VECTOR_ROWS).repartition(3)
    got = contamination.vector_neighbours(df, 4)
    want = contamination.vector_topk(df, df, 4)
    key = lambda r: (r.query_id, r["rank"], r.vec_id, r.score)
    rows = got.collect()
    assert sorted(map(key, rows)) == sorted(map(key, want.collect())) and len(rows) == 4 * 251
    label = {r[0]: r[2] for r in labelled} | {2_004: 2}
    assert all(r.label == label[r.vec_id] and r.query_label == label[r.query_id] for r in rows)
    nobody = spark.createDataFrame([(None, [1.0] * 8, 1), (1, [1.0] * 8, 1)], VECTOR_ROWS)
    assert contamination.vector_neighbours(nobody).collect() == [] and contamination.vector_neighbours(df.limit(0)).collect() == []
