"""Stages of the pipeline against plain Python, each on its own input, and the whole run."""

import numpy as np
from llm import brute
from pyspark.sql import functions as F

import corpus_pipeline
from curata.llm import decontaminate, simhash
from curata.runtime import materialize


def test_stages(spark, data, odd, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            fine = {i for i, r in before.items() if not brute.quality(r.text)[-1]}
            assert set(after) <= fine and len(after) > 0.9 * len(fine)
        elif name == "near_dedup":
            sets = {i: brute.shingles(r.text) for i, r in before.items()}
            links = [(a, b) for a, b, similarity in brute.similar_pairs(sets, 0.65) if similarity >= 0.8]
            assert len([1 for a, b in links if a in after and b in after]) <= 0.1 * len(links) and len(links) > 50
            near = {x for a, b, _ in brute.similar_pairs(sets, 0.65) for x in (a, b)}
            assert set(before) - set(after) <= near | {i for i, s in sets.items() if not s}
            assert len({r.text for r in after.values()}) == len(after)
        elif name == "benchmark_decontamination":
            items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
            for r in after.values():
                words = b" ".join(decontaminate.words_of(r.text.encode()))
                assert not any(b" ".join(decontaminate.words_of(i.text.encode())) in words for i in items if i.text)
        elif name == "personal_data":
            assert set(after) == set(before)
            assert not any(brute.pii(r.text) for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values() if before[r.doc_id].n_chars == len(before[r.doc_id].text))
            assert all(r.text == before[i].text for i, r in after.items() if not brute.pii(before[i].text) and "[IBAN]" not in r.text)
    ids = set(after)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in pieces} == ids
    rows = corpus_pipeline.run(spark, data).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, pieces))
    assert np.all([r.offset + r.length <= 2048 for r in rows])


def test_stages_keep_clashing_columns(spark, odd, data):
    """Columns named like those inside the stages come out with the values that they went in with."""
    names = ["curata_rid", "curata_RID_", "curata_host", "curata_pii", "curata_before", "carried", "node", "keeper", "base_failed", "failed", "word_stats", "root"]
    good = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("w"), F.col("doc_id") * 100 + i)), " ")
    fine = odd.limit(10).withColumns({"doc_id": F.monotonically_increasing_id() + 100, "source": F.lit("fine")}).withColumn("text", good)
    docs = odd.unionByName(fine).withColumn("key", F.monotonically_increasing_id()).select("*", *(F.concat(F.lit(n), F.col("key")).alias(n) for n in names))
    docs = materialize(docs, "clashes")
    other = [c for c in docs.columns if c not in ("text", "n_chars")]
    before = {r.key: r for r in docs.select(*other).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.select(*other).collect()
        assert rows and all(r == before[r.key] for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() >= len(before)


def test_stages_take_odd_rows(spark, odd, nothing, data):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, data)
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()


def test_near_dedup_recall(spark):
    """Pairs of edited texts, by their true similarity: few of 0.8 and more are missed, and few far below it are dropped."""
    rng = np.random.default_rng(8)
    rows, pairs = [], []
    for _ in range(900):
        words = [f"w{x}" for x in rng.integers(0, 5_000, int(rng.integers(120, 500)))]
        edited = list(words)
        for at in rng.choice(len(words), int(len(words) * rng.uniform(0.01, 0.07)), replace=False):
            edited[at] = f"e{rng.integers(0, 5_000)}"
        a, b = brute.shingles(" ".join(words)), brute.shingles(" ".join(edited))
        pairs.append((len(rows), len(a & b) / len(a | b)))
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(edited))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    linked = lambda lo, hi: [found[i] == found[i + 1] for i, s in pairs if lo <= s < hi]
    shares = {lo: (len(x), round(float(np.mean(x)), 3)) for lo, hi in ((0.8, 0.82), (0.82, 1), (0.7, 0.75), (0.6, 0.7), (0, 0.6)) if (x := linked(lo, hi))}
    print(shares)
    assert shares[0.8][0] > 20 and shares[0.8][1] >= 0.9 and shares[0.82][1] >= 0.97, shares
    assert shares[0.7][1] <= 0.25 and shares[0.6][1] <= 0.02, shares
