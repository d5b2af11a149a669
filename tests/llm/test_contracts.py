"""The queries' contracts against plain Python and SQL on whole small tables, and on odd rows."""

import zlib

import duckdb
import numpy as np
import pytest
from llm import brute
from pyspark.sql import functions as F

from curata.llm import components, copies, decontaminate, hilbert, infill, licenses, maxent, packing, pii, quality, registry, simhash, toxicity, urls


def docs_of(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def both(spark, data, odd, tmp_path_factory):
    """Folders with documents: the small tables and the odd rows."""
    tmp = tmp_path_factory.mktemp("odd")
    odd.write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame([(8, 0, 0), (5, 1, 1), (None, 1, None), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "seven wizards mix a potion of jade and quartz near the old mill"), (3, "?")], "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    return [data, str(tmp)]


def folders(test):
    return pytest.mark.parametrize("which", [0, 1], ids=["small", "odd"])(test)


@folders
def test_simhash(spark, both, which):
    docs = docs_of(spark, both[which]).select("doc_id", "text").collect()
    ids, prints = [d.doc_id for d in docs], [brute.fingerprint(d.text) for d in docs]
    first = brute.components(prints)
    least: dict = {}
    for i, r in zip(ids, first, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((str(i), f"{p:016x}", least.get(r)) for i, p, r in zip(ids, prints, first, strict=True)), key=repr)
    got = [(str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, both[which]).collect()]
    assert sorted(got, key=repr) == want


def test_components_with_hubs(spark):
    """A hub of half of all links, a chain, repeated and turned links, self links and nulls."""
    hub = [(7, 10_000 + i) for i in range(6_000)] + [(10_000 + i, 20_000 + i) for i in range(0, 6_000, 3)]
    rest = [(i, i + 1) for i in range(100, 160)] + [(101, 100), (5, 5), (None, 3), (3, None)]
    found = components.connected_components(spark.createDataFrame(hub + rest, "u long, v long")).collect()
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in hub + rest:
        if None not in (u, v) and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    assert sorted((r.node, r.root) for r in found) == sorted((x, root(x)) for x in list(parent))


def test_join_hot(spark):
    """Hot, even, missing and null keys give what an inner join gives, once each."""
    left = spark.range(20_000).selectExpr("case when id < 15000 then 1 when id < 19990 then id % 97 + 2 when id < 19995 then null else -1 end as k", "id")
    right = left.where("k >= 1").groupBy("k").count().selectExpr("k", "count as n", "k * 10 as m")
    got = components.join_hot(left, right, ["k"], 20_000)
    assert got.columns == ["k", "id", "m"]
    assert sorted(got.collect()) == sorted(left.join(right.drop("n"), "k").collect())


@folders
def test_maxent(spark, both, which):
    docs = {d.doc_id: d.text for d in docs_of(spark, both[which]).select("doc_id", "text").collect()}
    got = maxent.op2_maxent(spark, both[which]).collect()
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    if which:
        assert len(got) == docs_of(spark, both[which]).count()
        return
    want = brute.unigram(list(docs.items()))
    for r in got:
        n, known, total, score, out = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, out)
        assert abs(r.base_score - score) < 1e-6 * max(1, abs(score))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_maxent_sums_to_one(spark):
    """All words and the unseen word share one unit of probability after any history."""
    texts = ["a b a c", "b c d e f", "a a b", None] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = maxent.token_counts(docs.select("text")).cache()
    model = maxent.train_model(docs.select("text"), counts)
    v = model.vocabulary
    head = list(v.index)
    own = [w for i, w in enumerate(head) if i < maxent.OWN]
    history = np.array([[v.code[v.index[b"a"]]], [maxent._BEFORE], [maxent._BEFORE]])
    z = maxent.logits(v.class_bias, model.weights[0], maxent.class_features(history, v.row_bits))
    kinds = maxent.softmax(z)[0].astype(float)
    total = 0.0
    for w in own:
        k, s = divmod(int(v.slot[v.index[w]]), maxent.SLOTS)
        inside = maxent.softmax(maxent.logits(v.slot_bias[[k]], model.weights[1], maxent.slot_features(history, np.array([k]), v.row_bits)))[0]
        total += kinds[k] * inside[s]
    rest = 0.0
    for k in range(maxent.CLASSES):
        inside = maxent.softmax(maxent.logits(v.slot_bias[[k]], model.weights[1], maxent.slot_features(history, np.array([k]), v.row_bits)))[0]
        rest += kinds[k] * sum(inside[s] for s in range(maxent.SLOTS) if k * maxent.SLOTS + s not in {int(v.slot[v.index[w]]) for w in own})
    assert abs(total + rest - 1) < 1e-4


def test_maxent_tells_words_apart(spark):
    """Histories of rare words with like endings, and a word two tokens after a skipped one, are learned."""
    rng = np.random.default_rng(4)
    noise = [f"n{i}ing" for i in range(600)]
    pairs = [(f"h{i}ing", "left" if i % 2 else "right") for i in range(40)]
    text = lambda: " ".join(f"{a} {rng.choice(noise)} {b}" for a, b in (pairs[int(i)] for i in rng.integers(0, 40, 60)))
    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string").repartition(1)
    counts = maxent.token_counts(docs.select("text")).cache()
    model = maxent.train_model(docs.select("text"), counts)
    score = lambda t: sum(float(x[0]) for x in model.parts([t.encode()])[2:4])
    better = sum(score(f"{a} {noise[0]} {b}") > score(f"{a} {noise[0]} {'right' if b == 'left' else 'left'}") for a, b in pairs)
    assert better >= 36, better


def test_softmax_of_low_logits():
    z = np.full((2, 32), -500, dtype=np.float32)
    assert np.allclose(maxent.softmax(z.copy()), 1 / 32) and np.allclose(maxent.log_probability(z, np.array([0, 5])), -np.log(32))


@folders
def test_toxicity(spark, both, which):
    got = toxicity.op3_toxicity(spark, both[which]).collect()
    docs = docs_of(spark, both[which])
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    if which == 0:
        label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{both[0]}/labels.parquet").collect()}
        held = [(label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
        right = sum(a == b for a, b in held) / len(held)
        assert right >= 0.9, right


def test_toxicity_finds_misspellings():
    lexicon = toxicity.Lexicon({"horrible": 3.0, "vile": 2.5, "scum*": 4.0})
    assert lexicon.look_up(b"horible") == (3.0, True)
    assert lexicon.look_up(b"scumbag") == (4.0, False)
    assert lexicon.look_up(b"harbinger") is None
    plain, quoted = lexicon.features(b"they are horrible"), lexicon.features(b'"horrible" he said')
    assert plain[0] > quoted[0] and quoted[1] > plain[1]


def test_misspelled_hits_weigh():
    """A misspelled hit counts for less than the term and more than a quoted misspelling, which counts for something."""
    lexicon = toxicity.Lexicon({"horrible": 3.0, "vile": 2.5})
    plain, edited, quoted, none = (lexicon.features(t)[0] for t in (b"they are horrible", b"they are horible", b'"horible" he said', b"they are nice"))
    assert plain > edited > quoted > none == 0


def test_misspelled_texts_are_scored(spark):
    """Misspelled and quoted copies of toxic texts, with a lexicon of a stem's family and a model of many texts."""
    rng = np.random.default_rng(11)
    vocabulary = [a + b + c for a in ("ka", "lo", "mi", "tu") for b in ("re", "sa", "vo", "ni") for c in ("da", "pe", "zu", "fo")]
    family = ["grumbler", "grumbling", "grumbled", "grumbles", "grumbly"]
    filler = lambda: " ".join(rng.choice(vocabulary, 40))
    toxic = lambda: f"{filler()} {' '.join(rng.choice(family, 3))} {filler()}"
    texts = [(i, toxic() if i % 3 == 0 else f'{filler()} he said "{family[i % 5]}" {filler()}' if i % 30 == 1 else filler(), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in texts], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert model.lexicon.stems
    edited = {w: f"x{w[1:]}" for w in family}  # within the stem
    edited |= {w: f"{w[:2]}x{w[3:]}" for w in family[:2]}
    assert all(model.lexicon.look_up(x.encode()) is not None and model.lexicon.look_up(x.encode())[1] for x in edited.values())
    for i, text, y in texts[:60]:
        for a, b in edited.items():
            text = text.replace(a, b)
        assert (model.score(text.encode()) >= toxicity.CUT) == y, (i, text)


def test_weights_of_misspellings():
    """A near word that was seen in clean texts weighs little; one that was never seen weighs a share of its term."""
    lexicon = toxicity.Lexicon({"moron": 6.0, "idiot": 6.0}, {"oron": (10, 150), "idjot": (30, 0), "table": (5, 5)}, (400, 3000))
    assert lexicon.weigh(b"moron") == (6.0, False) and lexicon.weigh(b"table") is None
    assert lexicon.weigh(b"oron")[0] < 0.3 < 2 < lexicon.weigh(b"morno")[0] < toxicity.EDITED * 6.0
    assert lexicon.weigh(b"idjot")[0] > 3 and lexicon.weigh(b"idito")[0] > 3
    assert lexicon.sums(b"an oron") < lexicon.sums(b"a moorn") < lexicon.sums(b"a moron")


def test_toxicity_ablations(spark):
    """On whole tables the scores are no worse for the automata, and quoted hits weigh a fitted share."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.learn(docs, labels)
    rows = docs.join(labels, "doc_id").where("toxic is not null").select("text", "toxic", toxicity.held_out(F.col("doc_id")).alias("held")).collect()
    y = np.array([r.toxic for r in rows], dtype=float)
    held = np.array([r.held for r in rows])

    def loss():
        """Held-out log loss of a model fitted on all other rows."""
        model.lexicon.known.clear()
        x = toxicity.features(np.array([model.lexicon.sums((r.text or "").encode()) for r in rows]), model.quoted_share)
        return toxicity.log_loss(x[held], y[held], toxicity.fit_logistic(x[~held], y[~held]))

    whole = loss()
    model.lexicon.trie = toxicity.TermTrie([])
    without = loss()
    print(whole, without)
    assert whole < without


def test_trie_is_levenshtein():
    """Edits are letters too many, left out or changed, and two neighbours that have changed places."""

    def distance(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a):
            nxt = [i + 1]
            for j, y in enumerate(b):
                nxt.append(min(nxt[j] + 1, rows[-1][j + 1] + 1, rows[-1][j] + (x != y)))
                if i and j and x == b[j - 1] and a[i - 1] == y:
                    nxt[-1] = min(nxt[-1], rows[-2][j - 1] + 1)
            rows.append(nxt)
        return rows[-1][-1]

    rng = np.random.default_rng(3)
    terms = sorted({"".join(rng.choice(list("abc"), rng.integers(4, 8))) for _ in range(40)})
    trie, wide = toxicity.TermTrie(terms), toxicity.TermTrie(terms, 2)
    for _ in range(300):
        word = "".join(rng.choice(list("abc"), rng.integers(3, 9)))
        near = min(((distance(t, word), t) for t in terms))
        assert trie.near(word) == ((near[1], near[0]) if near[0] <= 1 else None)
        assert near[0] > 1 or trie.may_have(word)
        assert wide.near(word) == ((near[1], near[0]) if near[0] <= 2 else None)


@folders
def test_packing(spark, both, which):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = docs_of(spark, both[which]).select("doc_id", "text").collect()
    want = []
    for d in docs:
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(str(d.doc_id), s, len(x := ids[s : s + 2048]), zlib.crc32(x.tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    got = packing.op4_packing(spark, both[which]).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    tokens = sum(r.length for r in got)
    assert len(sequences) <= -(-tokens // 2048) * 1.02 + 1


@folders
def test_hilbert(spark, both, which):
    docs = docs_of(spark, both[which]).select("doc_id", "text").collect()
    got = hilbert.op5_hilbert(spark, both[which]).collect()
    want = [(str(d.doc_id), len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs]
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(want)
    slots = [sorted(r.slot for r in got if r.shard == k) for k in range(8)]
    sizes = list(map(len, slots))
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(docs)
    assert all(s == list(range(len(s))) for s in slots)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    in_order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert in_order == sorted(in_order)


def test_curve_is_hilbert():
    """Each cell once, and neighbours on the curve are neighbours in the grid."""
    for dims, bits in ((2, 3), (3, 4), (4, 2)):
        index = hilbert.curve(dims, bits)
        cell = {i: c for c, i in enumerate(index)}
        assert sorted(index) == list(range(1 << dims * bits))
        place = lambda c: [(c >> bits * k) & ((1 << bits) - 1) for k in range(dims)]
        for i in range(len(cell) - 1):
            assert sum(abs(a - b) for a, b in zip(place(cell[i]), place(cell[i + 1]), strict=True)) == 1


def test_written_shards(spark, odd, tmp_path):
    hilbert.write_shards(odd, f"{tmp_path}/out", folder="run")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(repr, out.drop("run").collect())) == sorted(map(repr, odd.collect()))
    assert {(r.doc_id, r.run) for r in out.collect()} == {(r.doc_id, r.shard) for r in hilbert.sharded(odd).collect()}
    with pytest.raises(ValueError, match="is a column"):
        hilbert.write_shards(odd, f"{tmp_path}/other")


def test_written_shards_are_pruned(spark, data, tmp_path):
    """A filter on any one dimension skips well over half of the files by their least and greatest values."""
    import pyarrow.parquet as pq

    docs = docs_of(spark, data)
    hilbert.write_shards(docs, f"{tmp_path}/out", 64)
    ranges = []
    for file in (tmp_path / "out").glob("shard=*/*.parquet"):
        table = pq.read_table(file, columns=["lang", "source", "n_chars"])
        ranges.append({c: (min(v), max(v)) for c in table.column_names if (v := table[c].to_pylist())})
    assert len(ranges) >= 64
    for column, low, high in (("lang", "es", "es"), ("source", "src3", "src3"), ("n_chars", 700, 900)):
        assert docs.where(docs[column].between(low, high)).count()
        skipped = sum(r[column][1] < low or r[column][0] > high for r in ranges) / len(ranges)
        assert skipped > 0.6, (column, skipped)


@folders
def test_licenses(spark, both, which):
    docs = docs_of(spark, both[which]).select("doc_id", "text").collect()
    got = licenses.op6_licenses(spark, both[which]).collect()
    want = sorted(((str(d.doc_id), *brute.licenses(d.text)) for d in docs), key=repr)
    assert sorted(((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_licenses_with_edits():
    index = licenses.NoticeIndex()
    row = licenses.scan("x y. Licenced under the Apache Licence, version 2.0! z".encode(), index)
    assert row[5] == "apache-2.0" and row[7][0]["first"] == 2 and row[7][0]["edits"] == 2
    assert licenses.scan(b"nothing of the kind stands here", index)[5] == ""


def test_licenses_before_a_better_copy():
    """An edited notice beside a better one, and lists of both."""
    index = licenses.NoticeIndex()
    edited, exact = "released undex the mit license", "released under the mit license"
    spans = lambda text: [(x["first"], x["end"], x["edits"]) for x in licenses.scan(text.encode(), index)[7]]
    assert spans(f"{edited} and {exact}") == [(0, 5, 1), (6, 11, 0)]
    assert spans(f"{exact} {edited} {edited} {exact}") == [(0, 5, 0), (5, 10, 1), (10, 15, 1), (15, 20, 0)]
    assert spans("\n".join([edited, exact] * 50)) == [(5 * k, 5 * k + 5, 1 - k % 2) for k in range(100)]


def test_urls(spark, data):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{data}/pages.parquet'")
    want = con.sql(f"select page_id, host, path, rule, verdict from ({urls.ORACLE_SQL})").fetchall()
    got = urls.op7_urls(spark, data).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_urls_cases(spark):
    cases = [
        (None, ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("http://", ("", "", None, "allow")),
        ("HTTP://WWW.Example.COM/en/x?y", ("www.example.com", "/en/x", "www.example.com/en/", "allow")),
        ("a://m.example.com/en/", ("m.example.com", "/en/", "example.com/en/", "block")), ("a://com", ("com", "", None, "allow")),
        ("a://com?x/", ("com", "", None, "allow")), ("a://x.net/fr/#a", ("x.net", "/fr/", "net/fr/", "block")),
        ("a://b.spam-farm.example.org#/", ("b.spam-farm.example.org", "", None, "block")), ("a://xcom/", ("xcom", "/", None, "allow")),
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, (u, _) in enumerate(cases)] * 2, "page_id long, url string, host string")
    got = urls.judge_urls(pages).collect()
    assert sorted(tuple(r)[1:] for r in got if r.rule) == sorted(w for _, w in cases * 2 if w[2])
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: w for i, (_, w) in enumerate(cases)} and len(got) == 2 * len(cases)
    assert urls.judge_urls(pages.limit(0)).collect() == []


def opened(folder, entries):
    for name, data in urls.DigestArray.files(entries).items():
        (folder / f"t-{name}.npy").write_bytes(data)
    return urls.DigestArray(f"{folder}/t")


def test_digest_array_of_many(tmp_path, monkeypatch):
    """A long list, and digests that many strings share."""
    entries = [(f"host{i}.example.org/p{i % 7}/", i % 2) for i in range(100_000)]
    array = opened(tmp_path, entries)
    wanted = [e[0] for e in entries[::97]] + [f"none{i}" for i in range(1000)]
    assert array.probe(wanted).tolist() == [c for _, c in entries[::97]] + [-1] * 1000
    monkeypatch.setattr(urls, "digest", lambda raw: len(raw) % 3)
    array = opened(tmp_path, entries[:300])
    assert array.probe([e[0] for e in entries[:400]]).tolist() == [c for _, c in entries[:300]] + [-1] * 100


def test_long_url_lists(spark):
    rules = [("block" if i % 2 else "allow", f"h{i}.example.com/{'a/' * (i % 3)}") for i in range(20_000)]
    pages = spark.createDataFrame([(i, f"http://www.h{i}.example.com/a/a/x") for i in range(0, 25_000, 50)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, rules, []).collect()}
    assert got == {i: (rules[i][1], rules[i][0]) if i < 20_000 else (None, "allow") for i in range(0, 25_000, 50)}


def test_digest_array_confirms_strings(tmp_path):
    array = opened(tmp_path, [("a", 1), ("b", 0), ("b", 1)])
    assert array.probe(["a", "b", "c", ""]).tolist() == [1, 1, -1, -1]
    strings = np.array(array.strings)
    strings[int(array.offsets[0])] ^= 1  # a digest that fits while its string does not
    array.strings = strings
    assert array.probe(["a", "b"]).tolist().count(-1) == 1


@folders
def test_quality(spark, both, which):
    docs = docs_of(spark, both[which]).select("doc_id", "text").collect()
    got = quality.op8_quality(spark, both[which]).collect()
    want = sorted(((str(d.doc_id), *brute.quality(d.text)) for d in docs), key=repr)
    assert sorted(((str(r.doc_id), *tuple(r)[1:7]) for r in got), key=repr) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    rel = con.sql(registry.oracle_sql()["op8_quality"])
    got = quality.op8_quality(spark, data).select(*rel.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rel.fetchall()))


def test_bad_hosts(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "bad words", "bad") for i in range(40)] + [(100, good, "bad")] + [(200 + i, good, f"good{i % 4}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert kept == {200 + i for i in range(80)} == {r.doc_id for r in quality.keep_good(docs).collect()}


@folders
def test_pii(spark, both, which):
    docs = docs_of(spark, both[which]).select("doc_id", "text").collect()
    got = pii.op9_pii(spark, both[which]).collect()
    want = sorted(((str(d.doc_id), *brute.pii_row(d.text)) for d in docs), key=repr)
    assert sorted(((str(r.doc_id), *tuple(r)[1:6]) for r in got), key=repr) == want


def test_pii_context_and_redaction(spark):
    text = "my iban is GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32, mail a@b.co"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "clean text")], "doc_id long, text string")
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == [
        "my iban is [IBAN] and GB83 WEST 1234 5698 7654 32, mail [EMAIL]", None, "clean text"
    ]
    assert pii.with_pii(docs).where("doc_id = 1").first().pii[0].score == pytest.approx(0.9)


def scores_from_scratch(texts):
    """Shares of each item's own BM25 score by term, from the item texts alone."""
    words = [w for t in texts if (w := decontaminate.words_of((t or "").encode()))]
    n, mean = len(words), sum(map(len, words)) / max(1, len(words))
    out = []
    for ws in words:
        raw = {}
        for w in set(ws):
            df, tf = sum(w in other for other in words), ws.count(w)
            raw[w] = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        out.append({w: x / sum(raw.values()) for w, x in raw.items()})
    return words, out


def common(a, b):
    """Length of the longest common subsequence, by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        nxt = [0]
        for j, y in enumerate(b):
            nxt.append(row[j] + 1 if x == y else max(row[j + 1], nxt[j]))
        row = nxt
    return row[-1]


def found_from_scratch(docs, items):
    """Every passage against every item."""
    items = [(i, t) for i, t in items if decontaminate.words_of((t or "").encode())]
    words, weight = scores_from_scratch([t for _, t in items])
    group = [0 if len(w) <= 64 else 1 if len(w) <= 256 else 2 for w in words]
    stride = {g: max(len(w) for w, x in zip(words, group, strict=True) if x == g) for g in set(group)}
    found = set()
    for d, text in docs:
        ours = decontaminate.words_of((text or "").encode())
        for (item, t), mine, g in zip(items, weight, group, strict=True):
            question, answer = decontaminate.question_and_answer(t.encode())
            for lo in range(0, len(ours), stride[g]):
                passage = ours[lo : lo + 2 * stride[g]]
                have = mine.keys() & set(passage)
                if sum(mine[w] for w in have) >= decontaminate.THRESHOLD - 1e-9:
                    q = common(question, passage) / max(1, len(question))
                    a = common(answer, passage) / len(answer) if answer else 1
                    if q >= decontaminate.OVERLAP and a >= decontaminate.OVERLAP:
                        found.add((d, item))
    return found


def test_pii_of_many_matches(spark):
    """Places and redaction of texts with thousands of matches, beyond a block of sums and a chunk of text."""
    texts = ["é, a@b.co +1 (202) 555-0100x" * 3000, "a@b.co" + " ü" * 40_000 + "c@d.org 10.0.0.1", "a@b.co" * 200, "x" * 16_384 + "a@b.co" + "y" * 16_378]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.with_pii(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, t in enumerate(texts):
        want = brute.pii(t)
        assert [(s.start, s.kind_no, s.kind, s.end) for s in rows[i].pii if s.kind != "iban"] == want
        at, out = 0, []
        for s in rows[i].pii:
            if s.start >= at:
                out += [t[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        assert clean[i] == "".join(out) + t[at:]


@folders
def test_decontamination(spark, both, which):
    """Against the scores of every passage and item, without index or bounds."""
    docs = docs_of(spark, both[which]).select("doc_id", "text").collect()
    items = spark.read.parquet(f"{both[which]}/benchmark.parquet").collect()
    got = decontaminate.op10_decontamination(spark, both[which]).collect()
    want = found_from_scratch(docs, [tuple(r) for r in items])
    assert {(r.doc_id, r.item_id) for r in got} == want and want


def test_decontamination_by_length(spark):
    """Short and long items at once, many copies of one, items that share all words, a passage without the rare word."""
    rng = np.random.default_rng(9)
    draw = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 400, n))
    long, longest = draw(200), draw(5_000)
    short = "seven wizards mix a potion of jade and quartz near the old mill"
    shared = [" ".join(rng.permutation("alpha beta gamma delta epsilon zeta eta theta".split())) for _ in range(12)]
    items = [(1, long), (2, longest), *((10 + k, short) for k in range(50)), *((100 + k, t) for k, t in enumerate(shared)), (200, "plain words and a xylophone")]
    texts = [(1, f"{draw(90)} {long} {draw(70)}"), (2, f"{draw(10)} {longest}"), (3, f"{draw(30)} {short} {draw(5)}"), (4, shared[3]), (5, "plain words and a horn"), (6, draw(300)), (7, None)]
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found == found_from_scratch(texts, items)
    assert {(1, 1), (2, 2), (4, 103)} <= found and {i for d, i in found if d == 3} >= set(range(10, 60))


def test_very_long_items(spark):
    text = " ".join(f"w{i * 7919 % 10_007}" for i in range(40_000))
    docs = spark.createDataFrame([(1, f"so {text} it is"), (2, "w1 w2 w3")], "doc_id long, text string")
    items = spark.createDataFrame([(1, text), (2, "a short question of eight words is here")], "item_id long, text string")
    assert [tuple(r)[:2] for r in decontaminate.contaminated(docs, items).collect()] == [(1, 1)]


def test_decontamination_in_blocks(spark, data):
    docs, items = docs_of(spark, data), spark.read.parquet(f"{data}/benchmark.parquet")
    whole = {tuple(r)[:2] for r in decontaminate.contaminated(docs, items).collect()}
    assert {tuple(r)[:2] for r in decontaminate.contaminated(docs, items, limit=15).collect()} == whole


def test_decontamination_without_rare_terms(spark):
    """Items whose terms are all common: repeated ones, and one of words that many others hold."""
    same = "seven wizards mix a potion of jade and quartz near the old mill"
    many = [f"one plus two makes{a} and{b} four" for a in range(4) for b in range(10)]
    text = f"so it was said that {same} and then nothing more"
    docs = spark.createDataFrame([(1, text), (2, "nothing of the kind"), (3, f"x {many[7]} y")], "doc_id long, text string")
    items = spark.createDataFrame([*((k, same) for k in range(20)), *((100 + k, t) for k, t in enumerate(many))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert {i for d, i in got if d == 1} == set(range(20))
    assert (3, 107) in got and not {i for d, i in got if d == 2}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [2]


def test_decontamination_bound_loses_no_passage():
    """Candidates against the scores of every passage, with terms from rare to in all items."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}".encode() for i in range(30)]
    draw = lambda n: [vocabulary[i] for i in np.minimum(rng.geometric(0.12, n) - 1, 29)]
    items = [(k, b" ".join(draw(8))) for k in range(60)]
    df: dict = {}
    for _, t in items:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.ItemIndex(items, df, len(items), 8.0)
    texts = [draw(int(rng.integers(0, 60))) for _ in range(80)]
    get, none, stride = index.term.get, len(index.lists), index.strides[0]
    ids, segment, last, want, base = [], [], [], set(), 0
    for words in texts:
        for lo in range(0, len(words), stride):
            have = {get(w, none) for w in words[lo : lo + 2 * stride]}
            score = np.zeros(len(items))
            for t in have - {none}:
                score[index.lists[t][0]] += index.lists[t][1]
            want |= {base + lo // stride} if score.max() >= 0.8 else set()
        n = -(-len(words) // stride)
        ids += [get(w, none) for w in words]
        segment += [base + i // stride for i in range(len(words))]
        last += [i == n - 1 for i in range(n)]
        base += n
    arrays = np.array(ids), np.array(segment), np.array([*last, False])
    got = index.candidates(*arrays, 0.8).tolist()
    assert want and want <= set(got)
    decontaminate.PAIRS, held = 1, decontaminate.PAIRS
    assert index.candidates(*arrays, 0.8).tolist() == got
    decontaminate.PAIRS = held


def test_short_last_sentence_is_question():
    assert decontaminate.question_and_answer(b"Name the old mill of jade. Show work.")[1] == []
    assert decontaminate.question_and_answer(b"Name the old mill.\nJade")[1] == [b"jade"]
    assert decontaminate.question_and_answer(b"Name the mill. It is the old one")[1] == [b"it", b"is", b"the", b"old", b"one"]


def test_empty_tables(spark, nothing, tmp_path):
    for name, schema in (("documents", nothing.schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, run in registry.queries().items():
        assert run(spark, str(tmp_path)).collect() == [], name


def test_operators_with_clashing_columns(spark, odd):
    """The operators, not only their queries, take tables with columns named like their own."""
    n = odd.count()
    components = sorted(str(r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert components == sorted(str(r.component_id) for r in simhash.near_duplicates(odd.select("doc_id", "text")).collect())
    assert maxent.scored(odd).count() == n
    assert packing.packed(odd).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert hilbert.sharded(odd).count() == n
    assert licenses.license_scan(odd).count() == n
    assert quality.judged(odd).count() == n
    assert pii.with_pii(odd, out="found").count() == n
    assert infill.infilled(odd).count() == n and copies.exact_groups(odd).count() == n


def test_head_words(spark):
    counts = spark.createDataFrame([(f"w{i}", 0, 1 + i % 7 + 1000 * (i == 3)) for i in range(70)], "w string, slot int, c long")
    assert {r.w for r in maxent.head_words(counts, 5).collect()} == {"w3"}
    assert {r.c for r in maxent.head_words(counts, 25).collect()} == {7, 6, 1004}
    assert maxent.head_words(counts, 70).count() == 70
