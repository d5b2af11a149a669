"""Queries: mixing, sampling, set operations, pairs and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import mixing as M
from curata.operators import pairs as P
from curata.plans.catalogue import query
from curata.sources.tables import chunk_boundaries, part_manifest, table


def _docs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "source", "lang", "n_chars")))


def placed(group: str, seed: str = "42") -> str:
    by = f"PARTITION BY {group} " if group else ""
    return f"SELECT *, row_number() OVER ({by}ORDER BY md5('{seed}:' || doc_id), doc_id) - 1 AS place FROM documents"


@query("mix_by_fraction", f"WITH p AS ({placed('source')}) SELECT doc_id, source FROM p JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source) WHERE place < CASE source WHEN 'src1' THEN floor(0.5 * n) WHEN 'src2' THEN floor(0.3 * n) WHEN 'src3' THEN 5 ELSE 0 END")
def mix_by_fraction(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "source").where(F.col("source").isin("src1", "src2", "src3"))
    counts = {r.source: r.n for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}  # three rows
    amounts = M.mixer_amounts(["src1", "0.5", "src2", "0.3", "src3", "5"], counts | {k: 0 for k in ("src1", "src2", "src3") if k not in counts})
    quota = F.lit(0)
    for name, n in amounts.items():
        quota = F.when(F.col("source") == name, F.lit(n)).otherwise(quota)
    return M.first_by_hash(docs, ["source"], quota, "doc_id").select("doc_id", "source")


TARGETS = [("src1", 37), ("src4", 120), ("src5", 7)]


@query("mix_upsample", f"""WITH p AS ({placed('source')}), t(source, target) AS (VALUES {', '.join(map(str, TARGETS))}), s AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
r AS (SELECT *, target // size + (place < target % size)::INT AS copies FROM p JOIN t USING (source) JOIN s USING (source))
SELECT doc_id, source, unnest(range(copies))::INT AS copy, target > size AS is_upsampled, round(target / size, 6) AS factor FROM r""")
def mix_upsample(spark, sf_dir):
    targets = spark.createDataFrame(TARGETS, "source string, target long")
    return M.resampled(_docs(spark, sf_dir, "doc_id", "source"), "source", targets, "doc_id").select("doc_id", "source", "copy", "is_upsampled", "factor")


@query("mix_stats", """WITH d AS (SELECT source, n_chars, n_chars <= 4000 AS kept FROM documents)
SELECT source, count(*) AS initial, sum(kept::INT)::BIGINT AS final, sum((NOT kept)::INT)::BIGINT AS filtered, coalesce(sum(n_chars) FILTER (kept), 0)::BIGINT AS total, round(avg(n_chars) FILTER (kept), 4) AS mean,
round(100.0 * coalesce(sum(n_chars) FILTER (kept), 0) / sum(sum(n_chars) FILTER (kept)) OVER (), 4) AS percent FROM d GROUP BY source""")
def mix_stats(spark, sf_dir):
    from curata.operators.stats import mix_stats

    return mix_stats(_docs(spark, sf_dir), "source", "n_chars", F.col("n_chars") <= 4000)


@query("stratified_quota", f"WITH p AS ({placed('lang')}) SELECT doc_id, lang FROM p WHERE place < CASE lang WHEN 'en' THEN 60 WHEN 'fr' THEN 30 WHEN 'de' THEN 10 ELSE 0 END")
def stratified_quota(spark, sf_dir):
    return M.stratified(_docs(spark, sf_dir, "doc_id", "lang"), "lang", {"en": 0.6, "fr": 0.3, "de": 0.1}, 100, "doc_id")


@query("n_per_group", f"WITH p AS ({placed('source, lang')}) SELECT source, lang, doc_id FROM p JOIN (SELECT source, lang FROM documents GROUP BY ALL HAVING count(*) >= 6) USING (source, lang) WHERE place < 6")
def n_per_group(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "source", "lang").withColumn("g", F.concat_ws("|", "source", "lang"))
    return M.n_per_group(docs, "g", 6, "doc_id").select("source", "lang", "doc_id")


@query("subset_update", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src1') UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def subset_update(spark, sf_dir):
    extra = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return M.subset_updated(_docs(spark, sf_dir, "doc_id", "source", "lang"), ["src0", "src1"], {"benchmark": extra}, drop=["lang"])


@query("common_ids", "SELECT n_chars // 500 AS bucket FROM documents GROUP BY bucket HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM documents)")
def common_ids(spark, sf_dir):
    return M.common_ids(_docs(spark, sf_dir, "lang", "n_chars").withColumn("bucket", F.expr("n_chars div 500")), "lang", "bucket")


@query("anti_join_prompts", "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def anti_join_prompts(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "text")
    bad = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("text").distinct()
    return docs.join(bad, "text", "left_anti").select("doc_id")


@query("concat_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents WHERE n_chars > 1000")
def concat_index(spark, sf_dir):
    return M.numbered(_docs(spark, sf_dir, "doc_id", "n_chars").where("n_chars > 1000"), "doc_id").select("doc_id", "index")


@query("synthetic_ids", "SELECT doc_id, source || '_' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS id FROM documents")
def synthetic_ids(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return _docs(spark, sf_dir, "doc_id", "source").select("doc_id", F.concat("source", F.lit("_"), n.cast("string")).alias("id"))


@query("repeat_each", "SELECT r_regionkey, unnest(range(3))::INT AS repeat FROM region")
def repeat_each(spark, sf_dir):
    return M.repeated_each(table(spark, sf_dir, "region").select("r_regionkey"), 3)


@query("rank_stride", f"WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('45:' || doc_id), doc_id) - 1 AS place FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), n AS (SELECT count(*) AS n FROM p) SELECT doc_id, place, place // 64 AS batch FROM p, n WHERE place < n // 64 * 64 AND place % 64 % 4 = 1")
def rank_stride(spark, sf_dir):
    out = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return M.epoch_shard(_docs(spark, sf_dir, "doc_id"), "doc_id", 3, 64, 4, 1, out)


@query("thinking_budget", "SELECT doc_id, 100 + ('0x' || md5('budget:' || doc_id)[1:8])::BIGINT % 901 AS budget FROM documents")
def thinking_budget(spark, sf_dir):
    return M.thinking_budget(_docs(spark, sf_dir, "doc_id", "source"), "doc_id", "source", 100, 1000).select("doc_id", "budget")


@query("filled_placeholders", "SELECT n_nationkey, 'I come from ' || 'Earth' || ', ' || n_name AS text FROM nation WHERE n_regionkey <> 2")
def filled_placeholders(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("I come from {{PLANET}}, "), "n_name").alias("text"), F.array(F.col("n_regionkey").cast("string")).alias("tags"))
    return M.filled_placeholders(rows, "text", {"PLANET": "Earth"}, "tags", ["2"]).drop("tags")


@query("environment_rows", "SELECT range AS id, 'Count to ' || (range % 7 + 1) || '.' AS prompt, range % 7 + 1 AS goal FROM range(50)")
def environment_rows(spark, sf_dir):
    return M.environment_rows(spark, 50, 7).drop("tools")


@query("hash_split", "SELECT CASE WHEN ('0x' || md5('split:' || doc_id)[1:8])::BIGINT % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def hash_split(spark, sf_dir):
    h = F.conv(F.substring(M.shuffled_key("split", F.col("doc_id")), 1, 8), 16, 10).cast("long")
    split = F.when(h % 10 == 0, "test").otherwise("train")
    return _docs(spark, sf_dir).groupBy(split.alias("split")).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


@query("token_chunks", """WITH p AS (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM documents),
c AS (SELECT doc_id, b, b + n_chars AS e, unnest(range(b // 100000, (greatest(b + n_chars, b + 1) - 1) // 100000 + 1)) AS chunk_id FROM p)
SELECT doc_id, chunk_id, greatest(b - chunk_id * 100000, 0) AS doc_start, least(e - chunk_id * 100000, 100000) AS doc_end FROM c""")
def token_chunks(spark, sf_dir):
    return chunk_boundaries(_docs(spark, sf_dir, "doc_id", "n_chars"), "doc_id", "n_chars", 100_000)


@query("part_manifest", "SELECT doc_id // 100 AS part, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def manifest(spark, sf_dir):
    return part_manifest(_docs(spark, sf_dir, "doc_id", "text"), F.expr("doc_id div 100"), "doc_id", "text")


# pairs

OFFERS = "WITH o AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS i, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t FROM lineitem) "


def _offers(spark, sf_dir):
    """Line items stand for the completions of a part."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), F.col("l_quantity").cast("double").alias("q"),
        F.col("l_discount").cast("double").alias("d"), F.col("l_tax").cast("double").alias("t"),
    )


def best_worst_sql(score: str, more: str = "") -> str:
    return OFFERS + f""", s AS (SELECT k, i, {score} AS s FROM o),
e AS (SELECT k, max(s) AS best, min(s) AS worst, count(*) AS n FROM s GROUP BY k)
SELECT e.k, min(i) FILTER (s = best) AS chosen, max(i) FILTER (s = worst) AS rejected, round(best, 6) AS best, round(worst, 6) AS worst
FROM s JOIN e USING (k) WHERE n > 1 AND best > worst {more} GROUP BY e.k, best, worst"""


@query("best_worst_pair", best_worst_sql("round((q + 100 * d) / 2, 6)", "AND best >= 20 AND best - worst >= 10"))
def best_worst_pair(spark, sf_dir):
    return P.best_and_worst(_offers(spark, sf_dir), "k", "i", F.round((F.col("q") + 100 * F.col("d")) / 2, 6), 20, 10)


@query("weighted_pair", best_worst_sql("round(q * 0.65 + d * 80 + t * 45, 6)"))
def weighted_pair(spark, sf_dir):
    return P.best_and_worst(_offers(spark, sf_dir), "k", "i", F.round(F.col("q") * 0.65 + F.col("d") * 80 + F.col("t") * 45, 6))


@query("rejection_sampling", OFFERS + "SELECT k, min(i) FILTER (q = hi) AS chosen, min(i) FILTER (q = lo) AS rejected FROM (SELECT *, max(q) OVER (PARTITION BY k) AS hi, min(q) OVER (PARTITION BY k) AS lo FROM o) GROUP BY k")
def rejection_sampling(spark, sf_dir):
    return P.rejection_sampled(_offers(spark, sf_dir), ["k"], "i", "q")


@query("majority_vote", """WITH v AS (SELECT user_id AS k, event_id AS v, event_type AS c FROM events), n AS (SELECT k, c, count(*) AS n, min(md5(k || ':' || v)) AS h FROM v GROUP BY k, c), m AS (SELECT *, max(n) OVER (PARTITION BY k) AS most FROM n)
SELECT k, c AS choice, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, CASE WHEN most = 1 THEN h END, c) AS r FROM m) WHERE r = 1""")
def majority_vote(spark, sf_dir):
    votes = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), F.col("event_type").alias("c"))
    return P.majority_vote(votes, "k", "v", "c")


@query("top_vs_rest", OFFERS + """, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY q, i) AS r FROM o)
SELECT k, arg_min(i, md5('42:c:' || i)) FILTER (r <= 4) AS chosen, arg_min(i, md5('42:r:' || i)) FILTER (r > 4) AS rejected FROM r GROUP BY k HAVING count(*) > 4""")
def top_vs_rest(spark, sf_dir):
    return P.top_vs_rest(_offers(spark, sf_dir), "k", "i", "q", 4)


@query("comparison_margin", "SELECT event_id, CASE WHEN value > 50 THEN 0 WHEN value < 50 THEN 1 END AS chosen, round(abs(value - 50), 4) AS margin FROM events WHERE value <> 50")
def comparison_margin(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", P.comparison_margin(F.col("value"), F.lit(50)).alias("c"))
    return e.where("c.chosen is not null").select("event_id", "c.chosen", F.round("c.margin", 4).alias("margin"))


@query("aspect_pivot_binarize", "SELECT user_id, count(DISTINCT event_type) AS aspects, round(avg(m), 4) AS mean, max(event_type) FILTER (m = hi) AS top FROM (SELECT *, max(m) OVER (PARTITION BY user_id) AS hi FROM (SELECT user_id, event_type, round(avg(value), 6) AS m FROM events GROUP BY ALL)) GROUP BY user_id")
def aspect_pivot_binarize(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    means = events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("m"))
    names = sorted(r[0] for r in events.select("event_type").distinct().collect())  # a handful
    wide = P.aspects_pivoted(means, "user_id", "event_type", "m", names)
    rated = F.array(*(F.struct(F.col(f"`{n}`").alias("m"), F.lit(n).alias("n")) for n in names))
    known = F.filter(rated, lambda x: x["m"].isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x["m"]) / F.size(known)
    return wide.select("user_id", F.size(known).cast("long").alias("aspects"), F.round(mean, 4).alias("mean"), F.array_max(known)["n"].alias("top"))


@query("dedup_first", "SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_first(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5("text").alias("digest"))
    return P.keep_first(docs, ["digest"], ["doc_id"])


@query("longest_per_key", "SELECT source, min(doc_id) AS doc_id, any_value(n)::INT AS length FROM (SELECT source, doc_id, length(text) AS n, max(length(text)) OVER (PARTITION BY source) AS hi FROM documents) WHERE n = hi GROUP BY source")
def longest_per_key(spark, sf_dir):
    return P.longest_per_key(_docs(spark, sf_dir, "doc_id", "source", "text"), "source", "text", "doc_id")


@query("random_per_key", "SELECT source, arg_min(doc_id, md5('42:' || doc_id)) AS doc_id FROM documents GROUP BY source")
def random_per_key(spark, sf_dir):
    return P.random_per_key(_docs(spark, sf_dir, "doc_id", "source"), "source", "doc_id")


@query("latest_per_evaluator", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_evaluator(spark, sf_dir):
    return P.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("left_join_reference", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def left_join_reference(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("lookup_with_counts", "SELECT o_custkey AS id, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS num_outputs FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_with_counts(spark, sf_dir):
    from pyspark.sql import Window

    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return joined.select(F.col("o_custkey").alias("id"), "o_orderkey", F.count("*").over(Window.partitionBy("o_custkey")).alias("num_outputs"))


@query("prompt_hash_join", "SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.doc_id < b.doc_id AND a.source = b.source")
def prompt_hash_join(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "source", F.sha2("text", 256).alias("h"))
    return docs.toDF("a", "source", "h").join(docs.toDF("b", "source", "h"), ["h", "source"]).where("a < b").select("a", "b")


@query("prompt_ids", "SELECT doc_id, sha256(text || doc_id) AS prompt_id FROM documents")
def prompt_ids(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", P.prompt_id(F.col("text"), F.col("doc_id")).alias("prompt_id"))


@query("strata_heads", "SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT tag, min(doc_id) AS doc_id FROM (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN lang = 'fr' THEN 'french' END, CASE WHEN n_chars > 100 THEN 'some' END], lambda x: x IS NOT NULL)) AS tag FROM documents) GROUP BY tag) GROUP BY doc_id")
def strata_heads(spark, sf_dir):
    strata = {"long": F.col("n_chars") > 5000, "french": F.col("lang") == "fr", "some": F.col("n_chars") > 100}
    return P.strata_heads(_docs(spark, sf_dir), "doc_id", strata)


@query("swapped_sides", "SELECT doc_id, ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 2 = 1 AS swap FROM documents")
def swapped_sides(spark, sf_dir):
    return P.swapped_sides(_docs(spark, sf_dir, "doc_id"), "doc_id")


@query("matched_depletion", "SELECT source, count(*) AS arms, round(CASE WHEN max(s) = 0 THEN 0.0 ELSE (max(s) - min(s)) / max(s) END, 6) AS error, CASE WHEN max(s) = 0 THEN true ELSE (max(s) - min(s)) / max(s) <= 0.8 END AS matched FROM (SELECT source, lang, sum(n_chars) AS s FROM documents GROUP BY ALL) GROUP BY source")
def matched_depletion(spark, sf_dir):
    return P.matched_depletion(_docs(spark, sf_dir), "lang", "source", "n_chars", 0.8)
