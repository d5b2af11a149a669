"""Queries: statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions.native import words
from curata.operators import stats as S
from curata.plans.catalogue import query
from curata.sources.tables import table

WORDS = r"len(list_filter(string_split_regex(text, '[ \t-\r]+'), lambda w: w <> ''))"
DESCRIBE = "count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75, max(x) AS max"


@query("length_stats", f"SELECT name, {DESCRIBE} FROM (SELECT 'n_chars' AS name, n_chars::DOUBLE AS x FROM documents UNION ALL SELECT 'n_words', ({WORDS})::DOUBLE FROM documents) GROUP BY name")
def length_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("n_chars", F.size(words(F.col("text"))).alias("n_words"))
    return S.described(docs, ["n_chars", "n_words"])


@query("conversation_stats", f"""WITH t AS (SELECT conv_id, count(*)::DOUBLE AS turns, sum({WORDS}) FILTER (role = 'user')::DOUBLE AS user_words, sum({WORDS}) FILTER (role = 'assistant')::DOUBLE AS answer_words, sum({WORDS})::DOUBLE AS all_words FROM conversations WHERE role <> 'system' GROUP BY conv_id)
SELECT name, {DESCRIBE} FROM (UNPIVOT t ON turns, user_words, answer_words, all_words INTO NAME name VALUE x) GROUP BY name""")
def conversation_stats(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("w", F.size(words(F.col("text"))))
    of = lambda r: F.sum(F.when(F.col("role") == r, F.col("w")))
    t = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), of("user").alias("user_words"), of("assistant").alias("answer_words"), F.sum("w").alias("all_words"))
    return S.described(t, ["turns", "user_words", "answer_words", "all_words"])


@query("over_length_counts", "SELECT count(*) FILTER (n_chars > 512) AS over_512, count(*) FILTER (n_chars > 1024) AS over_1024, count(*) FILTER (n_chars > 2048) AS over_2048, count(*) FILTER (n_chars > 4096) AS over_4096 FROM documents")
def over_length_counts(spark, sf_dir):
    return S.over_counts(table(spark, sf_dir, "documents"), "n_chars", [512, 1024, 2048, 4096])


@query("longest_documents", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def longest_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)


@query("length_percentiles", "SELECT unnest([10, 20, 30, 40, 50, 60, 70, 80, 90])::INT AS point, round(unnest(quantile_cont(n_chars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])), 4) AS value FROM documents")
def length_percentiles(spark, sf_dir):
    return S.percentiles(table(spark, sf_dir, "documents"), "n_chars", list(range(10, 100, 10)))


@query("length_histogram", "WITH b AS (SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5) SELECT n_chars // 1000 AS bin, CASE WHEN b.n IS NULL THEN 'Other' ELSE source END AS category, count(*) AS count FROM documents LEFT JOIN b USING (source) GROUP BY 1, 2")
def length_histogram(spark, sf_dir):
    return S.histogram(table(spark, sf_dir, "documents"), "n_chars", 1000, "source")


@query("log_length_histogram", "SELECT CASE WHEN n_chars > 0 THEN floor(log2(n_chars::DOUBLE)) ELSE -1 END::BIGINT AS bin, count(*) AS count FROM documents GROUP BY 1")
def log_length_histogram(spark, sf_dir):
    return S.log_bins(table(spark, sf_dir, "documents"), "n_chars")


@query("annotation_agreement", """WITH r AS (SELECT user_id, (value > 50)::INT AS l, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, coalesce(value, 0) AS v FROM events)),
p AS (SELECT user_id, count(*) AS c, (min(l) = max(l))::INT AS same FROM r WHERE n <= 2 GROUP BY user_id)
SELECT (SELECT round(avg(l), 6) FROM r) AS acceptance_rate, (SELECT count(*) FROM r) AS labels, round(avg(same), 6) AS agreement, count(*) AS items FROM p WHERE c = 2""")
def annotation_agreement(spark, sf_dir):
    return S.agreement(table(spark, sf_dir, "events"), "user_id", F.col("value") > 50, ["ts", "event_id"])


_PREF = "(event_id % 5 - 2)"


@query("win_rates", f"""WITH e AS (SELECT event_type AS a, CASE event_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'purchase' ELSE 'alpha' END AS b, {_PREF} AS p FROM events),
u AS (SELECT least(a, b) AS first, greatest(a, b) AS second, CASE WHEN a > b THEN -p ELSE p END AS p FROM e WHERE a <> b)
SELECT first, second, count(*) AS n, round(avg((p = 2)::INT), 6) AS clear_win, round(avg((p = 1)::INT), 6) AS slight_win, round(avg((p = 0)::INT), 6) AS tie, round(avg((p = -1)::INT), 6) AS slight_loss, round(avg((p = -2)::INT), 6) AS clear_loss,
round(avg(CASE WHEN p > 0 THEN 1.0 WHEN p = 0 THEN 0.5 ELSE 0.0 END), 6) AS relaxed FROM u GROUP BY ALL""")
def win_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("a"), F.expr("case event_id % 3 when 0 then 'base' when 1 then 'purchase' else 'alpha' end").alias("b"), F.expr(_PREF).alias("p"))
    return S.win_rates(e, "a", "b", F.col("p"))


@query("model_pairs", "SELECT DISTINCT least(a.event_type, b.event_type) AS first, greatest(a.event_type, b.event_type) AS second FROM (SELECT DISTINCT event_type FROM events) a JOIN (SELECT DISTINCT event_type FROM events) b ON a.event_type < b.event_type")
def model_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "events").select("event_type").distinct()
    return names.toDF("first").join(names.toDF("second"), F.col("first") < F.col("second"))


@query("tool_metrics", "SELECT event_type, count(*) AS calls, round(count(*) / (SELECT count(DISTINCT user_id) FROM events), 6) AS calls_per_rollout, round(avg((value > 80)::INT), 6) AS failure_rate, round(avg(value), 4) AS mean_runtime FROM events GROUP BY GROUPING SETS ((event_type), ())")
def tool_metrics(spark, sf_dir):
    return S.tool_metrics(table(spark, sf_dir, "events"), "event_type", "user_id", F.col("value") > 80, F.col("value"))


@query("solve_rate_stats", "SELECT count(*) AS groups, count(*) FILTER (hi = 0) AS zero, count(*) FILTER (lo = 1) AS solved, count(*) FILTER (sd > 0) AS nonzero_std, round(100.0 * avg((lo = 1)::INT), 4) AS percent_solved FROM (SELECT user_id, min(r) AS lo, max(r) AS hi, stddev_pop(r) AS sd FROM (SELECT user_id, (value > 99)::INT AS r FROM events) GROUP BY user_id)")
def solve_rate_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") > 99).cast("int").alias("r"))
    return S.solve_rates(e, "user_id", "r", 1)


@query("step_metrics", "SELECT event_id // 512 AS step, round(avg(n), 4) AS mean_length, min(n) AS min_length, max(n) AS max_length, round(avg(n) FILTER (value > 50), 4) AS solved_length, round(avg(n) FILTER (NOT value > 50), 4) AS unsolved_length, round(avg((event_type = 'click')::INT), 6) AS stop_rate FROM (SELECT *, length(props) AS n FROM events) GROUP BY 1")
def step_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("n", F.length("props").cast("long"))
    return S.step_metrics(e, F.expr("event_id div 512"), "n", F.col("value") > 50, F.col("event_type") == "click")


@query("reward_by_type", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def reward_by_type(spark, sf_dir):
    return S.by_type(table(spark, sf_dir, "events"), "event_type", "value")


@query("usage_cost", "SELECT lang, i AS input_tokens, o AS output_tokens, round(coalesce((i * p.a + o * p.b) / 1e6, 0.0), 6) AS cost FROM (SELECT lang, sum(n_chars)::BIGINT AS i, sum(n_chars // 4)::BIGINT AS o FROM documents GROUP BY lang) LEFT JOIN (VALUES ('en', 2.5, 10.0), ('fr', 1.0, 4.0)) p(lang, a, b) USING (lang)")
def usage_cost(spark, sf_dir):
    prices = spark.createDataFrame([("en", 2.5, 10.0), ("fr", 1.0, 4.0)], "lang string, input double, output double")
    usage = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("input_tokens"), F.expr("n_chars div 4").alias("output_tokens"))
    return S.usage_cost(usage, prices, "lang")


@query("masked_mean", "SELECT vec_id, round(coalesce(list_sum(list_filter(embedding, lambda x: x > 0)) / nullif(len(list_filter(embedding, lambda x: x > 0)), 0), 0), 4) AS mean FROM embeddings")
def masked_mean(spark, sf_dir):
    mask = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.masked_mean(F.col("embedding"), mask), 4).alias("mean"))


@query("manifest_mismatches", "SELECT s.source, docs, chars, docs + (s.source = 'src3')::INT AS stated FROM (SELECT source, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source) s WHERE source = 'src3'")
def manifest_mismatches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stated = docs.groupBy("source").agg((F.count("*") + (F.col("source") == "src3").cast("int")).alias("docs"), F.sum("n_chars").alias("chars"))
    bad = S.reconciled(docs, stated, "source", {"docs": F.count("*"), "chars": F.sum("n_chars")})
    return bad.select("source", F.col("stored_docs").alias("docs"), "chars", F.col("docs").alias("stated"))


@query("reporting_summary", "SELECT user_id, count(*) AS records, sum(event_id)::BIGINT AS total, count(*) FILTER (gap = 0) AS repeats, count(*) FILTER (gap > 1) AS gaps, min(step) AS first, max(step) AS last FROM (SELECT *, step - lag(step) OVER (PARTITION BY user_id ORDER BY step) AS gap FROM (SELECT user_id, event_id, event_id // 100 AS step FROM events)) GROUP BY user_id")
def reporting_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("event_id div 100").alias("step"))
    return S.reporting_summary(e, "user_id", "step", "event_id")


@query("source_counts", "SELECT source, count(*) AS rows, count(*) FILTER (n_chars > 2000) AS long_rows, round(avg((n_chars > 2000)::INT), 6) AS long_share FROM documents GROUP BY source ORDER BY rows DESC, source")
def source_counts(spark, sf_dir):
    big = F.col("n_chars") > 2000
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.count_if(big).alias("long_rows"), F.round(F.avg(big.cast("int")), 6).alias("long_share")).orderBy(F.desc("rows"), "source")


@query("json_metric_table", "SELECT event_type, k AS metric, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
def json_metric_table(spark, sf_dir):
    keys = F.explode(F.json_object_keys("props"))
    return table(spark, sf_dir, "events").select("event_type", keys.alias("metric")).groupBy("event_type", "metric").agg(F.count("*").alias("n"))
