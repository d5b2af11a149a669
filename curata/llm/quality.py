"""Host-level quality rules in DataFrame functions only.

Each document is held against a few rules; the failures are counted by host, the hosts' failure rates are shrunk with a
beta prior that is fitted to all hosts by moments, and the verdict on a host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.native import BLANK, BLANKS, let, words
from curata.runtime import join_checked, materialize

#: A document with fewer words fails.
LEAST_WORDS = 50
#: A document with a larger share of words in repeated windows fails.
REPEAT_SHARE = 0.5
#: More symbols than this for each word fail a rule that counts against the host only.
SYMBOL_SHARE = 0.5
#: A larger share of repeated lines fails a rule that counts against the host only.
LINE_SHARE = 0.5
#: Hosts whose shrunk failure rate is above this are rejected.
HOST_RATE = 0.7


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """Words in windows of ``width`` words that occur twice or more in the text, the first occurrence included.

    Windows are compared by a 64-bit hash within one text. Texts without a repeated window, which are most, take one
    pass over the distinct hashes; the others sort (hash, position) and add up the union of the windows.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
                F.get(s, k + 1)["h"] == x["h"], F.lit(False)
            )
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def union(p: Column) -> Column:
            step = lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(width)), F.lit(width))
            return F.aggregate(F.transform(p, step), F.lit(0), lambda a, x: a + x)

        return let(let(pairs, positions), union)

    def of(w: Column) -> Column:
        n = F.size(w) - (width - 1)
        windows = F.transform(
            F.slice(w, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, width)))
        )
        return F.when(
            n > 1,
            let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))),
        ).otherwise(F.lit(0))

    return let(tokens, of)


def statistics(text: Column) -> dict[str, Column]:
    """The rule inputs of a text; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    tokens = words(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    both = let(tokens, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    return {
        "word_stats": both,
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
    }


def measured(docs: DataFrame, host: str = "source", carry: Column | None = None) -> DataFrame:
    """The carried column (by default ``doc_id``), ``host``, the statistics and the rule results of each document."""
    stats = statistics(F.col("text"))
    out = docs.select(
        (F.col("doc_id") if carry is None else carry).alias("carried"),
        F.coalesce(F.concat(F.lit("h:"), F.col(host).cast("string")), F.lit("none")).alias("host"),
        *(c.alias(k) for k, c in stats.items()),
    )
    out = out.select(
        "carried", "host", F.col("word_stats.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("word_stats.r").cast("long").alias("n_repeat_words"), "n_lines",
    )
    return out.withColumns({"base_failed": base_failed(), "failed": base_failed() | soft_failed()})


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > round(100 * REPEAT_SHARE) * F.col("n_words"))


def soft_failed() -> Column:
    return (F.col("n_symbols") > SYMBOL_SHARE * F.col("n_words")) | (F.col("n_dup_lines") > LINE_SHARE * F.col("n_lines"))


def host_rates(stats: DataFrame) -> DataFrame:
    """``host, docs, failures, host_rate`` of ``stats(host, failed)``: the rate shrunk towards that of all hosts.

    The prior is a beta distribution with the mean and variance of the hosts' rates. Without variance (one host, or all
    alike) every host gets the mean. Counts are summed before the shuffle, so a host of any size is a few rows.
    """
    hosts = stats.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures"))
    hosts = materialize(hosts, "hosts")
    rate = F.col("failures") / F.col("docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"))  # one row
    weight = F.when(F.col("var") > 0, F.greatest(F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1, F.lit(0.0)))
    shrunk = (F.col("failures") + weight * F.col("mean")) / (F.col("docs") + weight)
    joined = hosts.join(F.broadcast(prior))
    return joined.select("host", "docs", "failures", F.coalesce(F.round(shrunk, 9), F.col("mean")).alias("host_rate"))


def host_verdicts(stats: DataFrame) -> DataFrame:
    """``host, host_rate, host_ok`` of each host as a written table."""
    rates = host_rates(stats).select("host", "host_rate", (F.col("host_rate") <= HOST_RATE).alias("host_ok"))
    return materialize(rates, "host-verdicts")


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row for each document: its statistics, ``base_failed``, ``host_rate`` and ``kept``.

    A null text is empty and fails for its few words; a null host is a host of its own; repeated rows count and return
    as often as they are there; an empty table gives an empty result; other columns of ``docs`` do no harm.
    """
    stats = materialize(measured(docs, host).withColumnRenamed("carried", "doc_id"), "quality")
    return join_checked(stats, host_verdicts(stats), ["host"], "left").withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all columns as they are, whatever their names.

    Null texts and hosts, repeated rows and empty tables are as in :func:`judged`. Each row is written once, packed into
    one column beside its verdicts, so the costly statistics are computed once and no column can clash.
    """
    rows = materialize(measured(docs, host, F.struct("*")).select("carried", "host", "base_failed", "failed"), "quality-rows")
    bad = host_verdicts(rows).where(~F.col("host_ok")).select("host")
    return join_checked(rows.where(~F.col("base_failed")), bad, ["host"], "left_anti").select("carried.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate"
    )


SQL_TEMPLATE = r"""
WITH w AS (
  SELECT rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM (SELECT row_number() OVER () AS rid, * FROM documents)
), g AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3
), c AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, ws[p], ws[p + 1], ws[p + 2]) AS k FROM g
), r AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM c WHERE k >= 2) GROUP BY rid
), s AS (
  SELECT doc_id, coalesce(source, 'none') AS host, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines
  FROM w LEFT JOIN r USING (rid)
), f AS (
  SELECT *, n_words < {words} OR 100 * n_repeat_words > {repeat} * n_words AS base_failed,
         n_symbols > {symbols} * n_words OR n_dup_lines > {lines} * n_lines AS soft
  FROM s
), h AS (
  SELECT host, count(*) AS docs, sum((base_failed OR soft)::INT) AS failures FROM f GROUP BY host
), p AS (
  SELECT avg(failures / docs) AS mean, var_pop(failures / docs) AS var FROM h
), k AS (
  SELECT host, coalesce(round((failures + w * mean) / (docs + w), 9), mean) AS host_rate
  FROM (SELECT h.*, mean, CASE WHEN var > 0 THEN greatest(mean * (1 - mean) / var - 1, 0) END AS w FROM h, p)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_rate <= {rate} AS kept, host_rate
FROM f JOIN k USING (host)
"""
ORACLE_SQL = SQL_TEMPLATE.format(
    words=LEAST_WORDS, repeat=round(100 * REPEAT_SHARE), symbols=SYMBOL_SHARE, lines=LINE_SHARE, rate=HOST_RATE
)
