"""Exact copies in DataFrame functions only: texts that are identical without their blanks.

Rows are combined in three steps, and each compares the texts themselves, never digests alone. Every task first merges
the equal texts that it reads (the partial aggregate before the shuffle). What is left meets by digest, salt and text; only
digests of more than an even share of the rows, which are at most as many as shuffle partitions, have more than one salt,
the number of the partition that a row was read in. At last the winners under different salts are combined. The texts
pass one shuffle, and a group of any size reaches each step as a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.native import BLANK
from curata.llm.components import EVEN, join_hot
from curata.runtime import discard, free_name, join_checked, materialize, shuffle_width

#: Salts of a hot digest.
SALTS = 64
#: Losing rows that are broadcast at most; more are joined by sort-merge.
LOSERS = 1_000_000


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _rows(docs: DataFrame, digest: Callable[[Column], Column], number: Column) -> DataFrame:
    """``rid, doc_id, content, digest, less, none``; the order ``less, none, doc_id`` puts the row that stays first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    content = F.regexp_replace(text, BLANK + "+", "")
    rows = docs.select(number.alias("rid"), "doc_id", content.alias("content"), (-F.length(text)).alias("less"), F.col("doc_id").isNull().alias("none"))
    return rows.withColumn("digest", digest(F.col("content")))


def _first(*more: str) -> Column:
    return F.min(F.struct("less", "none", "doc_id", *more)).alias("first")


def text_groups(rows: DataFrame, hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """``digest, first, n`` of each distinct text of ``rows(digest, content, less, none, doc_id)``; ``hot`` has digests, bounded.

    ``first`` is the order and id of the row that stays. A digest of different texts has one row for each of them.
    """
    marked = rows.join(F.broadcast(hot.select("digest", F.lit(True).alias("hot"))), "digest", "left")
    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(-1)
    merged = marked.withColumn("salt", salt).groupBy("digest", "salt", "content").agg(_first(), F.count("*").alias("n"))
    # winners without a salt are final and need their text no more
    kept = materialize(merged.withColumn("content", F.when(F.col("salt") >= 0, F.col("content"))), "salted-winners")
    final = kept.where("salt < 0").select("digest", "first", "n")
    combined = kept.where("salt >= 0").groupBy("digest", "content").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    out = final.unionByName(combined.select("digest", "first", "n"))
    out.curata_path = kept.curata_path
    return out


def _variants(docs: DataFrame, mixed: DataFrame, digest: Callable[[Column], Column], number: Column) -> DataFrame:
    """``rid, doc_id, less, none, digest, variant`` of the rows whose digest stands for different texts, told apart by their text."""
    rows = materialize(join_checked(_rows(docs, digest, number), mixed, ["digest"], "left_semi"), "mixed-rows")
    texts = rows.groupBy("digest", "content").agg(F.min("rid").alias("variant"), F.count("*").alias("n"))
    return join_hot(rows, texts, ["digest", "content"], rows.count()).drop("content")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS, rid: str | None = None) -> DataFrame:
    """``rid, doc_id, digest, keep_id, group_size, kept`` for each row of a table with ``doc_id`` and ``text``.

    Of equal texts the longest original stays, then the least ``doc_id``, then the first row. A null text counts as empty
    and equals any text of blanks; a null id comes last, and ``keep_id`` is null only where the whole group has none;
    repeated rows are copies of each other, one of which stays; an empty table gives an empty result; texts of any length
    are compared whole; other columns do no harm, whatever their names. ``rid`` names a column of distinct row numbers;
    without it the rows are numbered here. Any ``digest`` gives right groups: different texts that share one are told
    apart by their contents.
    """
    number = F.col(rid) if rid else F.monotonically_increasing_id()
    marks = _rows(docs, digest, number).select("rid", "doc_id", "less", "none", "digest", F.lit(None).cast(dict(docs.dtypes)[rid] if rid else "long").alias("variant"))
    marks = materialize(marks, "digests")
    count = marks.count()
    limit = max(EVEN, count // shuffle_width(docs.sparkSession))
    hot = marks.groupBy("digest").agg(F.count("*").alias("rows")).where(F.col("rows") > limit).select("digest")
    found = text_groups(_rows(docs, digest, F.lit(0)), hot, salts)
    groups = found.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count("*").alias("texts"))
    groups = materialize(groups, "digest-groups")
    discard(found)
    mixed = groups.where("texts > 1").select("digest")
    # the least row number among the first ones, which the texts' pass cannot carry: splits of a table may differ between two reads
    firsts = marks.groupBy("digest").agg(_first("rid"))
    winners = groups.where("texts = 1").join(firsts.select("digest", F.col("first.rid").alias("keeper")), "digest")
    out = _told(marks, winners.select("digest", F.col("first.doc_id").alias("keep_id"), "keeper", "n"), ["digest"], count)
    if not mixed.isEmpty():
        rows = materialize(_variants(docs, mixed, digest, number), "variants")
        texts = rows.groupBy("digest", "variant").agg(_first("rid"), F.count("*").alias("n"))
        texts = texts.select("digest", "variant", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keeper"), "n")
        out = out.unionByName(_told(rows, texts, ["digest", "variant"], rows.count()))
    return out


def _told(rows: DataFrame, winners: DataFrame, on: list[str], count: int) -> DataFrame:
    met = join_hot(rows, winners.withColumn("group_size", F.col("n")), on, count)
    return met.select("rid", "doc_id", "digest", "keep_id", "group_size", (F.col("rid") == F.col("keeper")).alias("kept"))


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay in :func:`exact_groups`, with all their columns, whatever their names.

    Nulls, repeated rows and empty tables are as there. The rows are numbered and written once, so that a number means the
    same row in every step.
    """
    mark = free_name(docs, "curata_rid")
    held = materialize(docs.withColumn(mark, F.monotonically_increasing_id()), "numbered")
    found = exact_groups(held, salts=salts, rid=mark)
    losers = materialize(found.where(~F.col("kept")).select(F.col("rid").alias(mark)), "losers")
    return join_checked(held, losers, [mark], "left_anti", LOSERS).select(*[F.col(f"`{c}`") for c in docs.columns])


def op13_copies(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = exact_groups(docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
), o AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY chars DESC, doc_id NULLS LAST, rid) AS place FROM d
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY content ORDER BY place) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size, place = 1 AS kept, sha256(content) AS text_sha256
FROM o
"""
