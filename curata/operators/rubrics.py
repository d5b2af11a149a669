"""A buffer of rubrics by question: active, inactive and persistent ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def initial_buffer(rows: DataFrame, query: str, order: str, rubrics: str) -> DataFrame:
    """``query, persistent, active, inactive``: the first row of each question counts."""
    first = rows.groupBy(query).agg(F.min(F.struct(order, rubrics)).alias("m"))
    none = F.slice(F.col(f"m.{rubrics}"), 1, 0)
    return first.select(query, F.col(f"m.{rubrics}").alias("persistent"), none.alias("active"), none.alias("inactive"))


def merged(buffer: DataFrame, proposed: DataFrame, query: str) -> DataFrame:
    """Add new rubrics ``query, positive, negative`` (arrays of texts) with weight 1 and -1, each text once."""
    add = F.concat(
        F.transform(F.coalesce("positive", F.expr("array()")), lambda t: F.struct(t.alias("text"), F.lit(1.0).alias("weight"))),
        F.transform(F.coalesce("negative", F.expr("array()")), lambda t: F.struct(t.alias("text"), F.lit(-1.0).alias("weight"))),
    )
    once = proposed.groupBy(query).agg(F.first("positive").alias("positive"), F.first("negative").alias("negative"))
    both = buffer.join(once, query, "left").withColumn("add", F.when(F.col("positive").isNotNull() | F.col("negative").isNotNull(), add))
    known = lambda t: F.exists(F.concat("persistent", "active", "inactive"), lambda r: r["text"] == t)
    fresh = F.filter("add", lambda r: ~known(r["text"]))
    return both.withColumn("active", F.when(F.col("add").isNotNull(), F.concat("active", fresh)).otherwise(F.col("active"))).drop("positive", "negative", "add")


def ground_truth(query: str) -> Column:
    """The label that a rubric verifier reads: the question with its persistent and active rubrics."""
    shown = F.transform(F.concat("persistent", "active"), lambda r: F.struct(r["text"].alias("description"), r["weight"].alias("weight")))
    return F.to_json(F.struct(F.col(query).alias("query"), shown.alias("rubrics")))


def pruned(scores: DataFrame, query: str, rubric: str, score: str, keep: int) -> DataFrame:
    """``query, rubric, std, active``: rubrics without variance are inactive, and beyond the ``keep`` most varied of a
    question so are the others."""
    spread = scores.groupBy(query, rubric).agg(F.round(F.stddev_pop(score), 6).alias("std"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("std"), rubric))
    return spread.withColumn("rank", rank).select(query, rubric, "std", ((F.col("std") > 0) & (F.col("rank") <= keep)).alias("active"))
