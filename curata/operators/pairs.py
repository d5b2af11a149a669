"""Preference pairs, votes and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, found by an aggregate, so that copies fold before the shuffle."""
    row = F.struct(*order, *(c for c in df.columns if c not in order and c not in key))
    best = df.groupBy(*key).agg(F.min(row).alias("r"))
    return best.select(*[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in df.columns])


def longest_per_key(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The row with the longest text of each key; of equal ones the first."""
    best = df.groupBy(key).agg(F.max(F.struct(F.length(text).alias("n"), (-F.col(order)).alias("o"))).alias("b"))
    return best.select(key, (-F.col("b.o")).alias(order), F.col("b.n").alias("length"))


def random_per_key(df: DataFrame, key: str, order: str, seed: str = "42") -> DataFrame:
    pick = df.groupBy(key).agg(F.min(F.struct(F.md5(F.concat(F.lit(seed + ":"), F.col(order).cast("string"))).alias("h"), F.col(order).alias("o"))).alias("b"))
    return pick.select(key, F.col("b.o").alias(order))


def latest(df: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key; of rows at the same time the one with the greater ``tie``."""
    best = df.groupBy(*key).agg(F.max(F.struct(at, tie)).alias("b"))
    return best.select(*key, F.col(f"b.{at}").alias(at), F.col(f"b.{tie}").alias(tie))


def best_and_worst(df: DataFrame, key: str, index: str, score: Column, min_score: float | None = None, margin: float = 0.0) -> DataFrame:
    """``key, chosen, rejected, best, worst``: first row among the best, last among the worst.

    Groups of one row, ties, a best score under ``min_score`` and differences under ``margin`` give no pair.
    """
    rows = df.select(key, F.col(index).alias("i"), score.alias("s"))
    ends = rows.groupBy(key).agg(
        F.max(F.struct("s", (-F.col("i")).alias("o"))).alias("top"), F.min(F.struct("s", (-F.col("i")).alias("o"))).alias("low"), F.count("*").alias("n")
    )
    ok = (F.col("n") > 1) & (F.col("top.s") > F.col("low.s")) & (F.col("top.s") - F.col("low.s") >= margin)
    if min_score is not None:
        ok = ok & (F.col("top.s") >= min_score)
    return ends.where(ok).select(key, (-F.col("top.o")).alias("chosen"), (-F.col("low.o")).alias("rejected"), F.round("top.s", 6).alias("best"), F.round("low.s", 6).alias("worst"))


def rejection_sampled(df: DataFrame, key: list[str], index: str, score: str) -> DataFrame:
    """First completion with the best and first with the worst score of each group."""
    top, low = F.struct(F.col(score).alias("s"), (-F.col(index)).alias("o")), F.struct(F.col(score).alias("s"), F.col(index).alias("o"))
    return df.groupBy(*key).agg(F.max(top).alias("t"), F.min(low).alias("l")).select(*key, (-F.col("t.o")).alias("chosen"), F.col("l.o").alias("rejected"))


def majority_vote(votes: DataFrame, key: str, voter: str, choice: str) -> DataFrame:
    """The choice with most votes; where all differ, the vote with the least hash. Other ties go to the lesser choice."""
    counts = votes.groupBy(key, choice).agg(F.count("*").alias("n"), F.min(F.md5(F.concat_ws(":", key, voter))).alias("h"))
    order = [F.desc("n"), F.when(F.col("most") == 1, F.col("h")), F.col(choice)]
    ranked = counts.withColumn("most", F.max("n").over(Window.partitionBy(key)))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("r = 1").select(key, F.col(choice).alias("choice"), F.col("n").alias("votes"))


def top_vs_rest(df: DataFrame, key: str, index: str, rank: str, top: int, seed: str = "42") -> DataFrame:
    """A hash-picked row among the ``top`` ranks as chosen, one among the others as rejected."""
    h = lambda s: F.md5(F.concat(F.lit(f"{seed}:{s}:"), F.col(index).cast("string")))
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(rank, index)))
    good = ranked.where(F.col("r") <= top).groupBy(key).agg(F.min(F.struct(h("c").alias("h"), F.col(index).alias("o"))).alias("c"))
    bad = ranked.where(F.col("r") > top).groupBy(key).agg(F.min(F.struct(h("r").alias("h"), F.col(index).alias("o"))).alias("d"))
    return good.join(bad, key).select(key, F.col("c.o").alias("chosen"), F.col("d.o").alias("rejected"))


def comparison_margin(score_a: Column, score_b: Column) -> Column:
    """``struct<chosen, margin>`` of a two-answer comparison; a tie has no choice."""
    return F.struct(F.when(score_a > score_b, F.lit(0)).when(score_b > score_a, F.lit(1)).alias("chosen"), F.abs(score_a - score_b).alias("margin"))


def aspects_pivoted(df: DataFrame, key: str, aspect: str, rating: str, aspects: list[str]) -> DataFrame:
    """One row for each key with a column of the first rating of each aspect; the aspects are known, so one pass does."""
    return df.groupBy(key).pivot(aspect, aspects).agg(F.first(rating))


def rated_pair(ratings: Column) -> Column:
    """Index (from 1) of the first best of ``array<double>`` mean ratings."""
    return F.array_position(ratings, F.array_max(ratings))


def strata_heads(df: DataFrame, key: str, strata: dict[str, Column]) -> DataFrame:
    """The first row of every stratum, with the tags of all strata that it heads."""
    tags = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in strata.items())))
    heads = df.select(key, F.explode(tags).alias("tag")).groupBy("tag").agg(F.min(key).alias(key))
    return heads.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))


def swapped_sides(df: DataFrame, key: str) -> DataFrame:
    """Which of two answers comes first, by the parity of a hash."""
    return df.withColumn("swap", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(2)) == 1)


def prompt_id(text: Column, key: Column) -> Column:
    return F.sha2(F.concat(text, key.cast("string")), 256)


def matched_depletion(df: DataFrame, arm: str, group: str, value: str, tolerance: float) -> DataFrame:
    """Relative difference between the greatest and least sum over arms for each group, and whether it is tolerable."""
    sums = df.groupBy(group, arm).agg(F.sum(value).alias("s")).groupBy(group).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("arms"))
    error = F.when(F.col("hi") == 0, F.lit(0.0)).otherwise((F.col("hi") - F.col("lo")) / F.col("hi"))
    return sums.select(group, "arms", F.round(error, 6).alias("error"), (error <= tolerance).alias("matched"))


def grouped_completions(df: DataFrame, key: str, index: str, columns: list[str], sample: int = 4, seed: str = "42") -> DataFrame:
    """``key`` with the lists of its rows' columns in order of ``index``, and ``sampled``: indices of ``sample`` rows.

    The sample is taken by a hash of the index. A key's rows are the completions of one prompt, few by their nature.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(index).cast("string")))
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), *columns, h.alias("h")))).alias("r"))
    picked = F.slice(F.transform(F.array_sort(F.transform("r", lambda x: F.struct(x["h"].alias("h"), x["i"].alias("i")))), lambda x: x["i"]), 1, sample)
    return rows.select(key, *(F.col(f"r.{c}").alias(c) for c in columns), F.sort_array(picked).alias("sampled"))


def annotated_scores(df: DataFrame, key: str, model: str, score: str, reference: str) -> DataFrame:
    """``key, scores, reference_score``: scores by model as a map, and that of the reference model."""
    rows = df.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(model, score)))).alias("scores"))
    return rows.withColumn("reference_score", F.try_element_at("scores", F.lit(reference)))


def of_models(df: DataFrame, model: str, include: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """Rows of the models of one list, without those of another; null models stay only without an include list."""
    if include is not None:
        df = df.where(F.col(model).isin(include))
    return df.where(~F.coalesce(F.col(model).isin(ignore), F.lit(False))) if ignore else df


def is_valid_response(text: Column, refusals: list[str]) -> Column:
    """Whether a response has text and none of the given phrases, without regard to case."""
    ok = F.coalesce(F.trim(text), F.lit("")) != ""
    for r in refusals:
        ok = ok & ~F.coalesce(F.contains(F.lower(text), F.lit(r.lower())), F.lit(False))
    return ok
