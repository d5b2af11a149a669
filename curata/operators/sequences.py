"""Token sequences: masking, advantages, running sums, packing and collation.

The tokenizer is an expression (by default words hashed to ids), so masking and truncation are exact whatever the ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.native import let, words
from curata.sources.tables import ranged_total, running_total

MASKED = -100
NO_IDS = "cast(array() as array<int>)"


def hashed_ids(text: Column) -> Column:
    """One id below 32000 for each word, from a checksum."""
    return F.transform(words(text), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(32000)).cast("int"))


def prompt_masked(prompt_ids: Column, answer_ids: Column) -> Column:
    """``struct<input_ids, labels>`` with the prompt's labels masked."""
    return F.struct(F.concat(prompt_ids, answer_ids).alias("input_ids"), F.concat(F.transform(prompt_ids, lambda x: F.lit(MASKED)), answer_ids).alias("labels"))


def turn_labels(messages: Column, tokenize: Callable[[Column], Column] = hashed_ids, longest: int | None = None, last_only: bool = False) -> Column:
    """``struct<input_ids, labels>`` of a message list: only answers, or only the last one, keep labels; cut at the right."""
    n = F.size(messages)

    def build(ids: Column) -> Column:
        keep = lambda i: (F.get(messages, i)["role"] == "assistant") & ((i == n - 1) if last_only else F.lit(True))
        labels = F.flatten(F.transform(ids, lambda t, i: F.when(keep(i), t).otherwise(F.transform(t, lambda x: F.lit(MASKED)))))
        cut = (lambda a: F.slice(a, 1, longest)) if longest else (lambda a: a)
        return F.struct(cut(F.flatten(ids)).alias("input_ids"), cut(labels).alias("labels"))

    return let(F.transform(messages, lambda m: tokenize(F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"]))), build)


def mask_spans(mask: Column) -> Column:
    """``array<struct<start, stop>>`` of the runs of true in a boolean array."""

    def build(m: Column) -> Column:
        on = lambda i: F.coalesce(F.get(m, i), F.lit(False))
        index = F.sequence(F.lit(0), F.size(m))
        starts = F.filter(index, lambda i: on(i) & ~on(i - 1))
        stops = F.filter(index, lambda i: ~on(i) & on(i - 1))
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))

    return let(mask, build)


def token_features(pair: Column, longest: int) -> Column:
    """Totals before and after the cut at ``longest``, trainable tokens, and the first and last trainable place."""
    labels = pair["labels"]
    cut = F.slice(labels, 1, longest)
    trainable = lambda a: F.size(F.filter(a, lambda x: x != MASKED))
    places = F.filter(F.transform(cut, lambda x, i: F.when(x != MASKED, i)), lambda i: i.isNotNull())
    return F.struct(
        F.size(labels).alias("tokens"), F.size(cut).alias("kept"), trainable(labels).alias("trainable"), trainable(cut).alias("kept_trainable"),
        F.coalesce(F.array_min(places), F.lit(-1)).alias("first"), F.coalesce(F.array_max(places), F.lit(-1)).alias("last"), (F.size(labels) > longest).alias("truncated"),
    )


def fitted_messages(messages: Column, tokens: Callable[[Column], Column], budget: int) -> Column:
    """Messages that fit a context: all system messages, then the others in order; the first that does not fit is cut to
    a prefix by words and ends the list. A message costs 3 tokens more, a system message 4, and system tokens count twice."""
    system = F.filter(messages, lambda m: m["role"] == "system")
    others = F.filter(messages, lambda m: m["role"] != "system")
    spent = F.aggregate(system, F.lit(0), lambda a, m: a + 2 * tokens(m["content"]) + 4)

    start = F.struct(spent.alias("used"), F.lit(False).alias("full"), F.slice(messages, 1, 0).alias("kept"))

    def step(a: Column, m: Column) -> Column:
        cost = tokens(m["content"]) + 3
        room = budget - a["used"] - 3
        prefix = F.array_join(F.slice(F.split(m["content"], " "), 1, F.greatest(room, F.lit(0))), " ")
        cut = F.struct(m["role"].alias("role"), prefix.alias("content"))
        return (
            F.when(a["full"], a)
            .when(a["used"] + cost <= budget, F.struct((a["used"] + cost).alias("used"), F.lit(False).alias("full"), F.array_append(a["kept"], m).alias("kept")))
            .otherwise(F.struct(a["used"].alias("used"), F.lit(True).alias("full"), F.when(room > 0, F.array_append(a["kept"], cut)).otherwise(a["kept"]).alias("kept")))
        )

    return F.concat(system, F.aggregate(others, start, step, lambda a: a["kept"]))


# advantages and running sums

def group_advantages(df: DataFrame, group: str, score: str, centered: bool = False) -> DataFrame:
    """Score minus the group's mean, over the population deviation unless ``centered``. Group sums are joined back."""
    sums = df.groupBy(group).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    value = F.col(score) - F.col("mean")
    return df.join(sums, group).withColumn("advantage", value if centered else value / (F.col("std") + 1e-8))


def varied_groups(df: DataFrame, group: str, score: str) -> DataFrame:
    """Rows of the groups whose scores differ."""
    varied = df.groupBy(group).agg(F.min(score).alias("lo"), F.max(score).alias("hi")).where("lo < hi").select(group)
    return df.join(varied, group, "left_semi")


def gae(values: Column, rewards: Column, gamma: float, lam: float, dones: Column | None = None, mask: Column | None = None) -> Column:
    """Generalised advantage estimates of one sequence, or of a packed one with ends and response masks; a backward fold."""
    n = F.size(values)
    go = lambda i: F.lit(1.0) if dones is None else (1 - F.least(F.get(dones, i), F.lit(1))) * F.least(F.get(mask, i), F.lit(1))

    def step(a: Column, i: Column) -> Column:
        following = F.coalesce(F.get(values, i + 1), F.lit(0.0))
        last = F.coalesce(F.get(a, F.lit(0)), F.lit(0.0))
        now = F.get(rewards, i) + gamma * following * go(i) - F.get(values, i) + gamma * lam * last * go(i)
        return F.array_prepend(a, now)

    return F.when(n > 0, F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), F.expr("cast(array() as array<double>)"), step)).otherwise(F.expr("cast(array() as array<double>)"))


def position_ids(lengths: Column) -> Column:
    """Positions that start anew in each sequence of a pack."""
    return F.flatten(F.transform(lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.expr(NO_IDS))))


def first_true(flags: Column) -> Column:
    """Index of the first true, the size without one."""
    at = F.array_position(flags, F.lit(True))
    return F.when(at > 0, at - 1).otherwise(F.size(flags)).cast("int")


def cumulative_lengths(df: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """Start and end offsets of the rows of each group along an integer order."""
    placed = running_total(df, order, length, group=[group])
    return placed.withColumnRenamed("begin", "start").withColumn("stop", F.col("start") + F.col(length))


def budget_prefix(df: DataFrame, group: str, order: str, length: str, budget: int) -> DataFrame:
    """The first rows of each group within the budget, one at least."""
    placed = cumulative_lengths(df, group, order, length)
    return placed.where((F.col("stop") <= budget) | (F.col("start") == 0))


# packing

def pack_accounting(packed: DataFrame, group: list[str], order: str, length: str, size: int) -> DataFrame:
    """Tokens, padding, targets (the first token of a document is none), squares and a digest of each pack."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x.cast("string")), ",")
    return packed.groupBy(*group, "pack").agg(
        F.count("*").alias("docs"), F.sum(length).alias("tokens"), (size - F.sum(length)).alias("padding"), F.sum(F.col(length) - 1).alias("targets"),
        F.sum(F.col(length) * F.col(length)).alias("squares"), F.sha2(ids, 256).alias("uid"),
    )


def priority(seed: int, uid: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), uid.cast("string")), 256)


def schedule(packs: DataFrame, uid: str, group_size: int, seed: int = 42) -> DataFrame:
    """Packs in priority order in groups; the last group is filled up with padding rows without a uid."""
    from curata.operators.mixing import ranked_by_hash

    rows = ranked_by_hash(packs.withColumn("whole", F.lit(0)), ["whole"], uid, seed).drop("whole")
    n = rows.count()
    pad = -n % group_size
    rows = rows.select(F.col(uid).alias("uid"), F.col("place"))
    padding = packs.sparkSession.range(pad).select(F.lit(None).cast(packs.schema[uid].dataType).alias("uid"), (F.col("id") + n).alias("place"))
    return rows.unionByName(padding).withColumn("step", F.expr(f"place div {group_size}")).withColumn("slot", F.col("place") % group_size).drop("place")


def collated(df: DataFrame, group: str, order: str, ids: str, labels: str) -> DataFrame:
    """Padding-free batch of each group: ids, labels with every sequence's first masked, positions, sequence numbers."""
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, ids, labels))).alias("r"))
    lens = F.transform("r", lambda x: F.size(x[ids]))
    first = lambda a: F.when(F.size(a) > 0, F.concat(F.array(F.lit(MASKED)), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))))).otherwise(a)
    return rows.select(
        group, F.flatten(F.transform("r", lambda x: x[ids])).alias("input_ids"), F.flatten(F.transform("r", lambda x: first(x[labels]))).alias("labels"),
        position_ids(lens).alias("position_ids"), F.flatten(F.transform("r", lambda x, i: F.array_repeat(i, F.size(x[ids])))).alias("seq_idx"),
    )


def padded(array: Column, size: int, pad: int) -> Column:
    """An array filled up or cut to ``size``."""
    return F.concat(F.slice(array, 1, size), F.array_repeat(F.lit(pad), F.greatest(F.lit(size) - F.size(array), F.lit(0))))


def unpacked(flat: Column, lengths: Column) -> Column:
    """A concatenated array back into its sequences."""
    starts = F.transform(F.sequence(F.lit(1), F.size(lengths)), lambda k: F.aggregate(F.slice(lengths, 1, k - 1), F.lit(0), lambda a, n: a + n))
    return F.zip_with(starts, lengths, lambda s, n: F.slice(flat, s + 1, n))


def worker_shares(df: DataFrame, order: str, workers: int) -> DataFrame:
    """Equal runs of packs for workers; the remainder is cut off."""
    placed = ranged_total(df, [order], F.lit(1), "place")
    each = df.count() // workers
    return placed.where(F.col("place") < each * workers).withColumn("worker", F.expr(f"place div {max(each, 1)}"))
