"""Rollout streams: steps of a fixed number of groups, zero-variance drops, exclusion of solved prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators.mixing import numbered


def complete_groups(rollouts: DataFrame, group: str, score: str, solved_at: float) -> DataFrame:
    """``group, first, rows, mean, varied, solved`` of each prompt's rollouts, by first arrival."""
    return rollouts.groupBy(group).agg(
        F.min("event_id").alias("first"), F.count("*").alias("rows"), F.round(F.avg(score), 6).alias("mean"),
        (F.max(score) > F.min(score)).alias("varied"), (F.avg(score) >= solved_at).alias("solved"),
    )


def steps_of(groups: DataFrame, per_step: int, refill: bool = True) -> DataFrame:
    """Groups dealt into steps of ``per_step`` by arrival. With ``refill`` a group without variance takes no slot, else it
    takes one and is dropped afterwards."""
    rows = groups.where("varied") if refill else groups
    dealt = numbered(rows, "first").withColumn("step", F.expr(f"index div {per_step}"))
    return dealt.where("varied").drop("index")


def without_truncated(rows: DataFrame, finish: str) -> DataFrame:
    """Rows that ended by themselves; taken after group figures, which count all rows."""
    return rows.where(F.col(finish) == "stop")


def rollout_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def running_groups(stream: DataFrame, group: str, score: str, wanted: int, solved_at: float, order: str) -> DataFrame:
    """Groups of a stream as they fill up: ``group, number, first, rows, mean, varied, solved`` for every ``wanted`` rollouts.

    The rollouts of a prompt are taken in ``order`` (an integer): however many come in one micro-batch, each full group is
    a row, and what is left over waits in the prompt's state for the next batch. So the groups do not depend on how a
    stream that arrives in order is cut into batches. ``number`` counts a prompt's groups from 0 and ``first`` is the
    least order in one. A null score takes a place in its group and no part in its mean; a group of nulls has a null
    mean, no variance and is not solved; rollouts with a null prompt are a prompt of their own.

    Once the mean of a group reaches ``solved_at`` the prompt is solved: later rollouts are ignored, in this batch too. The
    state of a prompt is its left-over scores, less than ``wanted``, and is empty but for a mark once it is solved. The
    rows with ``solved`` in the result are the lasting record of exclusions: :func:`unsolved` keeps such prompts from being
    sampled again, so a stream started on a new checkpoint need not carry the marks on.
    """
    kind, place = dict(stream.dtypes)[group], dict(stream.dtypes)[order]
    out = f"{group} {kind}, number long, first {place}, rows long, mean double, varied boolean, solved boolean"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, done, places, scores = state.get if state.exists else (0, False, [], [])
        new = [] if done else [f[[order, score]] for f in frames]
        if new:
            rows = pd.concat(new).sort_values(order, kind="stable")
            places = [*places, *rows[order].tolist()]
            scores = [*scores, *(None if pd.isna(x) else float(x) for x in rows[score])]
        full, at = [], 0
        while not done and len(scores) - at >= wanted:
            known = [x for x in scores[at : at + wanted] if x is not None]
            mean = reduce(add, known) / len(known) if known else None  # sum() compensates, and no SQL does: 480.0 is then 479.99...
            done = mean is not None and mean >= solved_at
            varied = bool(known) and max(known) > min(known)
            full.append((key[0], number, places[at], wanted, None if mean is None else round(mean, 6), varied, done))
            number, at = number + 1, at + wanted
        state.update((number, done, [] if done else places[at:], [] if done else scores[at:]))
        if full:
            yield pd.DataFrame(full, columns=[group, "number", "first", "rows", "mean", "varied", "solved"])

    held = f"number long, done boolean, places array<{place}>, scores array<double>"
    return stream.groupBy(group).applyInPandasWithState(update, out, held, "append", "NoTimeout")


def unsolved(prompts: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The prompts that no row of ``groups(key, solved)`` calls solved; nulls are never excluded."""
    return prompts.join(groups.where("solved").select(key).distinct(), key, "left_anti")


def budgeted_batches(stream: DataFrame, rank: str, order: str, length: str, per_batch: int, budget: int) -> DataFrame:
    """``rank, order, length, batch, place`` of each example of a stream: batches of bounded tokens that carry overflow on.

    Every rank takes ``per_batch`` new examples a batch, and what earlier ones left over before them. A batch is as many of
    these, in ``order``, as have ``budget`` tokens together, and one at least; the rest is the overflow of the next. When
    the examples end, further batches use up the overflow. An example's batch follows from those before it alone, so it
    is known when it arrives, and the state of a rank is four numbers however long its overflow is: how many examples
    came, the batch being filled, and its size and tokens. A null length counts as 0.
    """
    kinds = dict(stream.dtypes)
    out = f"{rank} {kinds[rank]}, {order} {kinds[order]}, {length} long, batch long, place long"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, batch, size, tokens = state.get if state.exists else (0, 0, 0, 0)
        rows = pd.concat([f[[order, length]] for f in frames]).sort_values(order, kind="stable")
        rows[length] = rows[length].fillna(0).astype("int64")
        batches, places = [], []
        for n in rows[length].tolist():
            if size and (tokens + n > budget or seen >= (batch + 1) * per_batch):
                batch, size, tokens = batch + 1, 0, 0
            batches.append(batch)
            places.append(size)
            seen, size, tokens = seen + 1, size + 1, tokens + n
        state.update((seen, batch, size, tokens))
        yield rows.assign(**{rank: key[0], "batch": batches, "place": places})[[rank, order, length, "batch", "place"]]

    return stream.groupBy(rank).applyInPandasWithState(update, out, "seen long, batch long, size long, tokens long", "append", "NoTimeout")


def run_available(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over what is there and stop; results as Parquet, or given to ``each`` batch by batch."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    query.awaitTermination()


def windowed_counts(stream: DataFrame, at: str, delay: str, width: str, by: str) -> DataFrame:
    """Counts in time windows with a watermark: an extension for event streams."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
