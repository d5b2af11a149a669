"""Connected components of a link table as alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.runtime import discard, materialize, shuffle_width

#: Rows of one key that a task may always read; beyond it a key is hot once it holds more than a task's even share.
EVEN = 100


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Inner join with ``right``, which has each key once and in ``n`` how many of the ``rows`` rows of ``left`` have it.

    A key with more than an even share of the rows is hot. There are at most as many hot keys as shuffle partitions, so
    they are broadcast and their rows stay where they are; all others meet by sort-merge. ``n`` is not in the result, null
    keys meet nothing, and ``rows`` may be too high, which only makes fewer keys hot.
    """
    limit = max(EVEN, rows // shuffle_width(left.sparkSession))
    hot, even = right.where(F.col("n") > limit).drop("n"), right.where(F.col("n") <= limit).drop("n")
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return left.join(F.broadcast(hot), on).unionByName(rest.join(even.hint("merge"), on))


def connected_components(links: DataFrame) -> DataFrame:
    """Root of each node of ``links(u, v)``: columns ``node`` and ``root``, the least node of its component.

    Nodes without a link are absent; self links and repeated links do not matter; an empty table gives an empty one.
    Each round is two tables in the shared folder, and the driver sees two numbers of it. Nulls never link. The rows of a
    hub are not brought together.
    """
    edges = materialize(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both, least, ["u"], 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, least, ["u"], 2 * before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _signature(after)
        discard(edges)
        discard(large)
        edges = after
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
