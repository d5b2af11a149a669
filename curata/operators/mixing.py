"""Mixing of sources: samples, quotas, set operations, epochs.

"Random" always means ordered by a hash of a seed and the row's id, so a mix is the same on every run and cluster.
Quotas within a source use the hash order over the source; it is dealt into buckets by the first digits of the hash, and
buckets that start beyond the quota are dropped by their counts, so about as many rows are ranked as are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.runtime import free_name
from curata.sources.tables import ranged_total


#: Hexadecimal digits of the hash that deal a group's rows into buckets: 65,536 buckets of a group at most.
DEAL = 4


def shuffled_key(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def mixer_amounts(pairs: list[str], counts: dict[str, int], mode: str = "dot") -> dict[str, int]:
    """Rows to take of each source from an alternating list of names and amounts.

    ``dot``: an amount with a full stop is a share, any other a count, so ``1`` is one row. ``share``: amounts are shares
    up to 1 and counts above, but the two cannot be mixed. ``split``: the same, and they can.
    """
    if len(pairs) % 2:
        raise ValueError("names and amounts must alternate")
    amounts = dict(zip(pairs[::2], pairs[1::2], strict=True))
    if any(float(a) < 0 for a in amounts.values()):
        raise ValueError("amounts cannot be negative")
    if mode == "dot":
        return {n: int(float(a) * counts[n]) if "." in a else int(a) for n, a in amounts.items()}
    values = {n: float(a) for n, a in amounts.items()}
    if mode == "share" and any(v > 1 for v in values.values()) and any(v < 1 for v in values.values()):
        raise ValueError("shares and counts cannot be mixed")
    return {n: int(v) if v > 1 else int(v * counts[n]) for n, v in values.items()}


def first_by_hash(df: DataFrame, group: list[str], quota: Column | int, key: str, seed: int | str = 42) -> DataFrame:
    """The first ``quota`` rows of each group in hash order; buckets of the hash beyond the quota are dropped before ranking."""
    return _ranked(df, group, key, seed, quota).where(F.col("place") < quota)


def ranked_by_hash(df: DataFrame, group: list[str], key: str, seed: int | str = 42) -> DataFrame:
    """``df`` with ``place``, the row's number from 0 in the hash order of its group; nulls are a group of their own."""
    return _ranked(df, group, key, seed, None)


def _ranked(df: DataFrame, group: list[str], key: str, seed: int | str, quota: Column | int | None) -> DataFrame:
    """Ranks within buckets of the hash's first ``DEAL`` digits, and sums of the buckets' counts: no window holds a group.

    A struct of the group's columns joins null with null, and the window keeps the partitioning of the join. Of the columns
    of ``df`` only one named ``place`` is replaced.
    """
    hashed = shuffled_key(seed, F.col(key))
    order, deal, earlier = (free_name(df, f"curata_{n}") for n in ("order", "deal", "earlier"))
    digits = F.substring(hashed, 1, DEAL).alias("curata_digits")
    dealt = df.withColumns({order: hashed, deal: F.struct(*group, digits)})
    counts = dealt.groupBy(deal).agg(F.count("*").alias("n"))
    in_group = Window.partitionBy(*[f"{deal}.{g}" for g in group]).orderBy(f"{deal}.curata_digits")
    before = F.sum("n").over(in_group.rowsBetween(Window.unboundedPreceding, -1))
    rows = dealt.join(counts.select(deal, F.coalesce(before, F.lit(0)).alias(earlier)), deal)
    if quota is not None:
        rows = rows.where(F.col(earlier) < quota)
    own = F.row_number().over(Window.partitionBy(deal).orderBy(order, key))
    return rows.withColumn("place", F.col(earlier) + own - 1).drop(deal, earlier, order)


def resampled(df: DataFrame, group: str, targets: DataFrame, key: str, seed: int | str = 42) -> DataFrame:
    """Each source brought to its target: whole repeats, then a part without replacement, ``copy`` numbers the repeats.

    ``targets(group, target)``. Columns ``is_upsampled`` and ``factor`` tell of the change.
    """
    mark = free_name(df, "curata_plan")
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    plan = targets.join(sizes, group).select(
        group, F.struct(F.col("target").alias("target"), F.col("n").alias("size"), F.expr("target div n").alias("whole"), F.expr("target % n").alias("rest")).alias(mark)
    )
    kept = free_name(df, "curata_place")
    held = df.withColumnRenamed("place", kept) if "place" in df.columns else df  # the rank has its name
    rows = ranked_by_hash(held, [group], key, seed).join(plan, group)
    copies = F.col(f"{mark}.whole") + (F.col("place") < F.col(f"{mark}.rest")).cast("int")
    out = rows.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)))
    target, size = F.col(f"{mark}.target"), F.col(f"{mark}.size")
    out = out.withColumns({"is_upsampled": target > size, "factor": F.round(target / size, 6)}).drop("place", mark)
    return out.withColumnRenamed(kept, "place") if "place" in df.columns else out


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with a gapless ``index`` from 0 in the order of a column; a column of that name is replaced."""
    return ranged_total(df, [order], F.lit(1), "index")


def stratified(df: DataFrame, stratum: str, portions: dict[str, float], total: int, key: str, seed: int | str = 42) -> DataFrame:
    """``total`` rows split over strata by portions that add up to 1."""
    if abs(sum(portions.values()) - 1) > 1e-9:
        raise ValueError("portions must add up to 1")
    quota = F.lit(0)
    for name, share in portions.items():
        quota = F.when(F.col(stratum) == name, F.lit(int(total * share))).otherwise(quota)
    return first_by_hash(df.where(F.col(stratum).isin(*portions)), [stratum], quota, key, seed).drop("place")


def n_per_group(df: DataFrame, group: str, n: int, key: str, seed: int | str = 42) -> DataFrame:
    """``n`` rows of each group that has at least ``n``."""
    big = df.groupBy(group).agg(F.count("*").alias("c")).where(F.col("c") >= n).select(group)
    return first_by_hash(df.join(big, group, "left_semi"), [group], n, key, seed).drop("place")


def common_ids(df: DataFrame, by: str, key: str) -> DataFrame:
    """Ids that every value of ``by`` has."""
    pairs = df.select(by, key).distinct()
    wanted = pairs.select(by).distinct().count()
    return pairs.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") == wanted).select(key)


def subset_updated(df: DataFrame, remove: list[str], add: dict[str, DataFrame], source: str = "source", drop: list[str] | None = None) -> DataFrame:
    """Rows of some sources out, other tables in under their own names, columns dropped."""
    out = df.where(~F.coalesce(F.col(source).isin(*remove), F.lit(False))) if remove else df
    for name, other in add.items():
        out = out.unionByName(other.withColumn(source, F.lit(name)), allowMissingColumns=True)
    return out.drop(*(drop or []))


def repeated_each(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def epoch_shard(df: DataFrame, key: str, epoch: int, batch: int, world: int, rank: int, excluded: DataFrame | None = None, seed: int = 42, drop_last: bool = True) -> DataFrame:
    """One rank's rows of an epoch: excluded ids out, reshuffled, whole batches, every ``world``-th row of each batch.

    Without ``drop_last`` the last batch is filled up with the first rows of the epoch.
    """
    rows = df.join(excluded.select(key).distinct(), key, "left_anti") if excluded is not None else df
    rows = ranked_by_hash(rows.withColumn("whole", F.lit(0)), ["whole"], key, seed + epoch).drop("whole")
    n = rows.count()
    if drop_last:
        rows = rows.where(F.col("place") < n // batch * batch)
    elif n % batch:
        rows = rows.unionByName(rows.where(F.col("place") < batch - n % batch).withColumn("place", F.col("place") + n))
    mine = F.pmod(F.pmod("place", F.lit(batch)), F.lit(world)) == rank
    return rows.where(mine).withColumn("batch", F.expr(f"place div {batch}"))


def thinking_budget(df: DataFrame, key: str, prompt: str, low: int, high: int) -> DataFrame:
    """A budget for each row by its hash, appended to the prompt."""
    k = F.lit(low) + F.pmod(F.conv(F.substring(shuffled_key("budget", F.col(key)), 1, 8), 16, 10).cast("long"), F.lit(high - low + 1))
    return df.withColumn("budget", k).withColumn("prompt", F.concat(F.col(prompt), F.lit("\n\nThink for "), k.cast("string"), F.lit(" tokens.")))


def filled_placeholders(df: DataFrame, column: str, values: dict[str, str], tags: str | None = None, banned: list[str] | None = None) -> DataFrame:
    """``{{NAME}}`` replaced by its value; rows with a banned tag dropped."""
    text = F.col(column)
    for name, value in values.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), F.lit(value))
    if tags and banned:
        df = df.where(~F.arrays_overlap(F.col(tags), F.array(*map(F.lit, banned))))
    return df.withColumn(column, text)


def environment_rows(spark: SparkSession, n: int, target: int) -> DataFrame:
    """Synthetic rows of a counting game: prompt, goal and tool names."""
    goal = F.col("id") % target + 1
    return spark.range(n).select("id", F.concat(F.lit("Count to "), goal.cast("string"), F.lit(".")).alias("prompt"), goal.alias("goal"), F.array(F.lit("increment")).alias("tools"))
