"""Statistics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mix_stats(df: DataFrame, source: str, tokens: str, kept: Column) -> DataFrame:
    """Rows before and after filtering and token totals of each source, with shares of the whole."""
    total = F.coalesce(F.sum(F.when(kept, F.col(tokens))), F.lit(0))
    out = df.groupBy(source).agg(
        F.count("*").alias("initial"), F.sum(kept.cast("int")).alias("final"), F.sum((~kept).cast("int")).alias("filtered"),
        total.alias("total"), F.round(F.avg(F.when(kept, F.col(tokens))), 4).alias("mean"),
    )
    return out.withColumn("percent", F.round(100.0 * F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1))), 4))


def described(df: DataFrame, values: list[str]) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and greatest of columns, a row for each."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values))).alias("r"))
    q = lambda p: F.round(F.percentile("r.x", p), 4)
    return rows.groupBy(F.col("r.name").alias("name")).agg(
        F.count("r.x").alias("count"), F.round(F.avg("r.x"), 4).alias("mean"), F.round(F.stddev_samp("r.x"), 4).alias("std"), F.min("r.x").alias("min"),
        q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max("r.x").alias("max"),
    )


def over_counts(df: DataFrame, value: str, limits: list[int]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(value) > x).alias(f"over_{x}") for x in limits))


def percentiles(df: DataFrame, value: str, points: list[int]) -> DataFrame:
    """Exact percentiles with linear interpolation, a row for each point.

    Equal values are one row with their count; ranks come from running sums over ranges of the values, and only the two
    values around each point are looked up. ``value`` is an integer column; nulls do not count.
    """
    from curata.sources.tables import running_total

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    placed = running_total(counts, "v", "n")
    n = df.agg(F.count(value)).first()[0]
    at = [(p, (n - 1) * p / 100) for p in points]
    wanted = F.array(*(F.struct(F.lit(p).alias("point"), F.lit(k).alias("k"), F.lit(float(x)).alias("x")) for p, x in at for k in sorted({int(x), min(int(x) + 1, max(n - 1, 0))})))
    rows = placed.select("v", "begin", "n", F.explode(wanted).alias("w")).where("w.k >= begin and w.k < begin + n")  # a few for each point
    share = F.when(F.col("w.k") == F.floor("w.x"), 1 - (F.col("w.x") - F.floor("w.x"))).otherwise(F.col("w.x") - F.floor("w.x"))
    return rows.groupBy(F.col("w.point").alias("point")).agg(F.round(F.sum(F.col("v") * share), 4).alias("value"))


def merged_metrics(df: DataFrame, name: str, order: str, number: str, array: str, text: str) -> DataFrame:
    """``name, mean, joined, last`` of metric records: numbers averaged, arrays joined in order, of anything else the last."""
    row = F.struct(order, array, text)
    out = df.groupBy(name).agg(F.round(F.avg(number), 6).alias("mean"), F.sort_array(F.collect_list(row)).alias("r"))
    last = F.try_element_at(F.filter("r", lambda x: x[text].isNotNull()), F.lit(-1))[text]
    return out.select(name, "mean", F.flatten(F.filter(F.transform("r", lambda x: x[array]), lambda a: a.isNotNull())).alias("joined"), last.alias("last"))


def benchmark_averages(df: DataFrame, metrics: list[str], weight: str) -> DataFrame:
    """Plain and weighted means of metrics over the runs of a benchmark, a row for each metric."""
    rows = df.select(weight, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))).alias("r")).select(weight, "r.*")
    return rows.groupBy("metric").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.sum(F.col("x") * F.col(weight)) / F.sum(weight), 4).alias("weighted"), F.count("x").alias("runs"))


def histogram(df: DataFrame, value: str, width: int, category: str | None = None, top: int = 5) -> DataFrame:
    """Counts in bins of equal width; categories beyond the ``top`` commonest are one, Other."""
    rows = df.withColumn("bin", F.expr(f"{value} div {width}"))
    if category is None:
        return rows.groupBy("bin").agg(F.count("*").alias("count"))
    sizes = df.groupBy(category).agg(F.count("*").alias("n")).orderBy(F.desc("n"), category).limit(top).select(category, F.lit(True).alias("big"))
    named = rows.join(F.broadcast(sizes), category, "left").withColumn("category", F.when(F.col("big"), F.col(category)).otherwise("Other"))
    return named.groupBy("bin", "category").agg(F.count("*").alias("count"))


def log_bins(df: DataFrame, value: str) -> DataFrame:
    bins = F.when(F.col(value) > 0, F.floor(F.log2(F.col(value).cast("double")))).otherwise(-1)
    return df.groupBy(bins.cast("long").alias("bin")).agg(F.count("*").alias("count"))


def agreement(records: DataFrame, item: str, label: Column, order: list[str]) -> DataFrame:
    """Acceptance rate over all labels and agreement of the first two labels of each item that has two."""
    rows = records.select(item, label.cast("int").alias("l"), F.struct(*order).alias("o"))
    n = F.row_number().over(Window.partitionBy(item).orderBy("o"))
    firsts = rows.withColumn("n", n).where("n <= 2").groupBy(item).agg(F.count("*").alias("c"), (F.min("l") == F.max("l")).cast("int").alias("same"))
    rate = rows.agg(F.round(F.avg("l"), 6).alias("acceptance_rate"), F.count("*").alias("labels"))
    return rate.join(firsts.where("c = 2").agg(F.round(F.avg("same"), 6).alias("agreement"), F.count("*").alias("items")))


def win_rates(df: DataFrame, model_a: str, model_b: str, preference: Column) -> DataFrame:
    """Clear and slight wins, ties and losses of each unordered pair of models; a preference above 0 is for the lesser name.

    2 and -2 are clear, 1 and -1 slight, 0 a tie that counts one half in the relaxed rate.
    """
    flip = F.col(model_a) > F.col(model_b)
    rows = df.select(F.least(model_a, model_b).alias("first"), F.greatest(model_a, model_b).alias("second"), F.when(flip, -preference).otherwise(preference).alias("p"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    p = F.col("p")
    relaxed = F.when(p > 0, 1.0).when(p == 0, 0.5).otherwise(0.0)
    return rows.where("first <> second").groupBy("first", "second").agg(
        F.count("*").alias("n"), share(p == 2).alias("clear_win"), share(p == 1).alias("slight_win"), share(p == 0).alias("tie"),
        share(p == -1).alias("slight_loss"), share(p == -2).alias("clear_loss"), F.round(F.avg(relaxed), 6).alias("relaxed"),
    )


def tool_metrics(df: DataFrame, tool: str, rollout: str, failed: Column, runtime: Column) -> DataFrame:
    """Calls per rollout, failure rate and mean runtime for each tool and over all (``tool`` null)."""
    rollouts = df.agg(F.count_distinct(rollout).alias("r"))
    sets = df.withColumns({"f": failed.cast("int"), "t": runtime}).groupingSets([(tool,), ()], tool).agg(
        F.count("*").alias("calls"), F.avg("f").alias("f"), F.avg("t").alias("t")
    )
    return sets.join(rollouts).select(tool, "calls", F.round(F.col("calls") / F.col("r"), 6).alias("calls_per_rollout"), F.round("f", 6).alias("failure_rate"), F.round("t", 4).alias("mean_runtime"))


def solve_rates(df: DataFrame, group: str, reward: str, top: float) -> DataFrame:
    """How many groups got no reward, all of it, or something between that varies."""
    g = df.groupBy(group).agg(F.min(reward).alias("lo"), F.max(reward).alias("hi"), F.stddev_pop(reward).alias("sd"))
    return g.agg(
        F.count("*").alias("groups"), F.count_if(F.col("hi") == 0).alias("zero"), F.count_if(F.col("lo") == top).alias("solved"),
        F.count_if(F.col("sd") > 0).alias("nonzero_std"), F.round(100.0 * F.avg((F.col("lo") == top).cast("int")), 4).alias("percent_solved"),
    )


def step_metrics(df: DataFrame, step: Column, length: str, solved: Column, stopped: Column) -> DataFrame:
    n = F.col(length)
    return df.groupBy(step.alias("step")).agg(
        F.round(F.avg(n), 4).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.round(F.avg(F.when(solved, n)), 4).alias("solved_length"),
        F.round(F.avg(F.when(~solved, n)), 4).alias("unsolved_length"), F.round(F.avg(stopped.cast("int")), 6).alias("stop_rate"),
    )


def by_type(df: DataFrame, kind: str, value: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))


def usage_cost(usage: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    """Token sums and cost by model; ``prices(model, input, output)`` is per million tokens and small."""
    sums = usage.groupBy(model).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    cost = (F.col("input_tokens") * F.col("input") + F.col("output_tokens") * F.col("output")) / 1e6
    return sums.join(prices, model, "left").select(model, "input_tokens", "output_tokens", F.round(F.coalesce(cost, F.lit(0.0)), 6).alias("cost"))


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of array entries whose mask is 1; 0 if none is."""
    sums = F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x.cast("double"))
    n = F.aggregate(mask, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(n > 0, sums / n).otherwise(F.lit(0.0))


def reconciled(docs: DataFrame, manifest: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """Rows of a manifest that differ from what is stored: every measure as stored and as stated."""
    stored = docs.groupBy(key).agg(*(c.alias(f"stored_{n}") for n, c in measures.items()))
    both = manifest.join(stored, key, "full")
    differs = F.lit(False)
    for n in measures:
        differs = differs | ~F.col(n).eqNullSafe(F.col(f"stored_{n}"))
    return both.where(differs)


def reporting_summary(df: DataFrame, run: str, step: str, count: str) -> DataFrame:
    """Contiguity and repeats of reporting steps, and sums, for each run."""
    gap = F.col(step) - F.lag(step).over(Window.partitionBy(run).orderBy(step))
    return df.withColumn("gap", gap).groupBy(run).agg(
        F.count("*").alias("records"), F.sum(count).alias("total"), F.count_if(F.col("gap") == 0).alias("repeats"), F.count_if(F.col("gap") > 1).alias("gaps"),
        F.min(step).alias("first"), F.max(step).alias("last"),
    )
