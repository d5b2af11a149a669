"""Readers and writers: table scans, conversation assembly, sinks with shards, manifests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.runtime import free_name, materialize, shuffle_width

#: The message list of a conversation.
MESSAGES = "array<struct<role:string,content:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, path: str | list[str], split: str = "train", schema: str | None = None, revision: str | None = None, order: str | None = None) -> DataFrame:
    """Scan by file extension: JSON lines (plain or compressed), Parquet, CSV and TSV, or a folder of Parquet files.

    Only the split ``train`` exists for files; ``train[:n]`` takes the first n rows along ``order``, or in the order of files
    and rows within them. A ``revision`` is a subfolder of the path, and comes back as a column.
    """
    name, _, cut = split.partition("[")
    if name != "train":
        raise ValueError(f"files have the split train only, not {name}")
    paths = [path] if isinstance(path, str) else list(path)
    if revision is not None:
        paths = [f"{p.rstrip('/')}/revision={revision}" for p in paths]
    bare = paths[0].removesuffix(".gz").removesuffix(".zst").removesuffix(".bz2")
    reader = spark.read.schema(schema) if schema else spark.read
    if bare.endswith((".jsonl", ".json")):
        out = reader.json(paths)
    elif bare.endswith((".csv", ".tsv")):
        out = reader.option("header", True).option("sep", "\t" if bare.endswith(".tsv") else ",").csv(paths)
    else:
        out = reader.parquet(*paths)
    if revision is not None:
        out = out.withColumn("revision", F.lit(revision))
    if cut:
        key = [F.col(order)] if order else [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
        out = out.orderBy(*key).limit(int(cut.strip(":]")))
    return out


def scan_with_stem(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """JSON lines files of a glob, each row with its file's stem in ``file_stem``: its name up to the first full stop.

    A file may be a folder of parts, as Spark writes it; the folder's name counts then.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    name, folder = F.col("_metadata.file_name"), F.regexp_extract("_metadata.file_path", r"([^/.]+)[^/]*/[^/]*$", 1)
    return reader.json(pattern).withColumn("file_stem", F.when(F.startswith(name, F.lit("part-")), folder).otherwise(F.regexp_extract(name, r"^([^.]+)", 1)))


def conversation_messages(turns: DataFrame) -> DataFrame:
    """``conv_id, messages``: the turns of each conversation in order."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.groupBy("conv_id").agg(ordered.alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


def write_sharded(df: DataFrame, path: str, index: str, size: int = 10_000, fmt: str = "json") -> None:
    """Shards of ``size`` rows each by the running number in ``index``."""
    df.withColumn("shard", F.floor(F.col(index) / size)).repartition("shard").write.partitionBy("shard").format(fmt).save(path)


def write_by_key(df: DataFrame, path: str, key: str, rows: int = 250, fmt: str = "json") -> None:
    """A folder for each value of ``key``, with files of at most ``rows`` rows."""
    df.write.option("maxRecordsPerFile", rows).partitionBy(key).format(fmt).save(path)


def write_single(df: DataFrame, path: str) -> None:
    """One JSON lines file at ``path`` itself, for tables that are small by their nature."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    df.coalesce(1).write.json(path + ".part")
    folder, target = jvm.org.apache.hadoop.fs.Path(path + ".part"), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    fs.rename(part, target)
    fs.delete(folder, True)


def write_report(df: DataFrame, path: str) -> None:
    """Tab-separated report with a header; reports are small by their nature."""
    df.coalesce(1).write.option("header", True).option("sep", "\t").csv(path)


def chunk_boundaries(docs: DataFrame, order: str, size: str, chunk: int) -> DataFrame:
    """Document pieces clipped at chunks of ``chunk`` tokens in one running sequence.

    ``chunk_id, doc_start, doc_end`` are offsets within the chunk. The running sum is over ranges of the order: sums of
    partitions first, then sums within them.
    """
    placed = running_total(docs, order, size).withColumn("finish", F.col("begin") + F.col(size))
    first, last = F.expr(f"begin div {chunk}"), F.expr(f"(greatest(finish, begin + 1) - 1) div {chunk}")
    pieces = placed.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    base = F.col("chunk_id") * chunk
    return pieces.select(
        order, "chunk_id", F.greatest(F.col("begin") - base, F.lit(0)).alias("doc_start"),
        F.least(F.col("finish") - base, F.lit(chunk)).alias("doc_end"),
    )


def running_total(df: DataFrame, order: str, size: str, group: list[str] | None = None) -> DataFrame:
    """``begin``: the sum of ``size`` over all rows before in ``order`` (of the group), without one task for the whole.

    Without a group the rows are dealt by ranges of the order. With one they are bucketed by the order column (an integer),
    and the buckets' totals, one row each, are summed in a window for each group. Rows without an order come first, and
    null is a group of its own: both are parts of a struct, which joins null with null. A column ``begin`` is replaced.
    """
    if not group:
        return ranged_total(df, [order], F.col(size), "begin")
    bucket, base = free_name(df, "curata_bucket"), free_name(df, "curata_base")
    df = df.withColumn(bucket, F.struct(*group, F.expr(f"{order} div 4096").alias("run")))
    totals = df.groupBy(bucket).agg(F.sum(size).alias("t"))
    before = Window.partitionBy(*[f"{bucket}.{k}" for k in group]).orderBy(f"{bucket}.run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(bucket, F.coalesce(F.sum("t").over(before), F.lit(0)).alias(base))
    own = Window.partitionBy(bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(totals, bucket).withColumn("begin", F.col(base) + F.coalesce(F.sum(size).over(own), F.lit(0))).drop(bucket, base)


def ranged_total(df: DataFrame, order: list[str], size: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``size`` over all rows before in ``order``; nulls come first.

    Rows are dealt by ranges of the order and written, each range sums its own, and only one row for each range, of which
    there are as many as shuffle partitions, is summed in one task. No other column of ``df`` changes.
    """
    part, base = free_name(df, "curata_part"), free_name(df, "curata_base")
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *order).withColumn(part, F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    sums = dealt.groupBy(part).agg(F.sum(size).alias("t"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(part, F.coalesce(F.sum("t").over(before), F.lit(0)).alias(base))
    own = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(bases), part).withColumn(name, F.col(base) + F.coalesce(F.sum(size).over(own), F.lit(0)))
    return out.drop(part, base)


def part_manifest(df: DataFrame, part: Column, key: str, content: str) -> DataFrame:
    """A digest for each part: of the digests of its rows in key order, and counts."""
    rows = df.select(part.alias("part"), F.col(key).alias("k"), F.sha2(F.col(content), 256).alias("d"), F.octet_length(content).alias("b"))
    parts = rows.groupBy("part").agg(F.count("*").alias("docs"), F.sum("b").alias("bytes"), F.sort_array(F.collect_list(F.struct("k", "d"))).alias("l"))
    return parts.select("part", "docs", F.col("bytes").cast("long").alias("bytes"), F.sha2(F.array_join("l.d", ""), 256).alias("digest"))


def split_digests(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """Whole and shard digests of binary files, to check a transfer: one row for each shard of each file."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    whole = files.withColumn("file_sha256", F.sha2("content", 256))
    cuts = F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"(length - 1) div {shard}"), F.lit(0))))
    rows = whole.withColumn("shard", cuts)
    return rows.select("path", "length", "file_sha256", "shard", F.sha2(F.substring("content", F.col("shard") * shard + 1, F.lit(shard)), 256).alias("shard_sha256"))
