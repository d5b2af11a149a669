"""A positional inverted index of documents as Parquet tables that grow by segments, and phrases found by their positions.

A segment holds, for each token and document, the places of the token there, dealt by the token's hash into buckets that are
folders, and a dictionary of how many documents have each token. Adding documents writes a segment for those with a larger
id than the last one indexed; a segment counts once its line in the manifest is written, which is last, so an
interrupted run is simply run again. A phrase is looked up by its rarest token; only in documents that have it are the
places of its other tokens compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.functions.text import analyzed
from curata.runtime import arrow_rows, join_checked, materialize

#: Folders of a segment, and files of each, over which a frequent token is spread; more for more documents in a segment.
BUCKETS, SPREAD = 32, 2
#: Words of the documents whose places a task holds at once, and one document.
BATCH_WORDS = 100_000


def _bucket(token: str = "token"):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int").alias("bucket")


def _manifest(spark: SparkSession, path: str) -> list:
    """``segment, last_id`` of all segments that count, in order."""
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/segment=*/_SUCCESS")):
        return []
    whole = [f.getPath().getParent().toString() for f in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/segment=*/_SUCCESS"))]
    return spark.read.schema("segment int, last_id long, docs long").parquet(*whole).orderBy("segment").collect()  # a row for each segment


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, doc_id, places`` of each document: its words are all in one row, so no shuffle brings them together."""
    for batch in batches:
        tokens, ids, lists, held = [], [], [], 0
        for doc, words in zip(batch.column("doc_id").to_pylist(), batch.column("t"), strict=True):
            places: dict[str, list[int]] = {}
            for at, word in enumerate(words.as_py()):
                places.setdefault(word, []).append(at)
            tokens += places
            lists += places.values()
            ids += [doc] * len(places)
            held += len(words)
            if held >= BATCH_WORDS:
                yield _posting_rows(tokens, ids, lists)
                tokens, ids, lists, held = [], [], [], 0
        if ids:
            yield _posting_rows(tokens, ids, lists)


def _posting_rows(tokens: list, ids: list, lists: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["token", "doc_id", "places"])


def extend(docs: DataFrame, path: str) -> int:
    """Index the documents of ``docs(doc_id, text)`` that have a larger id than any indexed before; how many they were.

    Null ids are not indexed; null and empty texts have no tokens, but count as indexed. Documents with the same id must
    come in one call, and their tokens are as if each were a document.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    done = _manifest(spark, path)
    new = docs.where(F.col("doc_id").isNotNull() & (F.col("doc_id") > done[-1].last_id if done else F.lit(True)))
    count, last = new.agg(F.count("*"), F.max("doc_id")).first()
    if not count:
        return 0
    number = done[-1].segment + 1 if done else 0
    held = new.select(F.col("doc_id").cast("long").alias("doc_id"), analyzed(F.coalesce("text", F.lit(""))).alias("t")).mapInArrow(_places, "token string, doc_id long, places array<int>")
    folder = f"{path}/postings/segment={number}"
    held.select("*", _bucket()).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "token", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    written = spark.read.schema("token string, doc_id long, places array<int>, bucket int").parquet(folder)
    sizes = written.groupBy("token").agg(F.count("*").alias("docs"))
    sizes.write.mode("overwrite").parquet(f"{path}/dictionary/segment={number}")
    line = spark.createDataFrame([(number, last, count)], "segment int, last_id long, docs long")
    line.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/segment={number}")
    return count


def _read(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table over the segments that count."""
    folders = [f"{path}/{table}/segment={r.segment}" for r in _manifest(spark, path)]
    return spark.read.schema(schema).option("basePath", f"{path}/{table}").parquet(*folders) if folders else spark.createDataFrame([], schema)


def postings(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "postings", "token string, doc_id long, places array<int>, bucket int").drop("segment")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``token, docs`` over all segments."""
    return _read(spark, path, "dictionary", "token string, docs long").groupBy("token").agg(F.sum("docs").alias("docs"))


def phrase_matches(path: str, items: DataFrame) -> DataFrame:
    """``item_id, doc_id`` of the indexed documents in which each text of an item stands as a run of tokens.

    ``items(item_id, text)``, with ``field`` if an item has several texts. A text without tokens is nowhere, and so is its
    item. Token and document are the key of the second lookup, so a frequent token costs as much as a rare one.
    """
    spark = items.sparkSession
    field = F.col("field") if "field" in items.columns else F.lit(0)
    texts = items.select("item_id", field.alias("field"), analyzed(F.coalesce("text", F.lit(""))).alias("t")).distinct()
    texts = materialize(texts.withColumn("phrase", F.monotonically_increasing_id()).withColumn("size", F.size("t")), "item-texts")
    tokens = texts.select("phrase", "size", F.posexplode("t").alias("at", "token"))
    sized = tokens.join(dictionary(spark, path), "token", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    sized = materialize(sized, "item-tokens")
    rarest = sized.withColumn("r", F.row_number().over(Window.partitionBy("phrase").orderBy("docs", "at"))).where("r = 1 and docs > 0")
    index = postings(spark, path)
    first = join_checked(index, materialize(rarest.select(_bucket(), "token", "phrase", "at", "size"), "rarest-tokens"), ["bucket", "token"], "inner")
    starts = first.select("phrase", "doc_id", "size", F.col("at").alias("known"), F.explode("places").alias("place")).withColumn("start", F.col("place") - F.col("known"))
    starts = materialize(starts.where("start >= 0").select("phrase", "doc_id", "size", "known", "start"), "phrase-starts")
    wanted = materialize(tokens.select(_bucket(), "token").distinct(), "wanted-tokens")
    near = join_checked(index, wanted, ["bucket", "token"], "left_semi").select("token", "doc_id", "places")
    rest = starts.join(tokens.select("phrase", "at", "token"), "phrase").where(F.col("at") != F.col("known"))
    agree = rest.join(near, ["token", "doc_id"]).where(F.array_contains("places", F.col("start") + F.col("at")))
    whole = agree.select("phrase", "doc_id", "size", "start", "at").distinct().groupBy("phrase", "doc_id", "size", "start").agg(F.count("*").alias("n"))
    found = whole.where("n = size - 1").select("phrase", "doc_id").unionByName(starts.where("size = 1").select("phrase", "doc_id")).distinct()
    counts = found.join(texts.select("phrase", "item_id"), "phrase").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))
    fields = texts.groupBy("item_id").agg(F.count("*").alias("wanted"))
    return counts.join(fields, "item_id").where("n = wanted").select("item_id", "doc_id")
