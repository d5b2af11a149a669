"""Files as checked pieces: JSON lines under zstd, and shards that are put together again by their digests.

Spark reads the bytes, so files may lie in any store it knows. A file is opened as a stream in its task, in blocks of
bounded size; shards meet by number, and only a shard is ever held by a task that checks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed bytes that are opened at once, lines in a batch, and bytes of lines in one.
BLOCK, LINES, LINE_BYTES = 1 << 16, 2048, 8 << 20


def _opened(content: memoryview) -> Iterator[bytes]:
    """What is in one frame or many, piece by piece; an error where a frame is damaged or the bytes end within one."""
    frame, used = zstandard.ZstdDecompressor().decompressobj(), False
    for at in range(0, len(content), BLOCK):
        rest = bytes(content[at : at + BLOCK])
        while rest:
            if frame.eof:
                frame = zstandard.ZstdDecompressor().decompressobj()
            used = True
            yield frame.decompress(rest)
            rest = frame.unused_data if frame.eof else b""
    if used and not frame.eof:
        raise zstandard.ZstdError("the bytes end within a frame")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(path: str, first: int, lines: list[bytes], error: str | None = None) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines], pa.string()), pa.array([error] * n, pa.string())],
            ["path", "line", "text", "error"],
        )

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            first, held, size, rest, error = 0, [], 0, b"", None
            blocks = _opened(memoryview(content.as_buffer()))
            while True:
                try:
                    block = next(blocks, None)
                except zstandard.ZstdError as e:  # what was whole before it still counts
                    block, rest, error = None, b"", str(e)
                if block is None:
                    break
                parts = (rest + block).split(b"\n")
                rest = parts.pop()
                for line in parts:
                    held.append(line)
                    size += len(line)
                    if len(held) == LINES or size > LINE_BYTES:
                        yield batch_of(path, first, held)
                        first, held, size = first + len(held), [], 0
            if rest:
                held.append(rest)
            if held:
                yield batch_of(path, first, held)
            if error:
                yield batch_of(path, first + len(held), [b""], error)


def zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, text, error``: the lines of zstd files, of one frame or many, numbered from 0 in each file.

    A file that breaks off or is damaged gives the lines before that in whole blocks, and then a row with the error; an
    empty file gives none. A task holds a compressed file, so files should be shards of bounded size, as Spark's own
    reader of binary files demands too; what comes out of it is never held whole.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # whole files
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_lines, "path string, line long, text string, error string")


def zstd_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of zstd files of JSON lines under a schema; blank lines are left out, bad ones are rows of nulls."""
    lines = zstd_lines(spark, path).where(F.col("error").isNull() & (F.trim("text") != ""))
    return lines.select("path", "line", F.from_json("text", schema).alias("row")).select("path", "line", "row.*")


def shards_of(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """``file, length, file_sha256, number, count, content, shard_sha256``: the files of a path cut into ``shard`` bytes.

    Spark leaves out files without a byte.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", F.sha2("content", 256).alias("file_sha256"), "content")
    count = F.greatest(F.expr(f"cast((length + {shard - 1}) div {shard} as int)"), F.lit(1))
    cut = files.withColumn("count", count).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    piece = F.substring("content", F.col("number") * shard + 1, F.lit(shard))
    return cut.select("file", "length", "file_sha256", "number", "count", piece.alias("content")).withColumn("shard_sha256", F.sha2("content", 256))


def damage(shards: DataFrame) -> DataFrame:
    """``file, number, reason`` of each shard that is ``damaged`` (its digest differs), ``repeated`` with another content, or ``missing``."""
    right = F.coalesce(F.sha2("content", 256) == F.col("shard_sha256"), F.lit(False))
    bad = shards.where(~right).select("file", "number", F.lit("damaged").alias("reason"))
    there = shards.where(right).groupBy("file", "count", "number").agg(F.count_distinct("shard_sha256").alias("kinds"))
    twice = there.where("kinds > 1").select("file", "number", F.lit("repeated").alias("reason"))
    wanted = shards.select("file", "count").distinct().withColumn("number", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    lost = wanted.join(there, ["file", "count", "number"], "left_anti").join(bad.select("file", "number"), ["file", "number"], "left_anti")
    return bad.unionByName(twice).unionByName(lost.select("file", "number", F.lit("missing").alias("reason"))).distinct()


def reassembled(shards: DataFrame) -> DataFrame:
    """``file, content, whole`` of the files none of whose shards is damaged or missing; repeated equal shards count once.

    ``whole`` tells whether the file's own digest is right. A file is one value here, so it has less than 2 GB; larger
    ones stay a table of shards, which :func:`damage` has checked.
    """
    good = shards.join(damage(shards).select("file").distinct(), "file", "left_anti").dropDuplicates(["file", "number"])
    parts = good.groupBy("file", "file_sha256").agg(F.sort_array(F.collect_list(F.struct("number", "content"))).alias("parts"))
    joined: Column = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["content"]))
    return parts.select("file", "file_sha256", joined.alias("content")).select("file", "content", (F.sha2("content", 256) == F.col("file_sha256")).alias("whole"))
