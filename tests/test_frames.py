"""JSON lines under zstd, and shards of files that are checked and put together again."""

import json
import random

import zstandard
from pyspark.sql import functions as F

from curata.sources import frames


def test_zstd_lines(spark, tmp_path):
    """One frame and many, no end of line, empty files, lines longer than a block, and a file that breaks off."""
    rows = [{"id": i, "text": "ä" * (i % 50) if i != 77 else "x" * 3_000_000} for i in range(5_000)]
    data = b"\n".join(json.dumps(r).encode() for r in rows)
    pack = zstandard.ZstdCompressor().compress
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.zst").write_bytes(pack(data))
    (folder / "many.zst").write_bytes(b"".join(pack(data[i : i + 70_000] or b"") for i in range(0, len(data), 70_000)))
    (folder / "empty.zst").write_bytes(pack(b""))
    rng = random.Random(1)
    noise = b"\n".join(rng.randbytes(60).hex().encode() for _ in range(60_000))
    (folder / "broken.zst").write_bytes(pack(noise)[:-2_000_000] + b"\x00" * 50)
    got = frames.zstd_json(spark, str(folder), "id long, text string").where("path like '%one.zst' or path like '%many.zst'")
    for name in ("one", "many"):
        mine = {r.line: (r.id, r.text) for r in got.where(F.col("path").endswith(f"{name}.zst")).collect()}
        assert mine == {k: (r["id"], r["text"]) for k, r in enumerate(rows)}
    lines = frames.zstd_lines(spark, str(folder))
    assert lines.where("path like '%empty.zst'").count() == 0
    broken = lines.where("path like '%broken.zst'").orderBy("line").collect()
    want = noise.decode().split("\n")
    whole = [r.text for r in broken if r.error is None]
    assert len(want) > len(whole) > 1_000 and whole == want[: len(whole)] and broken[-1].error


def test_shards(spark, tmp_path):
    """Files larger and smaller than a shard, and shards that are damaged, repeated or lost."""
    rng = random.Random(5)
    folder = tmp_path / "in"
    folder.mkdir()
    contents = {"a": rng.randbytes(2_560), "b": rng.randbytes(1_000), "c": b"!", "d": rng.randbytes(1_001)}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    shards = frames.shards_of(spark, str(folder), 1_000)
    assert shards.count() == 3 + 1 + 1 + 2
    name = F.element_at(F.split("file", "/"), -1)
    out = {r.n: (bytes(r.content), r.whole) for r in frames.reassembled(shards.unionByName(shards.limit(3))).withColumn("n", name).collect()}
    assert out == {k: (v, True) for k, v in contents.items()}
    assert frames.damage(shards).count() == 0
    hurt = shards.where(~((name == "b") | ((name == "d") & (F.col("number") == 1))))
    hurt = hurt.withColumn("content", F.when((name == "a") & (F.col("number") == 1), F.concat(F.col("content"), F.lit(b"!"))).otherwise(F.col("content")))
    found = {(r.n, r.number, r.reason) for r in frames.damage(hurt).withColumn("n", name).collect()}
    assert found == {("a", 1, "damaged"), ("d", 1, "missing")}
    assert [r.n for r in frames.reassembled(hurt).withColumn("n", name).collect()] == ["c"]


def test_stems(spark, tmp_path):
    """A plain file, one in a folder of parts, and names with several full stops."""
    from curata.sources import tables

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.v2.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    spark.range(10, 40).repartition(3).write.json(f"{folder}/many_parts.jsonl")
    got = {r.file_stem: r["count"] for r in tables.scan_with_stem(spark, f"{folder}/*.jsonl", "id long").groupBy("file_stem").count().collect()}
    assert got == {"one": 2, "many_parts": 30}
