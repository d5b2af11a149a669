"""Shards cut from a Hilbert-curve order of document metadata, in DataFrame functions only.

Several metadata dimensions are quantised in the order of their values, each row gets its index on the Hilbert curve
through that grid, rows are sorted by it over the whole cluster, and the order is cut into runs of equal counts. A run
covers a compact piece of the grid and so a short range of each dimension: a reader that filters on any of them skips
most files by their least and greatest values.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.runtime import discard, free_name, materialize, shuffle_width

SHARDS = 8
#: Bits of each of the three dimensions.
BITS = 4


@cache
def curve(dims: int, bits: int) -> list[int]:
    """Hilbert index of each grid cell; the cell number holds the first dimension in its highest bits.

    Made by walking the curve: the Gray code of each index digit is mirrored and turned by the state so far.
    """
    size = 1 << dims
    index_of = [0] * (1 << dims * bits)
    for index in range(len(index_of)):
        entry, axis, point = 0, 0, [0] * dims
        for level in range(bits - 1, -1, -1):
            digit = index >> (level * dims) & (size - 1)
            gray = digit ^ digit >> 1
            turn = axis + 1
            turned = (gray << turn | gray >> dims - turn % dims) & (size - 1) if turn % dims else gray
            corner = turned ^ entry
            for k in range(dims):
                point[k] |= (corner >> k & 1) << level
            start = 0 if digit == 0 else (2 * ((digit - 1) // 2)) ^ (2 * ((digit - 1) // 2)) >> 1
            turned = (start << turn | start >> dims - turn % dims) & (size - 1) if turn % dims else start
            entry ^= turned
            if digit == 0:
                step = 0
            else:
                low = digit if digit % 2 else digit - 1
                step = ((low + 1) & -(low + 1)).bit_length() - 1
            axis = (axis + step + 1) % dims
        cell = sum(p << bits * (dims - 1 - k) for k, p in enumerate(point))
        index_of[cell] = index
    return index_of


def placed(rows: DataFrame, order: list[str], weight: Column | None = None) -> DataFrame:
    """``rows`` as a written table with ``place``, the sum of the weights (of 1 each) before in ``order``, and ``total``.

    Rows are dealt by ranges of the order and summed within each range; only a row for each range is summed in one task.
    The added columns have free names of their own, which the result tells as ``part``, ``place`` and ``total`` in
    ``curata_names``.
    """
    part, place, total, before = (free_name(rows, f"curata_{n}") for n in ("part", "place", "total", "before"))
    weight = F.lit(1) if weight is None else weight
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).withColumn(part, F.spark_partition_id())
    dealt = materialize(dealt, "curve-order")
    sums = dealt.groupBy(part).agg(F.sum(weight).alias("n"))  # a row for each range
    earlier = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(part, F.coalesce(earlier, F.lit(0)).alias(before), F.sum("n").over(Window.partitionBy(F.lit(1))).alias(total))
    own = F.sum(weight).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn(place, F.coalesce(own, F.lit(0))).join(F.broadcast(offsets), part)
    out = out.withColumn(place, F.col(place) + F.col(before)).drop(before, part)
    out.curata_names, out.curata_path = (place, total), dealt.curata_path
    return out


def bounds(values: DataFrame, bits: int) -> list[tuple[int, object]]:
    """Number and least value of each cell that has values: cells hold about equal numbers of rows of ``values(v)``.

    Equal values share a cell, so a value of a third of all rows is a cell of its own. At most ``2 ** bits`` values come
    to the driver. Nulls count nowhere and lie in the first cell.
    """
    counts = values.where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    spread = placed(counts, ["v"], F.col("n"))
    place, total = spread.curata_names
    cell = F.expr(f"(({place} + n div 2) * {1 << bits}) div {total}")
    cells = spread.groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).orderBy("cell").collect()  # a row for each cell
    discard(spread)
    return [(r.cell, r.v) for r in cells]


def coordinate(value: Column, cells: list[tuple[int, object]]) -> Column:
    """The cell of a value: the last one whose least value it reaches; 0 for null."""
    out = F.lit(0)
    for number, least in cells:
        out = F.when(value >= F.lit(least), F.lit(number)).otherwise(out)
    return out


def dimensions(lang: Column, source: Column, size: Column) -> list[Column]:
    """The values whose order the curve keeps: language, source, and the size in steps of an eighth of a doubling."""
    return [lang.cast("string"), source.cast("string"), F.floor(8 * F.log2(size.cast("double")))]


def curve_of(docs: DataFrame, bits: int = BITS) -> Column:
    """The curve index of each row of ``docs(text, lang, source)``, whose values are read once for the cuts."""
    values = dimensions(F.col("lang"), F.col("source"), byte_size(F.col("text")))
    cuts = [bounds(docs.select(v.alias("v")), bits) for v in values]
    return hilbert_index([coordinate(v, c) for v, c in zip(values, cuts, strict=True)], bits)


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Index on the curve. The grid has few cells, so the curve is one constant array."""
    if len(coordinates) * bits > 12:
        raise ValueError("the grid has more than 4096 cells")
    cell = F.lit(0)
    for c in coordinates:
        cell = cell * (1 << bits) + c
    return F.get(F.array(*map(F.lit, curve(len(coordinates), bits))), cell)


def _cut(spread: DataFrame, shards: int) -> tuple[Column, Column]:
    """Shard and slot of each row of a table of :func:`placed`."""
    place, total = spread.curata_names
    shard = F.expr(f"({place} * {shards}) div {total}")
    return shard.cast("int"), F.col(place) - F.expr(f"((({place} * {shards}) div {total}) * {total} + {shards - 1}) div {shards}")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, curve, shard, slot`` for each row of ``doc_id, text, lang, source``.

    Counts of any two shards are at most one apart; slots have no gap and follow the curve, equal texts side by side.
    A null text has size 1; null metadata lies in the first cell; equal rows share a place in the order, and which of them
    comes first does not show; an empty table gives an empty result; other columns do no harm. Only keys are shuffled,
    never texts. A hot group is cut over range partitions by ``doc_id``.
    """
    rows = docs.select(
        "doc_id",
        byte_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"),
        curve_of(docs).alias("curve"),
    )
    spread = placed(rows, ["curve", "same", "doc_id"])
    shard, slot = _cut(spread, shards)
    return spread.select("doc_id", "size", "text_crc32", "curve", shard.alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, folder: str = "shard") -> None:
    """Write ``docs`` as Parquet, a folder ``<folder>=<k>`` for each shard of :func:`sharded`, sorted along the curve.

    The shards are exactly those of :func:`sharded`: counts at most one apart. A range of the order is written by one
    task into the one or two shards that it meets, so no shard passes through one task. ``folder`` must be no column of
    ``docs``; other names do no harm. Nulls, repeated rows and empty tables are as in :func:`sharded`.
    """
    if free_name(docs, folder) != folder:
        raise ValueError(f"{folder} is a column of the table")
    curve, same = free_name(docs, "curata_curve"), free_name(docs, "curata_same")
    rows = docs.withColumns({curve: curve_of(docs), same: F.xxhash64(F.coalesce("text", F.lit("")))})
    spread = placed(rows, [curve, same, "doc_id"])
    shard, _ = _cut(spread, shards)
    spread.select(*(F.col(f"`{c}`") for c in docs.columns), shard.alias(folder), curve, same).sortWithinPartitions(folder, curve, same, "doc_id").drop(curve, same).write.partitionBy(
        folder
    ).parquet(path)
    discard(spread)


def op5_hilbert(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = sharded(docs)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
