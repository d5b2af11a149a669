"""Near-duplicate documents by SimHash fingerprints and a self-join of their binary trie.

A fingerprint is the bitwise majority of the hashes of all word shingles. Two fingerprints link if at most ``budget``
bits differ. Fingerprints are dealt out under keys of some of their bits and meet under every key that is equal. Within
one key they form a binary trie, and pairs of its nodes are traversed together: differing bits add up on the way down,
and a pair of nodes is dropped as soon as they exceed the budget.

:func:`near_duplicates` takes 64 bits and every choice of ``blocks - budget`` of ``blocks`` runs of bits as keys: of two
linked fingerprints at least that many runs are equal, so none is lost. :func:`similar_documents` takes four times as
many bits, whose differences tell the similarity of two sets of shingles, and as many keys of random bits as leave
a stated share of links at the least similarity unfound. Its budget is wide, so that few links are lost, and each link that
the tries find is then checked by a sketch of 256 least hashes of either set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.components import connected_components, join_hot
from curata.runtime import arrow_rows, discard, free_name, join_checked, materialize, shuffle_width

SHINGLE = 4
BUDGET = 4
BLOCKS = 6
#: Distinct fingerprints of one key that meet in one task. Larger keys are cut, and every two of the cuts meet.
CAP = 4096
#: Node pairs that are expanded at once.
FRONTIER = 1 << 20
#: Near-duplicate texts: words of a shingle, least similarity of the sets of shingles, 64-bit words of a fingerprint.
WIDTH, SIMILARITY, WORDS = 5, 0.8, 4
#: Share of links at the least similarity that no key brings together.
MISSED = 0.01
#: Standard deviations by which fingerprints may differ more than expected at the least similarity, and by which sketches
#: may agree less.
PRINT_SLACK, SKETCH_SLACK = 2.5, 2.0
#: Least hashes in a sketch, a byte of each.
SKETCH = 256
#: Shares of the budget up to which pairs are merged first, so that links are between near texts where there is a choice.
LEVELS = (0.4, 0.7, 1.0)
#: Fingerprints that share a key by chance, about; more documents make the keys longer.
BY_CHANCE = 64
#: Losing rows that are broadcast at most; more are joined by sort-merge.
LOSERS = 1_000_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of all word shingles, repeats included; of the whole text if it has fewer words, none without words."""
    words = text.lower().split()  # bytes: A-Z only, and white space of one byte only
    hash64, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1) if words else 0
    return np.array([hash64(b" ".join(words[i : i + width]), 42) for i in range(n)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as one number; 0 without hashes."""
    ones, n = np.zeros(64, dtype=np.int64), len(hashes)
    for at in range(0, n, 255):  # sums that fit a byte
        bits = np.unpackbits(hashes[at : at + 255].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text; 0 if it has no word."""
    return majority(shingle_hashes(text, width))


def mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Other hashes of the same shingles for a further 64 bits (the finaliser of splitmix64 on a shifted hash)."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray, size: int = SKETCH) -> bytes:
    """One byte of the least hash of a set under each of ``size`` mixings; equal bytes tell the similarity of two sets."""
    if not len(hashes):
        return bytes(size)
    rng = np.random.default_rng(128)
    factor, shift = (rng.integers(0, 1 << 32, size, dtype=np.uint32) for _ in range(2))
    short, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(size, (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(short), 4096):
        mixes = short[at : at + 4096, None] * (factor | np.uint32(1)) + shift
        least = np.minimum(least, mixes.min(axis=0))
    return least.astype(np.uint8).tobytes()


def least_agreeing(similarity: float = SIMILARITY, size: int = SKETCH) -> int:
    """Equal bytes that the sketches of a link have at least."""
    p = similarity + (1 - similarity) / 256
    return ceil(size * p - SKETCH_SLACK * sqrt(size * p * (1 - p)))


def _prints(words: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = []
            if words == 1:
                prints = [[fingerprint(t, width)] for t in texts]
            else:
                sets = [np.unique(shingle_hashes(t, width)) for t in texts]
                prints = [[majority(mixed(h, k + 1)) for k in range(words)] for h in sets]
                columns = [pa.array([sketch(h) for h in sets], pa.binary())]
            prints = np.array(prints, dtype=np.uint64).reshape(-1, words).view(np.int64)
            columns = [*(pa.array(np.ascontiguousarray(c)) for c in prints.T), *columns]
            names = ["rid", "doc_id", *_names(words), "sketch"]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), *columns], names[: 2 + len(columns)])

    return run


def _names(words: int) -> list[str]:
    return [f"f{k}" for k in range(words)]


def fingerprints(docs: DataFrame, words: int = 1, width: int = SHINGLE) -> DataFrame:
    """``rid, doc_id, f0, ...`` of a table with ``rid``, ``doc_id`` and ``text``; a null text counts as empty.

    One word of 64 bits is that of all shingles; more are of the set of shingles, whose ``sketch`` follows.
    """
    arrow_rows(docs.sparkSession)
    kinds = dict(docs.dtypes)
    prints = ", ".join(f"{c} long" for c in _names(words)) + (", sketch binary" if words > 1 else "")
    return docs.select("rid", "doc_id", "text").mapInArrow(_prints(words, width), f"rid {kinds['rid']}, doc_id {kinds['doc_id']}, {prints}")


def run_keys(budget: int = BUDGET, blocks: int = BLOCKS) -> list[Column]:
    """One key for each choice of ``blocks - budget`` runs of bits of ``f0``: no pair within the budget is lost."""
    if not budget < blocks <= 16:
        raise ValueError("blocks must be above budget, and 16 at most")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - budget)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        keys.append(F.struct(F.lit(number).alias("choice"), F.col("f0").bitwiseAND(F.lit(_signed(mask))).alias("bits")))
    return keys


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two sets of equal size and this Jaccard similarity."""
    return acos(2 * similarity / (1 + similarity)) / pi


def similarity_budget(similarity: float = SIMILARITY, words: int = WORDS) -> int:
    """Differing bits that are allowed: what is expected at the similarity and ``PRINT_SLACK`` standard deviations."""
    n, p = 64 * words, differing_share(similarity)
    return int(n * p + PRINT_SLACK * sqrt(n * p * (1 - p)))


def random_keys(count: int, similarity: float = SIMILARITY, words: int = WORDS, missed: float = MISSED) -> list[Column]:
    """Keys of random bits for ``count`` fingerprints, as many as leave a share of ``missed`` at the similarity unfound."""
    bits = max(12, (max(count, 1) // BY_CHANCE).bit_length())
    number = ceil(log(missed) / log(1 - (1 - differing_share(similarity)) ** bits))
    rng = np.random.default_rng(64)
    keys = []
    for k in range(number):
        chosen = [int(b) for b in rng.choice(64 * words, bits, replace=False)]
        masks = [sum(1 << b % 64 for b in chosen if b // 64 == w) for w in range(words)]
        parts = [F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(_names(words), masks, strict=True) if m]
        keys.append(F.struct(F.lit(k).alias("choice"), F.xxhash64(*parts).alias("bits")))
    return keys


def trie_pairs(group: np.ndarray, prints: np.ndarray, budget: int, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Join each group's binary trie with itself and merge the labels of all pairs within the budget.

    What comes back are the pairs that merged two labels: they connect what the budget connects, and are within it.
    ``group`` and the rows of ``prints``, the most significant word first, are sorted by (group, print). A node is a run
    ``[lo, hi)`` of that order and a label is the least position that a position is linked to. Node pairs whose leaves all
    have one label already are dropped.
    """
    n, words = prints.shape
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    lo, hi = starts[many], ends[many]
    merged: list[tuple[np.ndarray, np.ndarray]] = []
    ones: dict[int, np.ndarray] = {}

    def ones_before(bit: int) -> np.ndarray:
        if bit not in ones:
            column = prints[:, words - 1 - bit // 64]
            ones[bit] = np.r_[0, np.cumsum((column >> np.uint64(bit % 64)) & np.uint64(1), dtype=np.int64)]
        return ones[bit]

    stack = [(64 * words - 1, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int16))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, err))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, err)))]
            continue
        change = np.r_[0, np.cumsum(labels[1:] != labels[:-1])]
        same = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (labels[alo] == labels[blo])
        leaf = ~same & (ahi - alo == 1) & (bhi - blo == 1)
        a, b = alo[leaf], blo[leaf]
        if len(a):
            errors = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(errors <= budget)
            near = near[np.argsort(errors[near], kind="stable")]
            merged += _forest(labels, a[near], b[near])
        rest = ~same & ~leaf
        alo, ahi, blo, bhi, err = (x[rest] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if bit < 0:  # equal prints
            merged += _forest(labels, np.repeat(alo, ahi - alo), _ranges(alo, ahi))
            merged += _forest(labels, np.repeat(alo, bhi - blo), _ranges(blo, bhi))
            continue
        c = ones_before(bit)
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        own = alo == blo
        cross = ~own
        parts = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + 1),
            tuple(x[cross] for x in (amid, ahi, blo, bmid, err + 1)),
        ]
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        alo, ahi, blo, bhi, err = nxt
        keep = (ahi > alo) & (bhi > blo) & (err <= budget) & ~((alo == blo) & (ahi - alo == 1))
        stack.append((bit - 1, *(x[keep] for x in (alo, ahi, blo, bhi, err))))
    return merged


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merge the labels of all pairs; the pairs that did it, earlier ones first, without a circle.

    In each round every label takes its first pair that leads to another label.
    """
    out = []
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        ends, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        first, place = np.full(len(ends), len(a)), np.arange(len(a))
        np.minimum.at(first, at, np.concatenate([place, place]))
        chosen = np.unique(first)
        out.append((a[chosen], b[chosen]))
        _merge(labels, a[chosen], b[chosen])
    return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    size = hi - lo
    return np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the components of each pair the lesser label, until nothing changes."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def _join_tries(words: int, budget: int, limit: int):
    names = _names(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(group: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            labels, found = np.arange(len(prints)), []
            for part in LEVELS if words > 1 else LEVELS[-1:]:
                found += trie_pairs(group, prints, int(part * budget), labels)
            u, v = (np.concatenate([nodes[p[k]] for p in found] or [nodes[:0]]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

        held: list[tuple[np.ndarray, ...]] = []
        rows, last, number = 0, None, 0
        for batch in batches:
            key = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "bits", "i", "j")]
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            prints = np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names], axis=1)
            if not len(prints):
                continue
            first = np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0)]
            first[0] = last is None or tuple(k[0] for k in key) != last
            group = number + np.cumsum(first)
            number, last = int(group[-1]), tuple(k[-1] for k in key)
            held.append((group, nodes, prints))
            rows += len(prints)
            if rows >= limit:  # all groups but the last are complete
                group, nodes, prints = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(group, group[-1]))
                if cut:
                    yield links(group[:cut], nodes[:cut], prints[:cut])
                held, rows = [(group[cut:], nodes[cut:], prints[cut:])], len(group) - cut
        if rows:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def fingerprint_links(prints: DataFrame, keys: list[Column], count: int, budget: int = BUDGET, cap: int = CAP) -> DataFrame:
    """Links ``u, v`` between the ``node`` numbers of the ``count`` rows of ``prints(node, f0, ...)``, which are distinct.

    Fingerprints that share a key and differ in ``budget`` bits at most end up connected. A key gives the links of a
    forest, not every pair: no link between components is lost, and a key of m near copies gives less than m rows. A key of more than ``cap`` fingerprints is cut into parts by hash, and each two parts meet in a task of their
    own, so no task holds more than two of them.
    """
    spark, names = prints.sparkSession, [c for c in prints.columns if c != "node"]
    dealt = prints.select("node", *names, F.explode(F.array(*keys)).alias("k")).select("node", *names, "k.choice", "k.bits")
    sizes = dealt.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / F.lit(cap)).cast("int"))
    met = join_hot(dealt, sizes, ["choice", "bits"], count * len(keys))
    met = met.withColumn("own", F.pmod(F.xxhash64(*names), F.col("parts")).cast("int"))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    met = met.withColumn("other", F.explode(other)).select(
        "node", *names, "choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    # unsigned order of the prints: flip the sign bit for the sort
    order = [F.col(c).bitwiseXOR(F.lit(-(1 << 63))) for c in names]
    tasks = met.repartition(shuffle_width(spark), "choice", "bits", "i", "j").sortWithinPartitions("choice", "bits", "i", "j", *order)
    return tasks.mapInArrow(_join_tries(len(names), budget, 200_000), "u long, v long").distinct()


def _agreeing(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("a", "b"))
                kept = pa.array((a == b).sum(axis=1) >= least)
                yield batch.select(["u", "v"]).filter(kept)

    return run


def checked_links(links: DataFrame, prints: DataFrame, least: int) -> DataFrame:
    """The links whose sketches in ``prints(node, sketch)`` agree in ``least`` bytes or more; hot nodes are split by Spark."""
    side = lambda end, name: prints.select(F.col("node").alias(end), F.col("sketch").alias(name)).hint("merge")
    met = links.join(side("u", "a"), "u").join(side("v", "b"), "v")
    return met.select("u", "v", "a", "b").mapInArrow(_agreeing(least), "u long, v long")


def _with_components(marked: DataFrame, keys, budget: int, cap: int, agreeing: int | None = None) -> DataFrame:
    """``rid, doc_id, f0, ..., component_id, keeper`` of a written table ``rid, doc_id, f0, ...``; ``keys`` takes a count.

    With ``agreeing`` the table has sketches too, which agree in so many bytes at least where two texts link.
    """
    names = [c for c in marked.columns if c not in ("rid", "doc_id", "sketch")]
    # nulls last, then the first row
    more = [F.col("sketch")] if agreeing else []
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"), *more)
    prints = marked.groupBy(*names).agg(F.min(first).alias("first"), F.count("*").alias("n"))
    prints = materialize(prints.withColumn("node", F.col("first.rid")), "distinct-prints")
    written, count = prints, prints.count()
    links = fingerprint_links(prints.select("node", *names), keys(count), count, budget, cap)
    if agreeing:
        found = materialize(links, "candidate-links")
        links = checked_links(found, prints.select("node", F.col("first.sketch").alias("sketch")), agreeing)
        prints = prints.withColumn("first", F.col("first").dropFields("sketch"))
    rooted = prints.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted.withColumnRenamed("n", "copies"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    ids = join_hot(rooted, least, ["root"], count)
    ids = ids.select(*names, F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("keeper"), F.col("copies").alias("n"))
    ids = materialize(ids, "components")
    discard(written)
    discard(rooted)
    if agreeing:
        discard(found)
    return join_hot(marked, ids, names, marked.count()).select("rid", "doc_id", *names, "component_id", "keeper")


def _numbered(docs: DataFrame, rid: str | None) -> DataFrame:
    number = F.col(rid) if rid else F.monotonically_increasing_id()
    return docs.select(number.alias("rid"), "doc_id", "text")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS, cap: int = CAP, rid: str | None = None) -> DataFrame:
    """``rid, doc_id, fp, component_id, keeper`` for each row of a table with ``doc_id`` and ``text``.

    ``component_id`` is the least ``doc_id`` that is reachable over links of ``budget`` bits at most, itself included,
    and ``keeper`` the ``rid`` of the first row with it. A text without words has fingerprint zero and links like any
    other. A null text counts as empty; a null ``doc_id`` is never least, and a component of nulls only has a null id.
    Rows with the same ``doc_id`` stay rows of their own; an empty table gives an empty result. ``rid`` names a
    column of distinct row numbers; without it the rows are numbered here. Other columns do no harm, whatever their names.
    """
    marked = materialize(fingerprints(_numbered(docs, rid)), "prints")
    return _with_components(marked, lambda n: run_keys(budget, blocks), budget, cap).withColumnRenamed("f0", "fp")


def similar_documents(
    docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, words: int = WORDS, cap: int = CAP, rid: str | None = None, missed: float = MISSED
) -> DataFrame:
    """``rid, doc_id, component_id, keeper`` by the similarity of the sets of word shingles, as fingerprints tell it.

    Two texts link if their wide fingerprints differ in :func:`similarity_budget` bits at most and their sketches agree in
    :func:`least_agreeing` bytes at least. Texts with equal sets of shingles, exact copies among them, always link. Nulls, repeats and empty tables are as in :func:`near_duplicates`.
    """
    marked = materialize(fingerprints(_numbered(docs, rid), words, width), "wide-prints")
    keys = lambda n: random_keys(n, similarity, words, missed)
    found = _with_components(marked, keys, similarity_budget(similarity, words), cap, least_agreeing(similarity))
    return found.select("rid", "doc_id", "component_id", "keeper")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that are the keeper of their component in :func:`similar_documents`, with all their columns.

    Of equal ids the first row stays; null texts are copies of each other and of texts without words; an empty table
    stays empty. No column name can clash: the rows are numbered under a free name. Only the numbers of rows that go are
    joined back, by broadcast while they are few.
    """
    mark = free_name(docs, "curata_rid")
    held = materialize(docs.withColumn(mark, F.monotonically_increasing_id()), "numbered")
    found = similar_documents(held, similarity, width, rid=mark)
    losers = materialize(found.where("rid <> keeper").select(F.col("rid").alias(mark)), "losers")
    return join_checked(held, losers, [mark], "left_anti", LOSERS).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")

