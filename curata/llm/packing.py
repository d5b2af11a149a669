"""Token sequences packed shortest-pack-first over the histogram of lengths.

Documents are cut at the sequence length; only the histogram of piece lengths, which has at most that many rows, goes
to the driver. There the lengths are placed longest first, each into the shortest pack that is open, and
only the counts of packing patterns are kept. Pieces find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.runtime import arrow_rows, join_checked, materialize

LENGTH = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Words and pieces of words whose ids a worker keeps at hand, twice as many at most.
WORDS, PIECES = 250_000, 300_000


class Cache:
    """A map that keeps what was used lately: when the young half is full it becomes the old half."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


class WordEncoder:
    """Ids of a tokenizer that never joins across white space, as little-endian 32-bit bytes.

    Words are looked up, then the pieces into which the tokenizer's own pattern splits a lower-cased word; only pieces
    not seen lately go through the tokenizer's merges. Texts with characters beyond Latin-1, whose normal form may change or whose lower case
    may depend on their neighbours, are encoded word by word without that.
    """

    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    ODD = regex.compile("[^\x00-\x1b\x20-\xff]|<\\|")  # also separators that only Python takes for white space, and special tokens

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.words, self.pieces = Cache(WORDS), Cache(PIECES)
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in kept]
        self.alphabet = {b: 256 + n for n, b in enumerate(others)}

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        out = []
        for piece in self.PIECES.findall(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                letters = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
                ids = b"".join([t.id.to_bytes(4, "little") for t in self.merge(letters)])
                self.pieces.put(piece, ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self._raw(text)
        words = text.split()
        out = list(map(self.words.young.get, words))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    w = words[i]
                    ids = self.words.get(w)
                    if ids is None:
                        ids = self._word(w)
                        self.words.put(w, ids)
                    out[i] = ids
        return b"".join(out)


def _pieces(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, ranks = WordEncoder(path), TaskContext.get().partitionId(), Counter()
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview(encoder.encode(text or "") + end)
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    size = len(piece) // 4
                    rows.append((i, start, size, zlib.crc32(piece), total, ranks[size]))
                    ranks[size] += 1
            columns = np.array(rows, dtype=np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(columns[0])), *map(pa.array, columns[1:]), pa.array(np.full(len(rows), part))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "local_rank", "part"],
            )

    return run


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packing patterns ``(((piece length, times), ...), packs)`` for a histogram of piece lengths.

    Lengths are placed longest first, each piece into the shortest open pack if that has room, else into a new pack. All
    packs of a pattern move together: a step ends a length or changes a whole pattern, so a length adds two patterns at
    most and their number is bounded by the sequence length.
    """
    room: dict[int, list[list]] = {}  # space left -> [pattern, packs]
    spaces: list[int] = []  # sorted
    done = []

    def put(space: int, pattern: tuple, packs: int) -> None:
        if not packs:
            return
        if space == 0:
            done.append((pattern, packs))
            return
        if space not in room:
            room[space] = []
            insort(spaces, space)
        room[space].append([pattern, packs])

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if not spaces or spaces[-1] < size:  # no open pack has room
                each = length // size
                packs, over = divmod(left, each)
                put(length - each * size, ((size, each),), packs)
                put(length - over * size, ((size, over),), int(over > 0))
                break
            space = spaces[-1]
            pattern, packs = room[space].pop()
            if not room[space]:
                del room[space], spaces[-1]
            used = min(left, packs)
            *head, (last, times) = pattern
            grown = (*head, (last, times + 1)) if last == size else (*pattern, (size, 1))
            put(space - size, grown, used)
            put(space, pattern, packs - used)
            left -= used
    return done + [(p, n) for s in spaces for p, n in room[s]]


def slot_table(patterns: list) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank of each slot run, and its pieces in a pack, offset and first sequence."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for pattern, packs in patterns:
        offset = 0
        for size, times in pattern:
            table.setdefault(size, []).append((taken[size], times, offset, sequence))
            taken[size] += times * packs
            offset += size * times
        sequence += packs
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in table.items()}


def _places(table: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, times, start, base = table[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                pack, nth = np.divmod(rank[at] - first[k], times[k])
                sequence[at], offset[at] = base[k] + pack, start[k] + nth * s
            keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"]
            )

    return run


def packed(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each row of ``doc_id, text``: its place in its document and in its sequence.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table gives an empty result. Ties
    between pieces of one length go by input partition and order there. Ranks are counted within input partitions and
    shifted by the counts of earlier partitions, so a length of any frequency stays spread out.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    path, kind = tokenizer or public_tokenizers.path(TOKENIZER), dict(docs.dtypes)["doc_id"]
    schema = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long{}"
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(path, length, end_id), schema.format(kind, ", local_rank long, part long"))
    pieces = materialize(pieces, "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    running = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    counts = materialize(counts, "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    table = slot_table(shortest_pack_first(histogram, length))
    # a row for each length and input partition: broadcast only while counted as few
    ranked = join_checked(pieces, counts.select("length", "part", "before"), ["length", "part"], "inner")
    ranked = ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local_rank")).alias("rank")
    )
    return ranked.mapInArrow(_places(table), schema.format(kind, ", sequence_id long, offset long"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
