"""Fill-in-the-middle texts: two cuts between tokens, and the pieces in one of two orders with marks before each.

A text's bytes become big integers with one bit for each byte, the first byte highest: one integer tells blanks, one the
first bytes of code points. A shift and two boolean operations mark where tokens start, the population count gives the
number of tokens, and the place of the k-th token is found by halving the integer again and again. All of it is linear
in the length of the text, and no token is ever cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.runtime import arrow_rows

#: Marks before prefix, suffix and middle. A text that holds one of them stays plain.
MARKS = ("<P>", "<S>", "<M>")
SEED = 42
#: Of 100 texts about so many are cut, and of 100 cut ones so many have the suffix first.
CUT, SUFFIX_FIRST = 50, 80

_BLANK = bytes(b"01"[b in b"\x20\x09\x0a\x0b\x0c\x0d"] for b in range(256))
_LEAD = bytes(b"10"[0x80 <= b < 0xC0] for b in range(256))


def mask(data: bytes, kind: bytes) -> int:
    """One bit for each byte, set where ``kind`` (256 digits) has ``1`` for it; the first byte has the highest bit."""
    return int(data.translate(kind), 2) if data else 0


def token_starts(data: bytes) -> int:
    """The bits where a token starts: at the first byte, and at each blank that follows another byte than a blank."""
    if not data:
        return 0
    blank = mask(data, _BLANK)
    return blank & ~(blank >> 1) | 1 << (len(data) - 1)


def select(bits: int, width: int, rank: int) -> int:
    """Distance from the top of ``width`` bits to the set bit with ``rank`` (from 0) others above it; ``width`` if there is none."""
    if rank >= bits.bit_count():
        return width
    place = 0
    while width > 1:
        low = width // 2
        top = bits >> low
        n = top.bit_count()
        if rank < n:
            bits, width = top, width - low
        else:
            bits, rank, place, width = bits & ((1 << low) - 1), rank - n, place + width - low, low
    return place


def transform(doc_id: int | None, text: str | None, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST):
    """``(n, form, prefix_chars, middle_chars, output)`` of one text; the draws are hashes of the seed and the id."""
    text = text or ""
    data = text.encode()
    starts = token_starts(data)
    n, size = starts.bit_count(), len(data)
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or h[2] % 100 >= cut or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, second = (select(starts, size, k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    lead = mask(data, _LEAD)
    before, until = ((lead >> (size - at)).bit_count() for at in (first, second))
    prefix, middle, suffix = data[:first].decode(), data[first:second].decode(), data[second:].decode()
    p, s, m = MARKS
    if h[3] % 100 < suffix_first:
        return n, "spm", before, until - before, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", before, until - before, f"{p}{prefix}{s}{suffix}{m}{middle}"


def infilled(docs: DataFrame, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row of a table with ``doc_id`` and ``text``.

    A null or empty text is plain and stays empty; a null id draws from an empty number; repeated rows are alike; an empty
    table gives an empty result; a text of any length is held whole, one at a time; other columns are not read. Nothing
    is shuffled.
    """
    arrow_rows(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            rows = [transform(i.as_py(), t.as_py(), seed, cut, suffix_first) for i, t in zip(ids, batch.column("text"), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(output, pa.string())], names)

    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`infilled` made ``output`` of."""

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        """What follows each of the three marks; no piece holds a mark, so the leftmost one ends it."""
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, MARKS[2], 1)
        return one, two, F.substr(rest, F.length(two) + len(MARKS[2]) + 1)

    p, s, _ = MARKS
    prefix, suffix, middle = pieces(p, s)
    after, before, between = pieces(s, p)
    rebuilt = F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(before, between, after))
    return rebuilt.otherwise(output)


def op12_infill(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = infilled(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
  FROM documents
), u AS (
  SELECT *, len(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, n, form, text, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle,
         array_to_string(t[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
