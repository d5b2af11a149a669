"""URL rules in a sorted array of 64-bit digests, probed by vectorised binary search.

Digests lie in one memory-mapped file and the full strings in another, so a worker touches only the pages that it
probes and all workers of a machine share them. A digest that is found counts only if its stored string is equal.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from curata.runtime import checkpoint_root

#: (verdict, host and path)
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Hosts that are blocked where no rule fits.
BLOCKED_HOSTS = ["cheap-pills.example.org", "spam-farm.example.org", "cheap-pills.example.net", "spam-farm.example.net"]

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for null and for a text without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    cut = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].encode().translate(_UPPER).decode(), path[:cut]


def digest(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw)


class DigestArray:
    """Strings with a small code each, as a sorted digest array in memory-mapped files of a folder."""

    NAMES = ("digests", "codes", "offsets", "strings")

    def __init__(self, prefix: str, find=lambda name: name):
        self.digests, self.codes, self.offsets, self.strings = (
            np.load(find(f"{prefix}-{n}.npy"), mmap_mode="r") for n in self.NAMES
        )

    @classmethod
    def files(cls, entries: list[tuple[str, int]]) -> dict[str, bytes]:
        """The files' contents by name; of equal strings the last wins."""
        keys = sorted((digest(s.encode()), s, c) for s, c in dict(entries).items())
        raw = [s.encode() for _, s, _ in keys]
        arrays = (
            np.array([d for d, _, _ in keys], dtype=np.uint64),
            np.array([c for _, _, c in keys], dtype=np.uint8),
            np.cumsum([0, *map(len, raw)], dtype=np.int64),
            np.frombuffer(b"".join(raw) or b"\0", dtype=np.uint8),
        )
        out = {}
        for name, a in zip(cls.NAMES, arrays, strict=True):
            np.save(held := io.BytesIO(), a)
            out[name] = held.getvalue()
        return out

    def probe(self, texts: list[str]) -> np.ndarray:
        """The code of each text, -1 where it is not there."""
        out = np.full(len(texts), -1, dtype=np.int16)
        if not len(self.digests) or not texts:
            return out
        raw = [t.encode() for t in texts]
        wanted = np.array([digest(r) for r in raw], dtype=np.uint64)
        at = np.searchsorted(self.digests, wanted)
        found = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == wanted))
        for i in found:
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == wanted[i]:  # equal digests lie side by side
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == raw[i]:
                    out[i] = self.codes[k]
                    break
                k += 1
        return out


def share_digests(spark: SparkSession, entries: list[tuple[str, int]]) -> str:
    """Write a digest array into the shared folder and let Spark carry it to every executor; the name to open it by."""
    prefix, jvm = f"urls-{uuid.uuid4().hex}", spark._jvm
    for name, data in DigestArray.files(entries).items():
        path = f"{checkpoint_root(spark)}/{prefix}-{name}.npy"
        target = jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(data))
        out.close()
        spark.sparkContext.addFile(path)
    return prefix


def _suffixes(host: str, sizes: set[int]) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[-k:]) for k in sizes if k <= len(labels)]


def _judge(prefix: str, labels: set[int], paths: set[int], blocked_labels: set[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = DigestArray(prefix, SparkFiles.get)
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            wanted, owner, is_rule = [], [], []
            for i, (host, path) in enumerate(parts):
                mine = [s + path[:n] for s in _suffixes(host, labels) for n in paths if n <= len(path)] if host else []
                own = ["\n" + s for s in _suffixes(host, blocked_labels)] if host else []
                wanted += mine + own
                owner += [i] * (len(mine) + len(own))
                is_rule += [True] * len(mine) + [False] * len(own)
            codes = digests.probe(wanted)
            best: dict[int, tuple[int, str, int]] = {}
            listed = set()
            for k in np.flatnonzero(codes >= 0):
                i, text = owner[k], wanted[k]
                if not is_rule[k]:
                    listed.add(i)
                elif i not in best or (len(text), text) > best[i][:2]:
                    best[i] = (len(text), text, int(codes[k]))
            rule = [best[i][1] if i in best else None for i in range(len(parts))]
            verdict = [
                ("block" if best[i][2] else "allow") if i in best else ("block" if i in listed else "allow")
                for i in range(len(parts))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], rule, verdict))],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def judge_urls(pages: DataFrame, rules=RULES, blocked_hosts=BLOCKED_HOSTS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``page_id, url``.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest wins. Without a rule a
    page is blocked if its host or a parent is in ``blocked_hosts``, else allowed. A null url has an empty host and path,
    fits no rule and is allowed; repeated rows are judged each; an empty table gives an empty result.
    """
    entries = [(text, int(verdict == "block")) for verdict, text in rules] + [("\n" + h, 1) for h in blocked_hosts]
    labels = {r.split("/", 1)[0].count(".") + 1 for _, r in rules}
    paths = {len(r) - r.find("/") for _, r in rules}
    prefix = share_digests(pages.sparkSession, entries)
    run = _judge(prefix, labels, paths, {h.count(".") + 1 for h in blocked_hosts})
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def op7_urls(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM p
), q AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM h
), r(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), b(host) AS (
  VALUES ('cheap-pills.example.org'), ('spam-farm.example.org'), ('cheap-pills.example.net'), ('spam-farm.example.net')
), m AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM q JOIN r ON (q.host = r.host OR q.host LIKE '%.' || r.host) AND starts_with(q.path, r.path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule,
       coalesce(m.verdict, CASE WHEN EXISTS (SELECT 1 FROM b WHERE q.host = b.host OR q.host LIKE '%.' || b.host) THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN m USING (page_id)
"""
