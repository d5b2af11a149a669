"""Language identification by profiles of character triples, learned from a table of texts with their language.

Triples of code points fall into a fixed number of buckets, so a profile has one size however much text it is learned
from, and counts of any number of texts are added up without a dictionary. A text belongs to the language under whose
profile its triples are likeliest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from curata.runtime import arrow_rows, share

#: Buckets of triples, and what is added to each count.
BUCKETS, SMOOTHING = 1 << 16, 0.5
#: Languages of a profile table at most; each takes half a megabyte.
MOST_LANGUAGES = 400


class Profiles(NamedTuple):
    """Languages in order, and the log-probability of each bucket under each of them."""

    languages: list[str]
    logs: np.ndarray

    def of(self, text: str | None) -> str | None:
        """The likeliest language, the first of equal ones; None for a null or empty text, or without languages."""
        if not text or not self.languages:
            return None
        return self.languages[int(self.logs[buckets(text)].sum(axis=0).argmax())]


def buckets(text: str) -> np.ndarray:
    """Bucket of each triple of code points of a text with a blank on either side."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % BUCKETS


def triple_counts(texts: DataFrame, text: str, language: str) -> DataFrame:
    """``language, bucket, n`` of all texts; null texts and languages count nowhere. Tasks add up their own counts first."""
    arrow_rows(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t and name is not None:
                    own = np.bincount(buckets(t), minlength=BUCKETS)
                    sums[name] = sums[name] + own if name in sums else own
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], ["language", "bucket", "n"])

    counted = texts.select(F.col(text), F.col(language).cast("string")).mapInArrow(count, "language string, bucket long, n long")
    return counted.groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame, text: str = "text", language: str = "lang") -> Profiles:
    """Profiles of all languages of a table; at most ``MOST_LANGUAGES`` times ``BUCKETS`` counts come to the driver."""
    counts = triple_counts(texts, text, language)
    frame = counts.toPandas()
    names = sorted(frame["language"].unique())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MOST_LANGUAGES} fit a profile table")
    table = np.full((BUCKETS, len(names)), SMOOTHING)
    table[frame["bucket"].to_numpy(dtype=int), frame["language"].map({n: k for k, n in enumerate(names)}).to_numpy(dtype=int)] += frame["n"].to_numpy(dtype=float)
    return Profiles(names, np.log(table / table.sum(axis=0)) if names else table)


def detector(spark, profiles: Profiles) -> Callable[[Column], Column]:
    """A function of a text column that gives its language; whole texts are scored in Arrow batches."""
    get = share(spark, profiles)

    @F.pandas_udf(StringType())
    def detected(texts: pd.Series) -> pd.Series:
        held = get()
        return pd.Series([held.of(t) for t in texts], dtype=object)

    return detected
