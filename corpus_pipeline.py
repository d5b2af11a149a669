"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, packing.

Each stage takes what its predecessor kept. All but the last return the columns of ``documents``; the last returns the
places of all pieces in packed sequences. Between stages the rows are written as Parquet in the shared folder and read
again, so a lost executor never costs more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.llm import decontaminate, packing, pii, quality, simhash
from curata.runtime import discard, free_name, materialize


def quality_rules(spark, docs, sf_dir):
    """Drop documents that fail the rules or whose host does.

    A null text fails for its few words; a null source is a host of its own; repeated rows are judged each and stay
    together; an empty table stays empty; other columns keep their values, whatever their names.
    """
    return quality.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8), the one with the least id.

    Of equal ids the first row stays; a null id only where the whole group has none; null texts and texts without words
    are copies of each other; an empty table stays empty; other columns keep their values, whatever their names.
    """
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Drop documents that hold an item of the benchmark.

    Null and empty texts hold none and stay; repeated rows stay or go together; an empty table or benchmark drops
    nothing; other columns keep their values, whatever their names.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark, docs, sf_dir):
    """Replace personal data by its kind; ``n_chars`` follows where a text changes.

    All rows stay, repeated ones too; a null text stays null and a null ``n_chars`` too; an empty table stays empty; other
    columns keep their values, whatever their names.
    """
    before = free_name(docs, "curata_before")
    counted = pii.redact(docs.withColumn(before, F.length("text")))
    if "n_chars" in docs.columns:
        shift = F.coalesce(F.length("text") - F.col(before), F.lit(0))
        counted = counted.withColumn("n_chars", (F.col("n_chars") + shift).cast(docs.schema["n_chars"].dataType))
    return counted.select(*docs.columns)


def pack(spark, docs, sf_dir):
    """Pack the tokens of all documents into sequences.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table gives no pieces; other columns
    are not read.
    """
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)  # only tables of our own
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
