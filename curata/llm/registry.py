"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from curata.llm import copies, decontaminate, hilbert, infill, licenses, maxent, negatives, packing, pii, quality, simhash, toxicity, urls

_QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_maxent": maxent.op2_maxent,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_hilbert": hilbert.op5_hilbert,
    "op6_licenses": licenses.op6_licenses,
    "op7_urls": urls.op7_urls,
    "op8_quality": quality.op8_quality,
    "op9_pii": pii.op9_pii,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_negatives": negatives.op11_negatives,
    "op12_infill": infill.op12_infill,
    "op13_copies": copies.op13_copies,
    "pipeline": corpus_pipeline.run,
}
_SQL: dict[str, str | None] = {
    "op7_urls": urls.ORACLE_SQL,
    "op8_quality": quality.ORACLE_SQL,
    "op11_negatives": negatives.ORACLE_SQL,
    "op12_infill": infill.ORACLE_SQL,
    "op13_copies": copies.ORACLE_SQL,
    "pipeline": corpus_pipeline.ORACLE_SQL,
}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return {k: v for k, v in _SQL.items() if v is not None}
