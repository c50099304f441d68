"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, hilbert, kneser, langid, mixing, neardup, pieces, sketch, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_quality_divergence": divergence.op2_quality_divergence,
    "op2_quality_by_length": divergence.op2_quality_by_length,
    "op3_document_fingerprints": sketch.op3_document_fingerprints,
    "op3_containment": sketch.op3_containment,
    "op3_source_overlap": sketch.op3_source_overlap,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_quality_classifier": kneser.op5_quality_classifier,
    "op6_warc_bundles": warc.op6_warc_bundles,
    "op7_minhash_near_dedup": neardup.op7_minhash_near_dedup,
    "op8_url_filters": urlfilter.op8_url_filters,
    "op9_hilbert_sharding": hilbert.op9_hilbert_sharding,
    "op9_hilbert_manifest": hilbert.op9_hilbert_manifest,
    "op10_language_id": langid.op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.oracle_sql(),
    "op2_quality_divergence": divergence.oracle_sql(),
    "op8_url_filters": urlfilter.oracle_sql(),
    "op9_hilbert_sharding": hilbert.oracle_sql(),
    "op9_hilbert_manifest": hilbert.manifest_sql(),
}
