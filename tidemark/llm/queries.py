"""Queries of this folder's operators and of the pipeline, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, fingerprints, language, licenses, line_dedup, media, ngram_join, packing, repeats, toxicity


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_language": language.op3_language,
    "op4_repeats": repeats.op4_repeats,
    "op5_media": media.op5_media,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_packing": packing.op8_packing,
    "op9_licenses": licenses.op9_licenses,
    "op10_toxicity": toxicity.op10_toxicity,
    "pipeline": _pipeline,
}

ORACLES: dict[str, str] = {
    "op4_repeats": repeats.ORACLE_SQL,
    "op6_ngram_join": ngram_join.ORACLE_SQL,
}
