"""Queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from pelagia.llm import collocations, embedding_dedup, hard_negatives, language_id, line_dedup, near_dedup, oracle, packing, pii, ppm, quality, sentencepiece_bpe, url_filter, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_quality_rules": quality.query,
    "op3_language_id": language_id.query,
    "op4_ppm": ppm.query,
    "op5_sentencepiece_bpe": sentencepiece_bpe.query,
    "op6_embedding_dedup": embedding_dedup.query,
    "op7_near_dedup": near_dedup.query,
    "op8_url_filter": url_filter.query,
    "op9_packing": packing.query,
    "op10_pii": pii.query,
    "op11_line_dedup": line_dedup.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_collocations": collocations.query,
}

ORACLE_SQL: dict[str, str] = {"op1_warc": oracle.WARC, "op6_embedding_dedup": oracle.EMBEDDINGS, "op7_near_dedup": oracle.NEAR_DOCUMENTS, "op11_line_dedup": oracle.LINES, "op12_hard_negatives": oracle.NEGATIVES, "op13_collocations": oracle.COLLOCATIONS}
