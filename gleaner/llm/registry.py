"""Queries and SQL of the numbered operators and the pipeline."""

from __future__ import annotations

from . import centroids, extraction, jaccard, langid, media, mixing, neighbours, packing, pieces, ranking, token_files, toxicity, warc

QUERIES = {
    "op1_learned_partitions": neighbours.op1_learned_partitions,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_mixing": mixing.op3_mixing,
    "op4_main_text": extraction.op4_main_text,
    "op5_warc": warc.op5_warc,
    "op6_flac": media.op6_flac,
    "op7_language_id": langid.op7_language_id,
    "op8_packing": packing.op8_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op9_token_files": token_files.op9_token_files,
    "op11_centroids": centroids.op11_centroids,
    "op12_lexical_search": ranking.op12_lexical_search,
    "op13_byte_bpe": pieces.op13_byte_bpe,
}

ORACLES = {
    "op5_warc": warc.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op12_lexical_search": ranking.ORACLE,
}
