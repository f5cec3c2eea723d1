"""The registered queries of this package and their SQL."""

from __future__ import annotations

from galley.llm import (
    byte_bpe,
    edit_match,
    html_lstm,
    language_crf,
    lattice_lm,
    ngram_join,
    passage_dedup,
    phrase_tiles,
    pii_semicrf,
    quality_net,
    source_mix,
    vector_codes,
    vector_dedup,
)

QUERIES = {
    "op1_pii_semicrf": pii_semicrf.op1_pii_semicrf,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_passage_dedup": passage_dedup.op3_passage_dedup,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_lattice_lm": lattice_lm.op5_lattice_lm,
    "op6_edit_match": edit_match.op6_edit_match,
    "op7_html_lstm": html_lstm.op7_html_lstm,
    "op8_language_crf": language_crf.op8_language_crf,
    "op9_vector_dedup": vector_dedup.op9_vector_dedup,
    "op10_quality_net": quality_net.op10_quality_net,
    "op11_phrase_tiles": phrase_tiles.op11_phrase_tiles,
    "op12_source_mix": source_mix.op12_source_mix,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

SQL = {
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op9_vector_dedup": vector_dedup.OP9_SQL,
    "op11_phrase_tiles": phrase_tiles.OP11_SQL,
    "op12_source_mix": source_mix.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
