"""The queries of this subpackage, by name, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from . import decontaminate, infill, language_id, licenses, line_dedup, mixing, ngram_join, quality, sentence_pieces, sharding, substring_dedup, token_files, vector_codes

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_token_files": token_files.op5_token_files,
    "op6_suffix_dedup": substring_dedup.op6_suffix_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language_id.op8_language_id,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_sentence_pieces": sentence_pieces.op13_sentence_pieces,
}
SQL = {
    "op1_ngram_join": ngram_join.OP1_SQL,
    "op6_suffix_dedup": substring_dedup.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_fill_in_middle": infill.OP12_SQL,
}
