"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from . import decontaminate, html_extract, importance, language_id, license_scan, line_dedup, mixing, ngram_join, sentence_pieces, toxicity, url_filter, vector_codes, vector_search

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_language_id": language_id.op3_language_id,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_vector_search": vector_search.op7_vector_search,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_sentence_pieces": sentence_pieces.op11_sentence_pieces,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op12_importance_resampling": importance.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
