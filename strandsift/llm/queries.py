"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import column_bwt, feature_resampling, jaccard_join, language_id, lexical_search, line_frequency, mixing, packing, secret_scan, suffix_tree_lm, toxicity, warc, webp

QUERIES = {
    "op1_line_frequency": line_frequency.op1_line_frequency,
    "op2_suffix_tree_lm": suffix_tree_lm.op2_suffix_tree_lm,
    "op3_language_id": language_id.op3_language_id,
    "op4_mix": mixing.op4_mix,
    "op5_best_fit": packing.op5_best_fit,
    "op6_warc": warc.op6_warc,
    "op7_webp": webp.op7_webp,
    "op8_column_bwt": column_bwt.op8_column_bwt,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_importance_resampling": feature_resampling.op13_importance_resampling,
}
ORACLES = {
    "op1_line_frequency": line_frequency.OP1_SQL,
    "op4_mix": mixing.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
    "op10_jaccard_join": jaccard_join.OP10_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_importance_resampling": feature_resampling.OP13_SQL,
}
