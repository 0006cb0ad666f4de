"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import cross_polytope, langid, mixing, mtree, prefix_trie, quality, secrets, sentencepiece_codec, simhash, spelling, suffix_tree_lm, toxicity, url_filter

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_language_id": langid.op3_language_id,
    "op4_url_filters": url_filter.op4_url_filters,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_lm_scores": suffix_tree_lm.op8_lm_scores,
    "op9_exact_top_k": mtree.op9_exact_top_k,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_nearest_neighbours": cross_polytope.op12_nearest_neighbours,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

#: The others can't be expressed in SQL; tests hold them against brute force, a round trip or held-out labels.
ORACLES = {
    "op2_quality_rules": quality.OP2_SQL,
    "op4_url_filters": url_filter.OP4_SQL,
    "op9_exact_top_k": mtree.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
