"""Queries of the subpackage and the SQL that DuckDB can run for them."""

from __future__ import annotations

from tillscope.llm import (
    decontaminate, digest, doubling, jaccard, language, mixing, sharding, site_templates, suffix_tree, suffixes, toxicity, turn_trie, whitening,
)

QUERIES = {
    "op1_suffix_tree": suffix_tree.op1,
    "op2_weighted_hash_tree": sharding.op2,
    "op3_hierarchical_mix": mixing.op3,
    "op4_level_doubling": doubling.op4,
    "op5_factorization_machine": toxicity.op5,
    "op6_improbable_features": digest.op6,
    "op7_ngram_product": jaccard.op7,
    "op8_simhash_windows": decontaminate.op8,
    "op9_segmentation_unigrams": language.op9,
    "op10_sparse_suffixes": suffixes.op10,
    "op11_block_whitening": whitening.op11,
    "op12_turn_trie": turn_trie.op12,
    "op13_site_templates": site_templates.op13,
}

ORACLES = {"op3_hierarchical_mix": mixing.ORACLE}
