"""The queries of this subpackage and their SQL."""

from keyedflow.llm import (
    exact_dedup,
    fingerprints,
    html_text,
    licenses,
    mixing,
    near_dedup,
    packing,
    prefix_trie,
    sharding,
    toxicity,
    url_rules,
    warc,
    whitening,
)

LLM_QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_warc": warc.op4_warc,
    "op5_balanced_shards": sharding.op5_balanced_shards,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_mixing": mixing.op7_mixing,
    "op8_html_text": html_text.op8_html_text,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_url_rules": url_rules.op10_url_rules,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_whitening": whitening.op12_whitening,
    "op13_licenses": licenses.op13_licenses,
}

LLM_ORACLE = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op4_warc": warc.OP4_SQL,
    "op10_url_rules": url_rules.OP10_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
}
