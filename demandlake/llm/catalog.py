"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from demandlake.llm import (
    alignment,
    chaining,
    dac,
    decontam,
    langid,
    licenses,
    markov_secrets,
    nbest,
    prefixtrie,
    quality,
    simhash,
    tokencounts,
    toxicity,
)

QUERIES = {
    "op1_substring_chains": chaining.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_quality_rules": quality.query,
    "op4_token_rollups": tokencounts.query,
    "op5_token_dac": dac.query,
    "op6_sentencepiece_nbest": nbest.query,
    "op7_toxicity_mil": toxicity.query,
    "op8_secret_scan": markov_secrets.query,
    "op9_decontamination": decontam.query,
    "op10_license_scan": licenses.query,
    "op11_tokenizer_alignment": alignment.query,
    "op12_prefix_trie": prefixtrie.query,
    "op13_language_id": langid.query,
}

SQL = {
    "op3_quality_rules": quality.SQL,
    "op4_token_rollups": tokencounts.SQL,
}
