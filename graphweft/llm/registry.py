"""Queries of the training-data operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from graphweft.llm import (alignment, chat, decontaminate, langid, licenses, lm, minhash, mixing,
                           prefix_trie, secrets, token_counts, toxicity, vectors)

QUERIES = {
    "op1_language_id": langid.query,
    "op2_toxicity": toxicity.query,
    "op3_decontamination": decontaminate.query,
    "op4_embedding_near_dedup": vectors.query,
    "op5_minhash_near_dedup": minhash.query,
    "op6_secret_scan": secrets.query,
    "op7_lm_score": lm.query,
    "op8_license_scan": licenses.query,
    "op9_chat_format": chat.query,
    "op10_source_mix": mixing.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_cross_tokenizer_alignment": alignment.query,
    "op13_token_counts": token_counts.query,
}

ORACLES: dict[str, str] = {
    "op4_embedding_near_dedup": vectors.ORACLE,
    "op5_minhash_near_dedup": minhash.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
}
