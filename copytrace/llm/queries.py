"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

import corpus_pipeline
from copytrace.llm import ann, byte_bpe, importance, language, line_dedup, mixing, packing, pii, prefix_trie, simhash, tokens, toxicity, vector_dedup

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_vector_dedup": vector_dedup.op2_vector_dedup,
    "op3_neighbours": ann.op3_neighbours,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash": simhash.op5_simhash,
    "op6_tokens": tokens.op6_tokens,
    "op7_packing": packing.op7_packing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language": language.op10_language,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_importance": importance.op13_importance,
    "pipeline": corpus_pipeline.run,
}

# The others have no SQL form: their tests compare with brute force, the library or held-out labels.
SQL = {
    "op2_vector_dedup": vector_dedup.SQL,
    "op4_mixing": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_importance": importance.SQL,
}
