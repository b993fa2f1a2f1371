"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from fieldspark.llm.bpe import op8_bpe
from fieldspark.llm.chat import op9_chat
from fieldspark.llm.divergence import OP12_SQL, op12_divergence
from fieldspark.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from fieldspark.llm.language_id import op2_language
from fieldspark.llm.packing import op4_packing
from fieldspark.llm.pii import op6_pii
from fieldspark.llm.pitman_yor import op13_pitman_yor
from fieldspark.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from fieldspark.llm.secrets import op10_secrets
from fieldspark.llm.simhash import op1_simhash
from fieldspark.llm.spotsigs import op5_fingerprints
from fieldspark.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language": op2_language,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_chat": op9_chat,
    "op10_secrets": op10_secrets,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_divergence": op12_divergence,
    "op13_pitman_yor": op13_pitman_yor,
}

ORACLES = {"op3_exact_dedup": OP3_SQL, "op11_prefix_trie": OP11_SQL, "op12_divergence": OP12_SQL}
