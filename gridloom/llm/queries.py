"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op6_bpe
from .chat_format import OP11_SQL, op11_chat_format
from .embedding_dedup import op3_embedding_dedup
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .language_id import op2_language_id
from .minhash_dedup import op4_minhash_dedup
from .packing import op7_best_fit_packing
from .pii import op5_pii
from .substring_dedup import op1_substring_dedup
from .suffix_array_dedup import op10_suffix_array_dedup
from .token_alignment import op12_token_alignment
from .toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_language_id,
        op3_embedding_dedup,
        op4_minhash_dedup,
        op5_pii,
        op6_bpe,
        op7_best_fit_packing,
        op8_toxicity,
        op9_exact_dedup,
        op10_suffix_array_dedup,
        op11_chat_format,
        op12_token_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {"op9_exact_dedup": OP9_SQL, "op11_chat_format": OP11_SQL}
