"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    chat_format,
    decontaminate,
    exact_dedup,
    fill_middle,
    language_id,
    lexical_search,
    mixing,
    ngram_jaccard,
    pii,
    quality_knn,
    substring_dedup,
    suffix_dedup,
    token_count,
)

QUERIES = {
    "op1_quality": quality_knn.op1_quality,
    "op2_language_id": language_id.op2_language_id,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_ngram_jaccard": ngram_jaccard.op4_ngram_jaccard,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_pii": pii.op6_pii,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_token_count": token_count.op9_token_count,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_chat_format": chat_format.op13_chat_format,
}
#: DuckDB statements of those that SQL can express.
SQL = {
    "op4_ngram_jaccard": ngram_jaccard.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op12_fill_in_middle": fill_middle.SQL,
    "op13_chat_format": chat_format.SQL,
}
