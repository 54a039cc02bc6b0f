"""All queries of this folder."""

from postlens.llm import op1_preferences, op2_collision_ann, op3_near_dedup, op4_main_text, op10_substring_dedup, op11_decontaminate, op12_ranked_search, op13_hard_negatives, op5_iblt, op6_language, op7_token_counts, op8_byte_bpe, op9_packing  # noqa: F401  (they register)
from postlens.llm.registry import ORACLE, QUERIES  # noqa: F401
