"""The registered queries of these operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from lumenward.llm import (
    op1_itq_dedup, op2_mixing, op3_byte_bpe, op4_lm_scoring, op5_minhash, op6_url_filter, op7_pu_quality,
    op8_quality_rules, op9_secret_scan, op10_chat_format, op11_prefix_trie, op12_packing, op13_hard_negatives,
)
from lumenward.llm.common import with_package

_MODULES = {
    "op1_itq_dedup": op1_itq_dedup,
    "op2_mixing": op2_mixing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_minhash": op5_minhash,
    "op6_url_filter": op6_url_filter,
    "op7_pu_quality": op7_pu_quality,
    "op8_quality_rules": op8_quality_rules,
    "op9_secret_scan": op9_secret_scan,
    "op10_chat_format": op10_chat_format,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_packing": op12_packing,
    "op13_hard_negatives": op13_hard_negatives,
}

QUERIES = {name: with_package(query) for name, query in {
    **{name: module.query for name, module in _MODULES.items()}, "pipeline": corpus_pipeline.run}.items()}
ORACLE_SQL = {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
