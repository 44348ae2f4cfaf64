"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from marketloom.llm.bpe_codec import op13_bpe_codec
from marketloom.llm.chat_format import op2_chat_format
from marketloom.llm.divergence import OP12_SQL, op12_divergence_audit
from marketloom.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from marketloom.llm.importance import OP11_SQL, op11_importance_resampling
from marketloom.llm.license_scan import op10_license_scan
from marketloom.llm.mixing import op9_mixing
from marketloom.llm.near_dedup import op4_near_dedup
from marketloom.llm.packing import op3_best_fit_packing
from marketloom.llm.quality_classifier import op7_quality_classifier
from marketloom.llm.quality_rules import op6_quality_rules
from marketloom.llm.token_counts import op5_token_counts
from marketloom.llm.token_files import op8_token_files

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_files": op8_token_files,
    "op9_mixing": op9_mixing,
    "op10_license_scan": op10_license_scan,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_divergence_audit": op12_divergence_audit,
    "op13_bpe_codec": op13_bpe_codec,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op1_exact_dedup": OP1_SQL, "op11_importance_resampling": OP11_SQL, "op12_divergence_audit": OP12_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
