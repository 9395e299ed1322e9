"""Queries of the training-data operators, by name."""

from __future__ import annotations

from churnlens.llm.decontamination import op8_decontamination
from churnlens.llm.importance import OP12_SQL, op12_importance_resampling
from churnlens.llm.jaccard_join import op3_jaccard_join
from churnlens.llm.language_model import op9_lm_scoring
from churnlens.llm.license_scan import op10_license_scan
from churnlens.llm.packing import op11_best_fit_packing
from churnlens.llm.pieces import op6_sentencepiece
from churnlens.llm.quality_rules import OP4_SQL, op4_quality_rules
from churnlens.llm.substring_dedup import op1_substring_dedup
from churnlens.llm.suffix_dedup import op5_suffix_dedup
from churnlens.llm.toxicity import op7_toxicity
from churnlens.llm.url_filter import op2_url_filter
from churnlens.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_license_scan": op10_license_scan,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_vector_codes": op13_vector_codes,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op4_quality_rules": OP4_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
