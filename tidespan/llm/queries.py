"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from tidespan.llm.chat_format import ORACLE_OP7, op7_chat_formatting
from tidespan.llm.decontamination import op4_decontamination
from tidespan.llm.fingerprints import op12_document_fingerprints
from tidespan.llm.katz_lm import op10_lm_scoring
from tidespan.llm.line_dedup import ORACLE_OP3, op3_line_dedup
from tidespan.llm.ngram_join import ORACLE_OP5, op5_ngram_join
from tidespan.llm.packing import op6_best_fit_packing
from tidespan.llm.pii_surrogates import op2_pii_surrogates
from tidespan.llm.quality_rules import op9_quality_rules, oracle_op9
from tidespan.llm.sessions import ORACLE_OP13, op13_gap_sessions
from tidespan.llm.token_files import op8_token_files
from tidespan.llm.url_filter import op1_url_filter
from tidespan.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_ngram_join": op5_ngram_join,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_token_files": op8_token_files,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_gap_sessions": op13_gap_sessions,
}
ORACLES: dict[str, str] = {
    "op3_line_dedup": ORACLE_OP3,
    "op5_ngram_join": ORACLE_OP5,
    "op7_chat_formatting": ORACLE_OP7,
    "op9_quality_rules": oracle_op9(),
    "op13_gap_sessions": ORACLE_OP13,
}
