"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_automaton import op13_bpe_automaton
from .chat import OP7_SQL, op7_chat_formatting
from .decontaminate import OP4_SQL, op4_benchmark_decontamination
from .filter_audit import OP12_SQL, op12_filter_audit
from .fingerprints import op10_document_fingerprints
from .language_model import op1_language_model
from .near_duplicates import OP8_SQL, op8_near_duplicates
from .packing import op2_best_fit_packing
from .passages import op3_substring_dedup
from .quality import op5_quality_classifier
from .secrets import op6_secret_scan
from .spelling import op11_spelling_variants
from .toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_model, op2_best_fit_packing, op3_substring_dedup, op4_benchmark_decontamination,
                            op5_quality_classifier, op6_secret_scan, op7_chat_formatting, op8_near_duplicates,
                            op9_toxicity, op10_document_fingerprints, op11_spelling_variants, op12_filter_audit,
                            op13_bpe_automaton)}
ORACLE_SQL: dict[str, str] = {"op4_benchmark_decontamination": OP4_SQL, "op8_near_duplicates": OP8_SQL,
                              "op7_chat_formatting": OP7_SQL, "op12_filter_audit": OP12_SQL}
